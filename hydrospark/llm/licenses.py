"""License scans: exact base phrases, and short notices with a bounded number of character edits."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hydrospark.llm.common import map_slices

#: Words of the text after A-Z is lower-cased: ASCII digits and letters, and everything beyond ASCII.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

# Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Short notices in lower-case words, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("released under the bsd license", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def normalise(text: str) -> str:
    """Words joined by single blanks, A-Z in lower case, with a blank at both ends."""
    joined = " ".join(WORD.findall(text))
    low = joined.lower() if joined.isascii() else joined.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return f" {low} "


class Searcher:
    """Finds notices with at most one edit per ``edit_every`` characters of the notice.

    A notice that may have e edits is cut into e + 1 pieces; one of them must occur exactly
    (pigeonhole). All pieces of all notices are sought at once; around each hit the bounded-error
    match of the whole notice decides.
    """

    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES, edit_every: int = 12):
        self.notices = []
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, label) in enumerate(notices):
            edits = len(phrase) // edit_every
            step = len(phrase) / (edits + 1)
            cuts = [round(i * step) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(phrase[a:b], []).append((k, a))
            pattern = regex.compile(rf"(?b)(?<=\ )(?:{regex.escape(phrase)}){{e<={edits}}}(?=\ )")
            self.notices.append((phrase, label, edits, pattern))
        self.seeds = ahocorasick.Automaton()
        for s, places in seeds.items():
            self.seeds.add_word(s, (len(s), places))
        self.seeds.make_automaton()

    def find(self, norm: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, notice length) in the normalised text; of overlapping matches the one with fewest edits.

        Every place where a seed lets a notice begin is searched on its own, in a stretch no longer than the
        notice and its edits, so the work grows with the number of seeds found and no match hides another one.
        """
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.seeds.iter(norm):
            for k, shift in places:
                begins.setdefault(k, set()).add(end + 1 - size - shift)
        found = set()
        for k, places in begins.items():
            phrase, label, edits, pattern = self.notices[k]
            last = None
            for begin in sorted(places):
                # beginnings fewer edits apart are one place
                if last is not None and begin - last <= edits:
                    continue
                last = begin
                lo = max(0, begin - edits - 1)
                part = norm[lo:begin + len(phrase) + 2 * edits + 1]
                at = self._match(k, pattern, part)
                if at is not None:
                    found.add((lo + at[0], lo + at[1], label, at[2], len(phrase)))
        return disjoint(sorted(found, key=lambda x: (x[3] / x[4], -x[4], x[0], x[2])))

    def _match(self, k: int, pattern: regex.Pattern, part: str) -> tuple[int, int, int] | None:
        """Best match of a notice in a short stretch: start, end, edits. Stretches seen before are remembered."""
        key = (k, part)
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            m = pattern.search(part)
            self.seen[key] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        return self.seen[key]


def disjoint(spans: list[tuple]) -> list[tuple]:
    """Of overlapping spans the first in the order given, sorted by place."""
    chosen: list[tuple] = []
    for x in spans:
        i = bisect_left(chosen, x[:2], key=lambda y: y[:2])
        if (i == 0 or chosen[i - 1][1] <= x[0]) and (i == len(chosen) or x[1] <= chosen[i][0]):
            chosen.insert(i, x)
    return chosen


class Words:
    """Numbers of the words of a normalised text by place; blanks are counted once, when first asked."""

    def __init__(self, norm: str):
        self.norm, self.blanks = norm, None

    def before(self, at: int) -> int:
        """Blanks before ``at``."""
        if self.blanks is None:
            self.blanks = np.flatnonzero(np.frombuffer(self.norm.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        return int(np.searchsorted(self.blanks, at))


def base_places(norm: str, words: Words | None = None) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase."""
    places, words = [], words or Words(norm)
    if "license" in norm:
        for phrase, label in BASE:
            at = norm.find(f" {phrase} ")
            while at >= 0:
                places.append((words.before(at), label))
                at = norm.find(f" {phrase} ", at + 1)
    return sorted(places)


def _scan(part: pa.RecordBatch, text: str, searcher: Searcher) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans")}
    for t in part.column(text).to_pylist():
        t = t or ""
        norm = normalise(t)
        words = Words(norm)
        places = base_places(norm, words)
        found = searcher.find(norm)
        base, labels = {x for _, x in places}, {x[2] for x in found}
        out["n_words"].append(norm.count(" ") - 1 if norm != "  " else 0)
        out["n_base"].append(len(places))
        out["first_word"].append(places[0][0] if places else None)
        out["last_word"].append(places[-1][0] if places else None)
        out["base_labels"].append(",".join(sorted(base)))
        out["labels"].append(",".join(sorted(base | labels)))
        out["score"].append(1.0 if places else max((1 - x[3] / x[4] for x in found), default=0.0))
        spans = []
        if found:
            at = [m.span() for m in WORD.finditer(t)]
            for a, b, label, edits, _ in found:
                first, last = words.before(a) - 1, words.before(b) - 1
                spans.append({"label": label, "start": at[max(first, 0)][0], "end": at[min(max(last, 0), len(at) - 1)][1], "edits": edits})
        out["license_spans"].append(spans)
    return out


def scan_licenses(docs: DataFrame, text: str = "text", notices: Iterable[tuple[str, str]] = NOTICES, edit_every: int = 12) -> DataFrame:
    """``docs`` plus word count, places and labels of base phrases, all labels, score and notice spans of the whole text.

    Spans are character offsets in the text with their number of edits; the score is 1 with a base
    phrase, else the best share of unedited notice characters, else 0. Null text counts as empty: no
    words, no labels, score 0. Ties between notices at one place go to fewer edits, then to the longer
    notice, then by label. Input columns named like one made here are replaced.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]
    keep = [c for c in docs.columns if c not in made]
    listed, held = list(notices), []

    def scan(part: pa.RecordBatch) -> dict[str, list]:
        if not held:
            held.append(Searcher(listed, edit_every))
        return _scan(part, text, held[0])

    schema = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
              "license_spans array<struct<label:string,start:int,end:int,edits:int>>")
    return map_slices(docs.select(*keep), text, scan, schema, keep)
