"""What the encoder remembers: pieces end at line breaks, and forgetting or meeting them again changes no id."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from hydrospark.llm import tokenfiles as T


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def held(encoder, texts):
    """The encoder's ids are those of plain encodings; returns the pieces it had to encode."""
    learnt, learn = [], encoder._learn
    encoder._learn = lambda new: (learnt.append(len(new)), learn(new))[1]
    ids, sizes = encoder.encode(pa.array(texts, pa.string()), 2)
    del encoder._learn
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    return sum(learnt)


def test_a_line_break_ends_a_piece(vocabulary):
    words = [f"word{chr(97 + i)}." for i in range(20)]
    pairs = [f"{a}\n{b}" for a in words for b in words]
    assert held(T.Encoder(vocabulary), pairs) <= 3 * len(words)


def test_line_breaks_beside_blanks_and_at_ends(vocabulary):
    texts = ["\nab cd", "ab\n", "\n", "a \nb", "a\t\nb c", "a\n\nb", "a\r\nb", "a\n b", "", None, " \n", "a\n\tb", "x\x1cy\nz", "café\nÉté d'ici", "ab\ncd ef\n"]
    held(T.Encoder(vocabulary), texts)
    for t in texts:
        held(T.Encoder(vocabulary), [t])


def test_forgotten_pieces_are_encoded_anew(vocabulary, monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 60)
    rng, encoder = random.Random(3), T.Encoder(vocabulary)
    common = "the often met words stay in memory"
    letters = "abcdefghijklmno***,.é\n"
    for _ in range(12):
        made = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 50))) for _ in range(30)) for _ in range(4)]
        held(encoder, [common, *made])
        assert len(encoder.pieces) <= 60 and encoder.ids.dtype == np.int32
