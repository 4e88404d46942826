"""The registered queries of the text operators over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hydrospark.llm import decontaminate, hardneg, linedup, merkle, mixing
from hydrospark.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


@register("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrospark.llm.quality import STATS, quality_rules
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules(docs).select("doc_id", *STATS, "base_failed", "kept", F.round("d2", 4).alias("d2"))


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrospark.llm.language import fit, identify
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model, spans=False).drop("text")


@register("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrospark.llm.licenses import scan_licenses
    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@register("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrospark.llm.secrets import fit, scan_secrets
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_field", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    from hydrospark.llm.tokens import section_tokens
    counted = section_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return counted.withColumns({
        "n_sections": F.size("sections").cast("bigint"),
        "n_crossing": F.aggregate("sections", F.lit(0).cast("bigint"), lambda n, s: n + s["n_crossing"]),
    })


@register("op7_warc")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrospark.llm.warc import page_records, write_pages
    path = write_pages(read_table(spark, sf_dir, "pages"))
    return page_records(spark, path).drop("target_uri")


@register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hydrospark.llm.neardup import jaccard_classes
    return jaccard_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


LEAST_WORDS = 20


@register("op3_line_dedup", linedup.SQL.format(w=LEAST_WORDS))
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=LEAST_WORDS)


@register("op8_decontamination", decontaminate.sql())
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op9_mixing", mixing.sql())
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@register("op11_merkle", merkle.sql())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = merkle.manifest(docs, altered=altered, alteration={"n_chars": F.col("n_chars") + 1}).leaves
    return leaves.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_sha256().alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


@register("op12_token_output")
def op12_token_output(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers
    from hydrospark.llm.tokenfiles import crc_of_ids, read_tokens, write_tokens
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = write_tokens(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return crc_of_ids(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op13_hard_negatives", hardneg.sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", moved.alias("label"))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
