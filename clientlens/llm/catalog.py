"""Registered queries of this subpackage: one for each operator, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import preferences, revisits, vector_codes
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_language
    return predict_language(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_pack")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_revisits", revisits.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures(table(spark, sf_dir, "pages")))
    names = ("etag", "last-modified", "content-length", "cache-control", "x-cache")
    return found.select("record_id", "canonical_url", "ts", "refers_to", "outcome", "status", "digest", *(found["headers"][n].alias(n.replace("-", "_")) for n in names))


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_preferences", preferences.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = preferences.preference_examples(turns, preferences.consecutive_pairs(turns))
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", preferences.spans_text("chosen_spans").alias("chosen_spans"),
                        "rejected", preferences.spans_text("rejected_spans").alias("rejected_spans"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality
    return quality(table(spark, sf_dir, "documents"))


@query("op11_pu_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pu_quality import score_quality
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_vector_codes", vector_codes.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
