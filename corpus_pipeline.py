"""Corpus preparation: quality rules, near and exact dedup, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``. Stages read ``doc_id``, ``text`` and
``lang`` and pass other columns on as they are. Null texts count as empty: they
fail the quality rules; an empty table goes through as an empty one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.catalog import tokenizer_path
from clientlens.llm.common import durable, likely, table, without
from clientlens.llm.decontaminate import contaminated
from clientlens.llm.near_dup import near_duplicates
from clientlens.llm.packing import pack
from clientlens.llm.quality import quality
from clientlens.llm.suffix_dedup import remove_repeats
from clientlens.session import ensure_checkpoint_dir


#: Bytes of the strings that the suffix stage removes: about 50 words.
PASSAGE = 256


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of id and text beside each row: stages decide on
    rows, not on ids, which may be null or repeated."""
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def _texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("__row").alias("doc_id"), "text", *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the word rules or their language's perplexity band reject go.
    A row is judged by itself, also where another has its doc_id."""
    rows = _by_row(docs)
    judged = quality(_texts(rows, "lang"))
    return without(rows, "__row", judged.where("not kept").select("doc_id")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five-word shingles, a
    similarity of 0.8), the one with the smallest doc_id (a null one last); of
    rows with the same id and text the one whose other columns come first."""
    rows = _by_row(docs)
    found = durable(near_duplicates(_texts(rows), shingle=5).select(F.col("doc_id").alias("__row"), "component_id"))
    groups = durable(found.where("__row <> component_id").select("component_id").distinct())
    members = durable(found.join(groups, "component_id", "left_semi").distinct())
    named = likely(rows.select("__row", "doc_id"), "__row", members.select("__row")).distinct().join(members, "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")).select("first.__row")
    left = without(rows, "__row", members.join(first, "__row", "left_anti").select("__row"))
    twice = durable(rows.groupBy("__row").count().where("count > 1").select("__row"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = likely(left, "__row", twice)
    one = again.groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("__first")).select("__first.*")
    return likely(left, "__row", twice, keep=False).select(*docs.columns).union(one.select(*docs.columns))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``PASSAGE`` bytes that occur again."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = docs.select("doc_id", "text", *(F.col(c).alias(f"__c{i}") for i, c in enumerate(others)))
    left = remove_repeats(aside, PASSAGE).select("doc_id", "text", *(F.col(f"__c{i}").alias(c) for i, c in enumerate(others)))
    if "n_chars" in others:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a text of ``benchmark`` go."""
    rows = _by_row(docs)
    found = contaminated(_texts(rows), table(spark, sf_dir, "benchmark"))
    return without(rows, "__row", found.select("doc_id")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("packing", best_fit_packing)]

#: Suffix sorting and the language model have no form in SQL; tests hold the
#: rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage's result is
    written to and read from the shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
