"""Text embeddings (TVF-05) and fixed-size chunking (TVF-12).

The reference calls a hosted embedding model; that model is unavailable,
so ``embed`` is a re-aimed, fully distributed MLlib pipeline —
``RegexTokenizer → HashingTF → IDF → Normalizer`` — giving unit-length
``array<float>`` vectors.  Similarity is lexical (TF-IDF), not semantic;
any precomputed vector column can be used with the vector search instead.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_embedder(df: DataFrame, text_col: str, dim: int = 256, min_doc_freq: int = 1) -> PipelineModel:
    """Fit the TF-IDF embedder on a corpus (the IDF weights are the only state).
    The fitted model reads a column named ``_text``; ``embed`` provides it."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_doc_freq),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]).fit(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")))


def embed(df: DataFrame, text_col: str, dim: int = 256, model: PipelineModel | None = None,
          out_col: str = "embedding") -> DataFrame:
    """Append ``out_col`` (array<float>, unit length) computed from ``text_col``."""
    m = model or fit_embedder(df, text_col, dim)
    cols = df.columns
    return (m.transform(df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))))
            .select(*cols, vector_to_array("_unit", dtype="float32").alias(out_col)))


def chunk(df: DataFrame, text_col: str, size: int = 200, overlap: int = 40, id_col: str = "doc_id") -> DataFrame:
    """Whole text → fixed-size, overlapping word windows (every word is in a chunk).

    Output: the input columns, ``chunk_no`` (0-based), ``chunk_text`` and a
    numeric ``chunk_id = id * 10^7 + chunk_no``; ids and chunk numbers for which
    that is not unique or does not fit raise an error.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    words = F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"\s+")
    # Chunk strings are built inside the row (total size ≈ text × size/step,
    # linear in the text), then exploded: no exploded row carries the whole
    # word array. There is always a chunk; posexplode would add a filter for
    # that to the plan, which splits the whole text again for each chunk.
    chunks = F.expr(
        f"transform(sequence(0, greatest(size(_w) - {overlap} - 1, 0), {step}), "
        f"s -> array_join(slice(_w, s + 1, {size}), ' '))")
    return (df.withColumn("_w", words).withColumn("_chunks", chunks).drop("_w")
            .select("*", F.posexplode_outer("_chunks").alias("chunk_no", "chunk_text")).drop("_chunks")
            .withColumn("chunk_id", F.when((F.col("chunk_no") < 10_000_000) & F.col(id_col).cast("long").between(0, 900_000_000_000),
                                           F.col(id_col).cast("long") * 10_000_000 + F.col("chunk_no"))
                        .otherwise(F.raise_error(F.lit("chunk_id does not fit: id or chunk number too large")).cast("long"))))
