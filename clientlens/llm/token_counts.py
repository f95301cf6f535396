"""Token counts of whole texts by a two-tier lookup on the map side."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, texts_of
from .pretokens import broadcast_table, length_lookup, read_tokenizer

#: Entries of the broadcast table, and of what a task passes on for it.
TABLE_SIZE = 131_072
PER_TASK = 32_768
LIMIT = 2048


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT,
                 table_size: int = TABLE_SIZE, per_task: int = PER_TASK) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the tokenizer file's own library, without added
    special tokens, truncation or padding. One row per input row, repeated
    doc_ids and texts included; a null text counts as the empty one (0 bytes,
    0 tokens); other columns of ``docs`` are not read. No text is shuffled."""
    prepare(docs.sparkSession)
    shared = broadcast_table(docs, read_tokenizer(tokenizer_path), table_size, per_task)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = length_lookup(shared)
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = [lookup.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
