"""Packing of documents into sequences of a fixed length, sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, prepare, slices, texts_of
from .pretokens import id_lookup, read_tokenizer
from .words import SLICE_BYTES

SEQUENCE = 4096
END_ID = 1
#: Tokens packed together by one task: many documents, few bytes.
BLOCK_TOKENS = 16_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document, ``end_id`` appended: only documents
    longer than ``capacity`` are cut, into full pieces and a last shorter one."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, end = id_lookup(shared), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            doc_ids, texts = batch.column(0).to_pylist(), [t.encode() for t in texts_of(batch.column(1))]
            for a, b in slices(map(len, texts), SLICE_BYTES):
                for doc_id, ids in zip(doc_ids[a:b], lookup.of(texts[a:b]), strict=True):
                    ids = np.concatenate((ids, end)).astype("<u4", copy=False)
                    rows += [(doc_id, k, at, len(part := ids[at:at + capacity]), zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by the sum-of-squares rule.

    ``open_bins[g]`` counts the bins with a gap of g tokens. An item of length
    s goes to the open bin for which the sum of the squared counts over the
    gaps 1..capacity-1 is smallest afterwards; a filled bin counts no more.
    Ties go to the smallest gap. A bin is opened only for an item that fits no
    open one. Items come longest first, so those hardest to place meet the
    most gaps."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for item in order.tolist():
        s = int(lengths[item])
        if s >= capacity:
            bins[item], offsets[item] = made, 0
            made += 1
            continue
        # change of the sum when a bin of gap g takes the item:
        # -2 N(g) + 1 for the gap it leaves, 2 N(g-s) + 1 for the one it gets
        counts = open_bins[s:capacity]
        change = 2 * (open_bins[:capacity - s] - counts) + 2
        change[0] = 1 - 2 * counts[0]  # filled up: no new gap
        change[counts == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        if counts[best] == 0:
            gap, target = capacity, made
            made += 1
        else:
            gap = s + best
            target = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[item], offsets[item] = target, capacity - gap
        if left := gap - s:
            open_bins[left] += 1
            stacks[left].append(target)
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = END_ID,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``.

    Whole pieces are a sequence each and stay where they are. The others are
    dealt to blocks of about ``block_tokens`` by their place in the table, so no
    doc_id is hot, null and repeated ones included; each block is packed by
    :func:`place` and leaves at most a few sequences unfilled. Only lengths
    travel, not ids. A null or
    empty text is one piece of the end id alone; repeated rows are packed each;
    an empty table gives an empty result."""
    cut = durable(pieces(docs, tokenizer_path, capacity, end_id))
    total = cut.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    n_blocks = max(1, round(total / block_tokens))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable")
        where, offset = place(rows["length"].to_numpy(np.int64), capacity)
        return rows.drop(columns="block").assign(sequence_id=where * n_blocks + int(key[0]), offset=offset)

    numbered = cut.withColumn("at", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == capacity).select(*cut.columns, (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity).withColumn("block", F.pmod(F.xxhash64("at"), F.lit(n_blocks))).drop("at")
    return whole.union(rest.groupBy("block").applyInPandas(fill, PIECES + ", sequence_id long, offset long"))
