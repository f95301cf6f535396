"""Removal of long byte strings that occur more than once in the corpus.

Every window of ``length`` bytes has an anchor, the place of its smallest
k-gram hash, which any equal window has at the same distance. The windows of a
text with the same anchor are one segment. Equal segments are found by their
hash; of the others only those whose anchor occurs elsewhere need a look. They
are cut into cells of 64 windows, which share a core of 337 bytes: windows are
equal only if their cores are, so a cell is held as the few bytes beside its
core, and the core as one symbol. The cells of a bounded block of cores are
sorted by suffix together, and equal windows stand next to each other there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, likely, prepare, slices, texts_of
from .suffix_sort import suffix_array
from .words import SLICE_BYTES, Prefix, scramble

LENGTH = 400
GRAM = 32
#: Windows of a cell.
CELL = 64
#: Symbols that one suffix array holds; a core with more of them beside it is
#: compared by hashes of its windows, which are spread over all tasks.
BLOCK = 1 << 17
#: Windows compared with their neighbours at once, and cells of an output batch.
COMPARED, CELL_ROWS = 1 << 13, 1 << 13

SEGMENTS = "key long, row long, start long, windows int, back int, anchor long, segment long"
CELLS = "key long, row long, begin long, n int, anchor long, core long, whole long, mass long, left binary, right binary"


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` entries."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of the texts: (text number, first window, windows, bytes from
    the first window to the anchor, hash of the anchor's k-gram, hash of the
    segment's text and of the anchor's place in it)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(buffer), length - gram + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    prefix = Prefix(buffer)
    at = np.arange(n - gram + 1)
    hashes = prefix.of(at, at + gram)
    low = np.uint64(24)
    key = (hashes >> low << low) | (np.uint64((1 << 24) - 1) - at.astype(np.uint64))  # ties: the last place
    least = _smallest(key, width)
    anchor = ((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    where = np.arange(len(anchor))
    text = np.searchsorted(ends, where, side="right")
    inside = where + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    new |= np.concatenate(([False], ~inside[:-1]))
    first = np.flatnonzero(new & inside)
    # a segment ends before the next first window, or where windows cross the end of the text
    turn = np.append(np.flatnonzero(new | ~inside), len(anchor))
    last = turn[np.searchsorted(turn, first, side="right")]
    a = anchor[first]
    whole = prefix.of(first, last - 1 + length)
    seal = scramble(whole ^ scramble(((a - first) << 20 | (last - first)).astype(np.uint64), 5))
    return text[first], first - starts[text[first]], last - first, a - first, hashes[a].astype(np.int64), seal.astype(np.int64)


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, place, bytes): very long texts in parts that overlap by
    ``length`` - 1 bytes, so that every window is in one part."""
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SLICE_BYTES):
            yield i, a, t[a:a + SLICE_BYTES + length - 1]


def find_segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_stretches([t.encode() for t in texts_of(batch.column(2))], length))
            owner, place = (np.array([p[c] for p in parts], np.int64) for c in (0, 1))
            for a, b in slices((len(p[2]) for p in parts), SLICE_BYTES):
                text, start, windows, back, anchor, segment = segments([p[2] for p in parts[a:b]], length, gram)
                own = pa.array(owner[text + a])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(own), batch.column(1).take(own), pa.array(start + place[text + a], pa.int64()), pa.array(windows, pa.int32()), pa.array(back, pa.int32()),
                    pa.array(anchor, pa.int64()), pa.array(segment, pa.int64())], ["key", "row", "start", "windows", "back", "anchor", "segment"])

    return docs.select("key", "row", "text").mapInArrow(find, SEGMENTS)


def find_cells(wanted: DataFrame, length: int) -> DataFrame:
    """``wanted(key, row, text, own)``, own the segments of a text that need a
    look, -> one row for each cell of theirs."""
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 10
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["key", "row", "begin", "n", "anchor", "core", "whole", "mass", "left", "right"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                key, row, text, own = (batch.column(c)[i].as_py() for c in range(4))
                raw = text.encode()
                for part in own:
                    a, first = part["start"] + part["back"], -part["back"]
                    last = first + part["windows"] - 1
                    for c in range(-last // CELL, -first // CELL + 1):
                        hi, lo = -CELL * c, -CELL * c - CELL + 1
                        p, q = max(lo, first), min(hi, last)
                        core = hashlib.blake2b(raw[a + hi:a + lo + length], digest_size=8, salt=c.to_bytes(4, "little")).digest()
                        whole = hashlib.blake2b(raw[a + p:a + q + length], digest_size=8, salt=(p - lo).to_bytes(4, "little")).digest()
                        rows.append((key, row, a + p, q - p + 1, part["anchor"], int.from_bytes(core, "little", signed=True), int.from_bytes(whole, "little", signed=True),
                                     part["m"], raw[a + p:a + hi], raw[a + lo + length:a + q + length]))
                    if len(rows) >= CELL_ROWS:
                        yield packed(rows)
                        rows = []
            yield packed(rows)

    return wanted.mapInArrow(cut, CELLS)


def repeated_windows(left: list[bytes], right: list[bytes], n: list[int], core: np.ndarray) -> list[np.ndarray]:
    """For each cell the flags of its windows that another cell also holds."""
    parts, begins, at = [], [], 0
    for lead, tail, c in zip(left, right, core.tolist(), strict=True):
        line = np.empty(len(lead) + len(tail) + 2, np.int32)
        line[:len(lead)] = np.frombuffer(lead, np.uint8)
        line[len(lead)] = 256 + c
        line[len(lead) + 1:-1] = np.frombuffer(tail, np.uint8)
        line[-1] = -1
        parts.append(line)
        begins.append(at)
        at += len(line)
    text = np.concatenate([*parts, np.full(CELL, -2, np.int32)])
    owner = np.repeat(np.arange(len(n)), n)
    window = np.concatenate([b + np.arange(k) for b, k in zip(begins, n, strict=True)])
    number = np.full(at + 1, -1, np.int64)
    number[window] = np.arange(len(window))
    sorted_ = number[suffix_array(text[:at + 1])]
    sorted_ = sorted_[sorted_ >= 0]
    twin = np.zeros(len(window), bool)
    for a in range(0, len(sorted_) - 1, COMPARED):
        run = sorted_[a:a + COMPARED + 1]
        rows = text[window[run][:, None] + np.arange(CELL)]
        same = (rows[1:] == rows[:-1]).all(axis=1)
        twin[run[1:][same]] = True
        twin[run[:-1][same]] = True
    return np.split(twin, np.cumsum(n)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    turn = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


RUNS = "anchor long, core long, whole long, lo int, hi int"


def _sort_block(rows: pd.DataFrame) -> pd.DataFrame:
    core = rows.groupby(["anchor", "core"], sort=False).ngroup().to_numpy()
    flags = repeated_windows(rows["left"].tolist(), rows["right"].tolist(), rows["n"].tolist(), core)
    found = [(a, c, w, lo, hi) for a, c, w, f in zip(rows["anchor"], rows["core"], rows["whole"], flags, strict=True) for lo, hi in _runs(f)]
    return pd.DataFrame(found, columns=["anchor", "core", "whole", "lo", "hi"])


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a cell as a hash of its bytes beside the core."""
    for batch in batches:
        rows: list[tuple] = []
        for anchor, core, whole, n, left, right in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            for i in range(n):
                lead = left[i:]
                digest = hashlib.blake2b(lead + right[:CELL - 1 - len(lead)], digest_size=8, salt=len(lead).to_bytes(4, "little")).digest()
                rows.append((anchor, core, whole, i, int.from_bytes(digest, "little", signed=True)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["anchor", "core", "whole", "lo", "window"])


def _repeated(cells: DataFrame) -> DataFrame:
    """Runs of windows (from ``lo`` to before ``hi``) of distinct cells that
    another cell of the same core also holds."""
    total = cells.agg(F.sum("symbols")).first()[0] or 0
    n_blocks = max(1, round(total / BLOCK))
    usual = (cells.where(F.col("all") <= BLOCK).withColumn("block", F.pmod(F.xxhash64("anchor", "core"), F.lit(n_blocks)))
             .select("block", "anchor", "core", "whole", "n", "left", "right").groupBy("block").applyInPandas(_sort_block, RUNS))
    windows = (cells.where(F.col("all") > BLOCK).select("anchor", "core", "whole", "n", "left", "right")
               .mapInArrow(_hash_windows, "anchor long, core long, whole long, lo int, window long"))
    often = durable(windows.groupBy("anchor", "core", "window").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "core", "window"))
    return usual.union(windows.join(often, ["anchor", "core", "window"]).select("anchor", "core", "whole", "lo", (F.col("lo") + 1).alias("hi")))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(key, row, text)`` -> ``key, row, lo, hi``: stretches of bytes
    that windows which occur again cover."""
    found = durable(find_segments(docs, length, gram))
    anchors = durable(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    members = durable(found.join(anchors, "anchor"))
    classes = durable(members.groupBy("anchor", "segment").agg(F.count("*").alias("m"), F.min(F.struct("key", "row", "start", "windows", "back")).alias("r")))
    copies = (members.join(durable(classes.where("m > 1").select("anchor", "segment")), ["anchor", "segment"])
              .select("key", "row", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1 + length).alias("hi")))
    contested = durable(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("anchor"))
    wanted = (classes.join(contested, "anchor").groupBy("r.key", "r.row")
              .agg(F.collect_list(F.struct("anchor", "m", "r.start", "r.windows", "r.back")).alias("own")))
    wanted = durable(wanted)
    cells = durable(find_cells(likely(docs, "row", wanted.select("row")).join(wanted, ["key", "row"]).select("key", "row", "text", "own"), length))
    distinct = durable(cells.groupBy("anchor", "core", "whole").agg(F.sum("mass").alias("mass"), F.first("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
                       .withColumn("symbols", F.length("left") + F.length("right") + 2))
    cores = durable(distinct.groupBy("anchor", "core").agg(F.count("*").alias("k"), F.min("mass").alias("least"), F.sum("symbols").alias("all")).where("k > 1 and least = 1").select("anchor", "core", "all"))
    runs = _repeated(durable(distinct.join(cores, ["anchor", "core"])))
    same = distinct.where("mass > 1").select("anchor", "core", "whole", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    single = cells.where("mass = 1")
    partial = (single.join(durable(runs.union(same)), ["anchor", "core", "whole"])
               .select("key", "row", (F.col("begin") + F.col("lo")).alias("lo"), (F.col("begin") + F.col("hi") - 1 + length).alias("hi")))
    return copies.union(partial)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> its rows and columns with ``text`` without
    the removed bytes, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte of a text's UTF-8 form is removed where a string of ``length`` bytes
    that also starts anywhere else, in the same text or another, covers it;
    strings are judged on the input. ``kept_sha256`` is that of the bytes left;
    the text may lose a character that is cut in two. A null text is empty and
    stays null; texts shorter than ``length`` lose nothing; repeated rows
    remove each other's text; an empty table gives an empty result. Columns
    with the names of the results give way to them."""
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    source = docs.select(*names).withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__row": F.xxhash64("doc_id", "text")})
    keyed = source.where("text is not null").select(F.col("__key").alias("key"), F.col("__row").alias("row"), "text")
    stretches = repeats(keyed, length, gram).groupBy(F.col("key").alias("__key"), F.col("row").alias("__row")).agg(F.collect_set(F.struct("lo", "hi")).alias("__cut"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed, spans, seals = [], [], [], [], []
            for text, own in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw, left, at, gone, n = (text or "").encode(), [], 0, 0, 0
                for lo, hi in sorted((x["lo"], x["hi"]) for x in own or ()):
                    if lo > at or n == 0:
                        left.append(raw[at:lo])
                        n += 1
                        gone += hi - lo
                    else:
                        gone += max(0, hi - at)
                    at = max(at, hi)
                left = b"".join([*left, raw[at:]])
                texts.append(None if text is None else left.decode("utf-8", "ignore"))
                sizes.append(len(raw))
                removed.append(gone)
                spans.append(n)
                seals.append(hashlib.sha256(left).hexdigest())
            columns = [batch.column(i) if i != place else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(seals, pa.string())], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    stretches = durable(stretches)
    hit = stretches.select("__row")
    joined = likely(source, "__row", hit).join(stretches, ["__key", "__row"], "left").select(*names, "__cut")
    others = likely(source, "__row", hit, keep=False).select(*names, F.lit(None).cast(stretches.schema["__cut"].dataType).alias("__cut"))
    return joined.union(others).mapInArrow(cut, schema + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string")
