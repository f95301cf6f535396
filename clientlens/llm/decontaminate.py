"""Benchmark passages in documents by greedy string tiling.

Words of a document that open an ``least``-word run of a benchmark text are
seeds. Where the seeds of a text could cover enough of it, the two are tiled:
the longest common runs of words that no tile covers yet become tiles, from
long to short, found by Karp-Rabin hashes of windows of a falling length. The
share of the text that tiles cover does not depend on their order in the
document, so passages that were moved about are caught."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, texts_of, without
from .words import SLICE_BYTES, grams, words

#: Words of the shortest tile, and the share of a benchmark text under tiles
#: from which a document counts as holding it.
LEAST, SHARE = 4, 0.5
#: Benchmark texts that are broadcast together; more are taken in turn.
BLOCK_ITEMS = 20_000

_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_MARKS = [m.encode() for m in "“”„‘’‚«»‹›¿¡…–—·"]


def plain(text: str) -> bytes:
    """Lower case, punctuation as space."""
    raw = text.lower().encode().translate(_TABLE)
    if not raw.isascii():
        for mark in _MARKS:
            raw = raw.replace(mark, b" ")
    return raw


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _windows(ids: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(place, rolling hash) of every window of s words that no tile covers."""
    lead = pow(_BASE, s, _PRIME)
    value = run = 0
    for i, x in enumerate(ids):
        if not free[i]:
            value = run = 0
            continue
        value = (value * _BASE + x) % _PRIME
        run += 1
        if run > s:
            value = (value - ids[i - s] * lead) % _PRIME
        if run >= s:
            yield i - s + 1, value


def tiles(text: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``item`` with runs of ``text``: (place in the text,
    place in the item, words), none overlapping another on either side."""
    free_t, free_i = [True] * len(text), [True] * len(item)
    found: list[tuple[int, int, int]] = []
    s = max(least, len(item))
    while True:
        places = defaultdict(list)
        for p, value in _windows(text, free_t, s):
            places[value].append(p)
        matches = []
        for q, value in _windows(item, free_i, s):
            for p in places.get(value, ()):
                n = 0
                while p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and free_t[p + n] and free_i[q + n]:
                    n += 1
                if n >= s:
                    matches.append((-n, p, q))
        for n, p, q in sorted(matches):
            n = -n
            if all(free_t[p:p + n]) and all(free_i[q:q + n]):
                found.append((p, q, n))
                free_t[p:p + n] = [False] * n
                free_i[q:q + n] = [False] * n
        if s <= least:
            return found
        s = max(least, s // 2)


class Benchmark:
    """Word hashes of a block of benchmark texts and where their seeds are."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.ids = [i for i, _ in rows]
        w = words([plain(t) for _, t in rows])
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.diff(w.first)
        for k in sorted(set(np.minimum(sizes[sizes > 0], least).tolist())):
            at, h = grams(w, k)
            use = np.minimum(sizes, least)[w.doc[at]] == k
            at, h = at[use], h[use]
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], w.doc[at[order]], (at - w.first[w.doc[at]])[order])


def _find(texts: list[bytes], benchmark: Benchmark, least: int, share: float) -> Iterator[tuple]:
    w = words(texts)
    covered: dict[tuple[int, int], set] = defaultdict(set)
    for k, (keys, items, places) in benchmark.seeds.items():
        at, h = grams(w, k)
        lo = np.searchsorted(keys, h)
        hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
        hi = np.searchsorted(keys, h[hit], side="right")
        for doc, a, b in zip(w.doc[at[hit]].tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
            for item, place in zip(items[a:b].tolist(), places[a:b].tolist(), strict=True):
                covered[doc, item].update(range(place, place + k))
    for (doc, item), places in covered.items():
        own = benchmark.words[item]
        if len(places) < share * len(own):
            continue
        text = w.hash[w.first[doc]:w.first[doc + 1]]
        near = np.isin(text, own)  # words in no window of the item split the text as well as any other
        ids = np.where(near, text >> np.uint64(4), np.uint64(0)).astype(np.int64).tolist()
        found = tiles(ids, (own >> np.uint64(4)).astype(np.int64).tolist(), min(least, len(own)))
        n = sum(t[2] for t in found)
        if n >= share * len(own):
            yield doc, benchmark.ids[item], len(own), n, n / len(own), len(found), max(t[2] for t in found)


RESULT = "doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles long, longest_tile long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE,
                 block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)`` -> one
    row for each document and benchmark text of which tiles cover ``share`` or
    more: ``doc_id, item_id, item_words, covered, coverage, n_tiles,
    longest_tile``.

    Case and punctuation do not count. Texts of fewer than ``least`` words are
    tiled by runs of their own length; null texts and texts without words are
    never found; repeated rows are reported each; empty tables give no rows.
    The benchmark is broadcast ``block_items`` texts at a time, so each further
    block is one more pass over the documents."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select("item_id", "text").where("text is not null")
    n_blocks = max(1, -(-items.count() // block_items))
    result = None
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in rows], least))
        part = _pass(docs, shared, least, share)
        result = part if result is None else result.union(part)
    return result


def _pass(docs: DataFrame, shared: Broadcast, least: int, share: float) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [plain(t) for t in texts_of(batch.column(1))]
            rows = [(ids[a + r[0]], *r[1:]) for a, b in slices(map(len, texts), SLICE_BYTES) for r in _find(texts[a:b], shared.value, least, share)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.float64() if c == 4 else pa.int64() for c in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(look, RESULT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text; a null doc_id stays."""
    return without(docs, "doc_id", contaminated(docs, benchmark, least, share).select("doc_id"))
