"""Two-tier lookup of what a byte-level BPE tokenizer makes of a text.

Pre-tokens never cross white space and are encoded independently, so the ids
of a text are those of its white-space chunks one after the other, and those
of a chunk are those of its pre-tokens. Tier one is a broadcast table of the
frequent pre-tokens; tier two is a cache in each Python worker, filled by the
tokenizer itself on a miss. Pre-tokens are never shuffled.

The only rules restated here are the split of a chunk into pre-tokens, and
only for characters below U+0180 (composed, no combining marks). Any other
chunk, and any chunk that may hold a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .words import words

#: Fixed value: the split pattern of the word-end BPE vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN = regex.compile(SPLIT)
#: str.split() takes these four for white space, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[ \t\n\r\x0b\x0c]+")
#: Characters outside the range for which the split is restated.
_OTHER = re.compile("[^\x00-įı-ſ]")

LONGEST_CACHED = 64
CACHE_ENTRIES = 400_000


def chunks(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [c for c in _SPACES.split(text) if c]
    return text.split()


def split_chunk(chunk: str) -> list[str] | None:
    """Pre-tokens of a chunk, or None where the library has to be asked."""
    if "<|" in chunk or len(chunk) > LONGEST_CACHED or _SEPARATORS.search(chunk):
        return None
    if chunk.isascii():
        return _ASCII.findall(chunk.lower())
    if _OTHER.search(chunk):
        return None
    return _LATIN.findall(chunk.lower())


class Lookup(dict):
    """chunk -> value of its ids. ``of_ids`` makes a value from ids, ``join``
    one value from several; ``frequent`` is the broadcast first tier."""

    def __init__(self, tokenizer, frequent: dict, of_ids: Callable, join: Callable):
        super().__init__()
        self.tokenizer, self.frequent, self.of_ids, self.join = tokenizer, frequent, of_ids, join
        self.rare: dict = {}

    def encode(self, text: str):
        return self.of_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pretoken(self, token: str):
        value = self.frequent.get(token)
        if value is None and (value := self.rare.get(token)) is None:
            value = self.rare[token] = self.encode(token)
        return value

    def learn(self, tokens: list[str]) -> None:
        """Encodes the pre-tokens that are not known yet, all in one call."""
        new = [t for t in dict.fromkeys(tokens) if t not in self.frequent and t not in self.rare]
        for token, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.rare[token] = self.of_ids(found.ids)

    def __missing__(self, chunk: str):
        parts = split_chunk(chunk)
        if parts is None:
            value = self.encode(chunk)
            if len(chunk) > LONGEST_CACHED:
                return value
        else:
            value = self.join(map(self.pretoken, parts))
        self[chunk] = value
        return value

    def text(self, text: str):
        value = self.join(map(self.__getitem__, chunks(text)))
        if len(self) > CACHE_ENTRIES:
            self.clear()
        if len(self.rare) > CACHE_ENTRIES:
            self.rare.clear()
        return value


def read_tokenizer(path: str) -> str:
    """The tokenizer's own file, to be broadcast (1.7 MB, whatever the input)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _load(json_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run beside each other already
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def frequent_pretokens(docs: DataFrame, size: int, per_task: int) -> list[str]:
    """The ``size`` most frequent pre-tokens by the tasks' summaries.

    Every task counts the pre-tokens of all its texts and passes on its
    ``per_task`` most frequent ones, so what is shuffled and collected is
    bounded by tasks x ``per_task`` and by ``size``. The table only decides
    which encodings are looked up first; results do not depend on it."""
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            counts: Counter = Counter()
            for text in texts_of(batch.column(0)):
                counts.update(chunks(text))
            for chunk, n in counts.items():
                for token in split_chunk(chunk) or ():
                    seen[token] += n
            while len(seen) > 8 * per_task:  # the rarest go, as in lossy counting
                least = np.partition(np.fromiter(seen.values(), np.int64), 4 * per_task)[4 * per_task]
                seen = Counter({t: n for t, n in seen.items() if n > least})
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    rows = (docs.select("text").mapInArrow(summarize, "token string, n long")
            .groupBy("token").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "token").limit(size).select("token").collect())
    return [r.token for r in rows]


def broadcast_table(docs: DataFrame, tokenizer_json: str, size: int, per_task: int) -> Broadcast:
    """The frequent pre-tokens as one text beside an array of their lengths."""
    tokens = frequent_pretokens(docs, size, per_task)
    lengths = np.array([len(e.ids) for e in _load(tokenizer_json).encode_batch(tokens, add_special_tokens=False)] if tokens else [], np.uint16)
    return docs.sparkSession.sparkContext.broadcast((tokenizer_json, "\n".join(tokens), lengths))


_WORKER: dict = {}


def length_lookup(shared: Broadcast) -> Lookup:
    """One lookup for each worker process, tokenizer and table."""
    json_text, joined, lengths = shared.value
    key = ("lengths", hash(json_text), hash(joined))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lookup(_load(json_text), dict(zip(joined.split("\n") if joined else [], lengths.tolist(), strict=True)), len, sum)
    return _WORKER[key]


class IdLookup:
    """Ids of whole texts, a slice of texts at a time: chunks are found by
    their 64-bit hash in sorted arrays, and only new ones are looked at one by
    one. The arrays are this worker's cache, dropped when they grow large."""

    MAIN, RECENT, IDS = 1_000_000, 100_000, 6_000_000

    def __init__(self, json_text: str):
        self.chunks = Lookup(_load(json_text), {}, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)
        self._reset()

    def _reset(self) -> None:
        self.tiers = [[np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)] for _ in range(2)]
        self.ids = np.empty(1 << 16, np.uint32)  # grows by doubling; the first n_ids are in use
        self.n_ids = 0

    def _keep(self, ids: np.ndarray) -> None:
        if self.n_ids + len(ids) > len(self.ids):
            larger = np.empty(max(2 * len(self.ids), self.n_ids + len(ids)), np.uint32)
            larger[:self.n_ids] = self.ids[:self.n_ids]
            self.ids = larger
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "surrogatepass") for c in raw]
        parts = [split_chunk(t) for t in texts]
        self.chunks.learn([t for own in parts if own for t in own])
        known = self.chunks.rare
        return [self.chunks.encode(t) if own is None else known[own[0]] if len(own) == 1 else b"".join([known[x] for x in own]) for t, own in zip(texts, parts, strict=True)]

    def _find(self, hashes: np.ndarray, start: np.ndarray, length: np.ndarray, todo: np.ndarray, tier: list) -> np.ndarray:
        keys, starts, lengths = tier
        if not len(keys) or not len(todo):
            return todo
        place = np.minimum(np.searchsorted(keys, hashes[todo]), len(keys) - 1)
        hit = keys[place] == hashes[todo]
        start[todo[hit]], length[todo[hit]] = starts[place[hit]], lengths[place[hit]]
        return todo[~hit]

    @staticmethod
    def _merged(*tiers: list) -> list:
        keys, starts, lengths = (np.concatenate(x) for x in zip(*tiers, strict=True))
        order = np.argsort(keys)
        return [keys[order], starts[order], lengths[order]]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.n_ids > self.IDS or len(self.tiers[0][0]) > self.MAIN:
            self._reset()
        if len(self.chunks.rare) > CACHE_ENTRIES // 2:
            self.chunks.rare.clear()
        w = words(texts)
        start, length = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.int64)
        todo = np.arange(len(w.hash))
        for tier in self.tiers:
            todo = self._find(w.hash, start, length, todo, tier)
        if len(todo):
            new, first = np.unique(w.hash[todo], return_index=True)
            raw = w.buffer.tobytes()
            found = self._encode([raw[a:b] for a, b in zip(w.start[todo[first]].tolist(), w.end[todo[first]].tolist(), strict=True)])
            lengths = np.array([len(x) // 4 for x in found], np.int64)
            fresh = [new, (self.n_ids + np.cumsum(lengths) - lengths).astype(np.int32), lengths.astype(np.int32)]
            self._keep(np.frombuffer(b"".join(found), np.uint32))
            self._find(w.hash, start, length, todo, fresh)
            self.tiers[1] = self._merged(self.tiers[1], fresh)
            if len(self.tiers[1][0]) > self.RECENT:
                self.tiers = [self._merged(*self.tiers), [x[:0] for x in self.tiers[1]]]
        before = np.cumsum(length) - length
        out = self.ids[np.repeat(start - before, length) + np.arange(int(length.sum()))]
        cuts = np.append(before, length.sum())[w.first]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def id_lookup(tokenizer_json: Broadcast) -> IdLookup:
    """One lookup for each worker process and tokenizer."""
    key = ("ids", hash(tokenizer_json.value))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = IdLookup(tokenizer_json.value)
    return _WORKER[key]
