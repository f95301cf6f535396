"""Text quality learned from trusted positives and unlabelled text.

Each text becomes a few numbers about its shape (lengths, signs, capitals,
repeats), each number its place among fixed knots, and a linear model of these
gives log odds ``g``. The model minimises the non-negative unbiased risk

    prior * E_pos[l(g)] + max(0, E_all[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss ``l``: no text is ever taken for a negative, the risk
of negatives is what all texts have beyond the positives' share. Where that
estimate falls below 0, steps go back up on it instead of further down. The
prior comes from a model of positives against all texts: of the thresholds of
its score, the one that bounds best how much more often all texts pass it than
positives that the model was not fitted to. Sums of all passes are added up in
Spark; a pass reads a narrow table of numbers, texts are read once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, prepare, slices, table_of, texts_of
from .vectors import gathered
from .words import SLICE_BYTES, Prefix, Words, grams, words

KNOTS = 9
#: Newton steps of either model at most, and the weight of its size.
STEPS, RIDGE = 12, 1e-4
#: A step back on the negatives' risk is so long beside a usual one.
BACK = 0.5
#: Bins of scores for the prior, and its confidence (1 - DELTA).
BINS, DELTA = 1000, 0.1
#: One positive in so many is kept from the model that the prior is taken from.
PRIOR_SHARE = 4
THRESHOLD = 0.3

_SIGNS, _LOUD, _STOPS, _COMMAS, _CAPITALS, _SMALL, _DIGITS, _WIDE = range(8)
_CLASS = np.full(256, 255, np.uint8)
for _k, _bytes in ((_SIGNS, b"#$%&*+/<=>@[\\]^_`{|}~"), (_LOUD, b"!?"), (_STOPS, b"."), (_COMMAS, b",;:"), (_CAPITALS, bytes(range(65, 91))), (_SMALL, bytes(range(97, 123))),
                   (_DIGITS, b"0123456789"), (_WIDE, bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _k


def _repeated(w: Words, k: int, n: int) -> np.ndarray:
    """Words of each text in k-word windows that it holds twice or more."""
    at, h = grams(w, k)
    if not len(at):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, w.doc[at]))
    doc, h = w.doc[at][order], h[order]
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    twice = at[order][np.append(same, False) | np.append(False, same)]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=n)


def shape(texts: list[bytes]) -> np.ndarray:
    """Numbers between 0 and 1 about each text, in single precision."""
    n, w = len(texts), words(texts)
    count = np.diff(w.first).astype(np.float64)
    some = np.maximum(count, 1)
    kind = _CLASS[w.buffer]
    held = np.empty((8, n))
    for k in range(8):
        sums = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=sums[1:])
        held[k] = np.diff(sums[w.text_start])
    size = w.end - w.start
    held_bytes = np.bincount(w.doc, weights=size, minlength=n)
    total = np.maximum(held_bytes, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, size)
    short = np.bincount(w.doc, weights=size <= 3, minlength=n)
    again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    first = np.flatnonzero(new)
    distinct = np.bincount(w.doc[order][first], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, w.doc[order][first], np.diff(np.append(first, len(order))))
    end = np.flatnonzero(w.buffer == 10)
    start = np.append(0, end[:-1] + 1)
    line = np.searchsorted(start, w.start, side="right") - 1
    used, inside = np.unique(line, return_counts=True)
    owner = np.searchsorted(w.text_start, start[used], side="right") - 1
    same = np.lexsort((used, Prefix(w.buffer).of(start[used], end[used]), owner))
    h = Prefix(w.buffer).of(start[used], end[used])[same]
    later = np.zeros(len(used), bool)
    later[1:] = (h[1:] == h[:-1]) & (owner[same][1:] == owner[same][:-1])
    doubled = np.bincount(owner[same], weights=inside[same] * later, minlength=n)
    lines = np.maximum(np.bincount(owner, minlength=n), 1)
    letters = np.maximum(held[_CAPITALS] + held[_SMALL], 1)
    root = lambda x: np.sqrt(np.clip(x, 0, 1))
    log = lambda x, top: np.clip(np.log2(1 + x) / top, 0, 1)
    return np.stack([
        log(count, 16), log(held_bytes / some, 8), log(longest, 12), log(count / lines, 12), root(short / some), root(held[_SIGNS] / total), root(held[_LOUD] / some), root(held[_STOPS] / some),
        root(held[_COMMAS] / some), root(held[_CAPITALS] / letters), root(held[_DIGITS] / total), root(held[_WIDE] / total), root(again / some), root(_repeated(w, 3, n) / some),
        root(_repeated(w, 8, n) / some), distinct / some, root(most / some), root(doubled / some)], axis=1).astype(np.float32)


SHAPES = 18
WIDTH = SHAPES * KNOTS + 1


def spread_out(numbers: np.ndarray) -> np.ndarray:
    """Each number as its shares of the two knots around it, and a constant."""
    at = numbers.astype(np.float64) * (KNOTS - 1)
    low = np.minimum(at.astype(np.int64), KNOTS - 2)
    out = np.zeros((len(numbers), WIDTH))
    rows, base = np.arange(len(numbers))[:, None], np.arange(SHAPES) * KNOTS
    out[rows, base + low] = 1 - (at - low)
    out[rows, base + low + 1] = at - low
    out[:, -1] = 1
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), SHAPES)


def _loss(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -g)


def _odds(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


@dataclass
class Sums:
    """Means over the positives (one row) and all texts (the other): number,
    losses l(g) and l(-g), sums of x, of x by the odds, and the curvature."""

    n: np.ndarray
    right: np.ndarray
    wrong: np.ndarray
    x: np.ndarray
    slope: np.ndarray
    curve: np.ndarray


_HEAD = 3


def _pass(train: DataFrame, which: Callable[[DataFrame], DataFrame], model: np.ndarray) -> Sums:
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, WIDTH + 3, WIDTH))
        for batch in gathered(batches):
            x = spread_out(_numbers(batch.column(0)))
            g = x @ shared.value
            odds, positive = _odds(g), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for k, rows in enumerate((positive, slice(None))):
                own, o = x[rows], odds[rows]
                table[k, 0, :_HEAD] += len(own), _loss(g[rows]).sum(), _loss(-g[rows]).sum()
                table[k, 1] += own.sum(axis=0)
                table[k, 2] += o @ own
                table[k, 3:] += (own * (o * (1 - o))[:, None]).T @ own
        flat = table.reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["at", "v"])

    rows = (which(train).select("x", "positive").mapInArrow(run, "at int, v array<double>").groupBy("at").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect())
    table = np.zeros((2 * (WIDTH + 3), WIDTH))
    for r in rows:
        table[r.at] = r.v.toArray()
    table = table.reshape(2, WIDTH + 3, WIDTH)
    n = np.maximum(table[:, 0, 0], 1)
    means = table / n[:, None, None]
    return Sums(table[:, 0, 0], means[:, 0, 1], means[:, 0, 2], means[:, 1], means[:, 2], means[:, 3:])


def _step(gradient: np.ndarray, curve: np.ndarray, model: np.ndarray) -> np.ndarray:
    return -np.linalg.solve(curve + RIDGE * np.eye(WIDTH), gradient + RIDGE * model)


def _fit(sums_of: Callable[[np.ndarray], Sums], risk: Callable[[Sums], tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Newton steps, halved where they would raise the risk, to the model with
    the smallest risk that was met."""
    model, step = np.zeros(WIDTH), np.zeros(WIDTH)
    best, least = model, np.inf
    for _ in range(STEPS):
        value, gradient, curve = risk(sums_of(model + step))
        value += RIDGE / 2 * float((model + step) @ (model + step))
        if value > least + 1e-9 and np.abs(step).max() > 1e-3:
            step = step / 2
            continue
        done = least - value < 1e-6
        if value <= least:
            best, least = model + step, value
        model = model + step
        if done:
            break
        step = _step(gradient, curve, model)
    return best


def against_all(s: Sums) -> tuple[float, np.ndarray, np.ndarray]:
    """Risk of telling positives from all texts."""
    return s.right[0] + s.wrong[1], s.slope[0] - s.x[0] + s.slope[1], s.curve[0] + s.curve[1]


def non_negative(prior: float) -> Callable[[Sums], tuple[float, np.ndarray, np.ndarray]]:
    """The non-negative unbiased risk, the gradient of its step, a curvature."""
    def risk(s: Sums) -> tuple[float, np.ndarray, np.ndarray]:
        negatives = s.wrong[1] - prior * s.wrong[0]
        of_positives, of_negatives = prior * (s.slope[0] - s.x[0]), s.slope[1] - prior * s.slope[0]
        value = prior * s.right[0] + max(0.0, negatives)
        gradient = of_positives + of_negatives if negatives >= 0 else -BACK * of_negatives
        return value, gradient, s.curve[1]
    return risk


def class_prior(positive: np.ndarray, every: np.ndarray) -> float:
    """Share of positives among all texts, from the numbers of kept-back
    positives and of all texts in bins of rising score."""
    n_p, n_u = int(positive.sum()), int(every.sum())
    if not n_p or not n_u:
        return 0.5
    pass_p, pass_u = positive[::-1].cumsum() / n_p, every[::-1].cumsum() / n_u
    doubt = np.sqrt(np.log(4 / DELTA) / 2 / n_p) + np.sqrt(np.log(4 / DELTA) / 2 / n_u)
    some = pass_p > 0
    ratio = pass_u[some] / pass_p[some]
    at = int(np.argmin(ratio + doubt / pass_p[some]))
    return float(np.clip(ratio[at], 0.01, 0.99))


def _histogram(train: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BINS), np.int64)
        for batch in gathered(batches):
            at = np.minimum((_odds(spread_out(_numbers(batch.column(0))) @ shared.value) * BINS).astype(np.int64), BINS - 1)
            kept = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            held[0] += np.bincount(at[kept], minlength=BINS)
            held[1] += np.bincount(at, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS), pa.int32()), pa.array(held[0]), pa.array(held[1])], ["at", "p", "u"])

    rows = train.select("x", F.expr("positive and kept_back").alias("kept")).mapInArrow(run, "at int, p long, u long").groupBy("at").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect()
    p, u = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for r in rows:
        p[r.at], u[r.at] = r.p, r.u
    return p, u


def held_out(doc_id: Column) -> Column:
    """A fifth of all documents, by id, and those without one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shapes_of(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, x`` (packed numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "replace") for t in texts_of(batch.column(2))]
            out: list[bytes] = []
            for a, b in slices(map(len, raw), SLICE_BYTES):
                out += [row.tobytes() for row in shape(raw[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "held_out", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, x binary")


def train_model(train: DataFrame) -> tuple[np.ndarray, float]:
    """``train(x, positive, kept_back)`` -> (model, class prior)."""
    rough = _fit(lambda m: _pass(train, lambda t: t.where("not (positive and kept_back)"), m), against_all)
    prior = class_prior(*_histogram(train, rough))
    return _fit(lambda m: _pass(train, lambda t: t, m), non_negative(prior)), prior


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` -> ``doc_id,
    held_out, score, predicted``, one row for each of ``docs``.

    Learns from the documents that are not held out (a fifth by id is, as is
    every one with a null id): positives are those with a label of 1 (and none
    of 0, where labels of one id differ), all of them are the unlabelled text;
    labels of 0 are not used. Texts count whole, null as empty; null labels
    and those of ids that ``docs`` lacks are not read, repeated documents
    count as often as they occur. Without any positive every score is 0.5.
    ``predicted`` is 1 from a score of 0.3 on. The passes cover all rows."""
    spark = docs.sparkSession
    prepare(spark)
    numbers = table_of(shapes_of(docs)).rows
    good = (labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"))
            .where("__q = 1").select("__id"))
    learned = numbers.where("not held_out")
    train = table_of(learned.join(good, learned["doc_id"] == good["__id"], "left").select(
        "x", F.col("__id").isNotNull().alias("positive"), (F.pmod(F.xxhash64("doc_id"), F.lit(PRIOR_SHARE)) == 0).alias("kept_back")))
    if train.rows.where("positive").limit(1).count():
        model, _ = train_model(train.rows)
    else:
        model = np.zeros(WIDTH)
    drop_table(spark, train.path)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            score = _odds(spread_out(_numbers(batch.column(2))) @ shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbers.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
