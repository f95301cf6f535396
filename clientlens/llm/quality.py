"""Quality rules: word and line statistics, and the perplexity of a character
n-gram model.

The model is an interpolated modified Kneser-Ney model of order 5 over the
characters of each language, its n-grams counted by Spark over the reference documents:
all that pass the word rules and hold next to no symbols. It is kept as sorted
arrays of packed n-grams (12 bits a character, so the code of an n-gram is its
own perfect hash) beside their probabilities; every document is scored with
the model of its language, and rejected where its log perplexity a word lies
outside that language's band. A language with more n-grams than one broadcast
holds is scored with the same model in ranges of contexts, one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, prepare, slices, texts_of
from .words import SLICE_BYTES, grams, words

ORDER = 5
BITS = 12
#: Word statistics: too few words, or too large a share of repeated ones.
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A reference document has at most so many symbols for 100 words.
REFERENCE_SYMBOLS = 1
#: The band of a language: median of the log perplexity of documents that pass
#: the word rules, less and plus so many median absolute deviations.
BELOW, ABOVE = 12.0, 12.0
#: The spread counts as this much at least (a language of few or equal texts).
LEAST_SPREAD = 0.01
#: Width of the bins by which median and deviation are found.
BIN = 0.001
#: n-grams of the languages that are broadcast together: 16 bytes each.
MODEL_ROWS = 6_000_000
#: A range of contexts holds at least so many (one context has up to 4096).
RANGE_ROWS = 50_000
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 2_000_000
#: Language of documents that name none.
UNKNOWN = "und"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTED = np.ones(256, bool)  # neither white space nor a byte after a character's first
_COUNTED[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return np.diff(total[starts])


def base_statistics(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(texts)
    at, h = grams(w, 3)
    key = h ^ (w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    same = np.concatenate((key[1:] == key[:-1], [False])) if len(key) else np.empty(0, bool)
    again = same.copy()
    again[1:] |= same[:-1]
    hit = at[order[again]]
    repeated = np.zeros(len(w.hash), bool)
    for j in range(3):
        repeated[hit + j] = True
    lines = []
    for t in texts:
        full = [x for x in t.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        lines.append(len(full) - len(set(full)))
    return [np.diff(w.first), _sums(_COUNTED[w.buffer], w.text_start), _sums(_SYMBOL[w.buffer], w.text_start),
            np.array(lines, np.int64), _sums(repeated, w.first)]


def _failed(base: list[np.ndarray]) -> np.ndarray:
    return (base[0] < MIN_WORDS) | (100 * base[4] > REPEAT_PERCENT * base[0])


def _codes(text: str) -> np.ndarray:
    """12-bit codes of a text's characters, white space runs as one space.
    Characters from U+0800 on share 2048 codes."""
    points = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 2048, points, 2048 + (points * np.uint32(2654435761) >> np.uint32(21)))


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of all texts, number of n-grams of each text)."""
    parts = [_codes(t) for t in texts]
    counts = np.array([max(0, len(p) - ORDER + 1) for p in parts], np.int64)
    flat = np.concatenate([p for p in parts if len(p) >= ORDER] or [np.empty(0, np.uint32)]).astype(np.uint64)
    if not len(flat):
        return flat, counts
    n = len(flat) - ORDER + 1
    code = np.zeros(n, np.uint64)
    for j in range(ORDER):
        code = (code << np.uint64(BITS)) | flat[j:j + n]
    lengths = counts[counts > 0]
    firsts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    inside = np.zeros(n + ORDER, np.int32)
    np.add.at(inside, firsts, 1)
    np.add.at(inside, np.minimum(firsts + lengths, n + ORDER - 1), -1)
    return code[np.cumsum(inside)[:n] > 0], counts


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    if counts is None:
        keys = np.sort(keys)
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return keys[edges], np.diff(np.append(edges, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[edges], np.add.reduceat(counts, edges)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``docs(text, lang)`` -> ``lang, gram, n``: all n-grams of all reference
    documents. A task adds up what it reads before anything is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def added(lang: str) -> tuple[np.ndarray, np.ndarray]:
            parts = held[lang]
            held[lang] = [_tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            return held[lang][0]

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                keys, counts = added(lang)
                for a in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[a:a + 100_000]), pa.string()), pa.array(keys[a:a + 100_000].astype(np.int64)), pa.array(counts[a:a + 100_000].astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, by_lang = texts_of(batch.column(0)), {}
            langs = batch.column(1).to_pylist()
            raw = [t.encode("utf-8", "replace") for t in texts]
            for a, b in slices(map(len, raw), SLICE_BYTES):
                base = base_statistics(raw[a:b])
                for i in np.flatnonzero(~_failed(base) & (100 * base[2] <= REFERENCE_SYMBOLS * base[0])).tolist():
                    by_lang.setdefault(langs[a + i], []).append(texts[a + i])
            for lang, own in by_lang.items():
                for a, b in slices(map(len, own), SLICE_BYTES):
                    keys, counts = _tally(_packed(own[a:b])[0])
                    if len(keys):
                        held.setdefault(lang, []).append((keys, counts))
                        if len(held[lang]) > 16:
                            added(lang)
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                yield from out()
        yield from out()

    rows = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return _discount_table(*(int((n == i).sum()) for i in (1, 2, 3, 4)))[np.minimum(n, 3)]


def _discount_table(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of the counts 0, 1, 2 and 3 or more, from the counts of
    counts; where these are too few, 0.5, 0.75 and 0.9 stand in."""
    usual = [0.5, 0.75, 0.9]
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        usual = [min(max(d, 0.05), i) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
    return np.array([0, *usual])


class Model:
    """Interpolated modified Kneser-Ney model of one language.

    For each order: the sorted packed grams beside the log probability of
    their last character, and the sorted contexts beside the log weight they
    leave to shorter ones. Lower orders count the distinct characters before a
    gram. A model of a range of contexts is given the grams of every order
    that its contexts need (``shorter``) and the whole language's discounts,
    and agrees with the whole model on them."""

    def __init__(self, grams_: np.ndarray, counts: np.ndarray, order: int,
                 shorter: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, discounts: dict[int, np.ndarray] | None = None):
        order_of = np.argsort(grams_)
        own = {order: (grams_[order_of], counts[order_of])}
        for k in range(order - 1, 0, -1):
            own[k] = _tally(*shorter[k]) if shorter else _tally(own[k + 1][0] & np.uint64((1 << (BITS * k)) - 1))
        self.order, self.size = order, len(own[1][0])
        self.probability: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.weight: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lower = np.full(self.size, 1 / (self.size + 1))
        for k in range(1, order + 1):
            keys, n = own[k]
            discount = discounts[k][np.minimum(n, 3)] if discounts else _discounts(n)
            context = keys >> np.uint64(BITS)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            repeat = np.diff(np.append(first, len(keys)))
            total, left = np.add.reduceat(n, first).astype(float), np.add.reduceat(discount, first)
            if k > 1:
                lower = before[np.searchsorted(own[k - 1][0], keys & np.uint64((1 << (BITS * (k - 1))) - 1))]
            p = (n - discount) / np.repeat(total, repeat) + np.repeat(left / total, repeat) * lower
            self.probability[k] = (keys, np.log(p).astype(np.float32))
            self.weight[k] = (context[first], np.log(left / total).astype(np.float32))
            before = p

    def log_p(self, grams_: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each packed gram's last character."""
        total = np.zeros(len(grams_))
        todo = np.arange(len(grams_))
        for k in range(self.order, 0, -1):
            code = grams_[todo] & np.uint64((1 << (BITS * k)) - 1)
            keys, log_p = self.probability[k]
            place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            found = keys[place] == code
            total[todo[found]] += log_p[place[found]]
            todo, code = todo[~found], code[~found]
            if not len(todo):
                return total
            keys, left = self.weight[k]
            place = np.minimum(np.searchsorted(keys, code >> np.uint64(BITS)), len(keys) - 1)
            total[todo] += np.where(keys[place] == code >> np.uint64(BITS), left[place], 0)
        total[todo] -= np.log(self.size + 1)
        return total


def load_models(counts: DataFrame, names: list[str]) -> dict[str, Model]:
    """Models of a few languages, from their rows of ``lang, gram, n``."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int")
    t = counts.where(F.col("lang").isin(names)).select(place.alias("place"), "gram", "n").toArrow()
    place, gram, n = (t.column(c).to_numpy() for c in range(3))
    return {name: Model(gram[place == i].astype(np.uint64), n[place == i], ORDER) for i, name in enumerate(names, 1)}


def statistics(docs: DataFrame, models: Broadcast) -> DataFrame:
    """Base statistics of documents, and the log perplexity a word where their
    language has a model. Columns of ``docs`` after the third (longs) are
    passed on."""
    more = docs.columns[3:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = texts_of(batch.column(1)), batch.column(2).to_pylist()
            raw = [t.encode("utf-8", "replace") for t in texts]
            for a, b in slices(map(len, raw), SLICE_BYTES):
                base = base_statistics(raw[a:b])
                mean = np.full(b - a, np.nan)
                for lang in set(langs[a:b]) & models.value.keys():
                    rows = [i for i in range(a, b) if langs[i] == lang]
                    codes, counts = _packed([texts[i] for i in rows])
                    sums = _sums(models.value[lang].log_p(codes), np.concatenate(([0], np.cumsum(counts))))
                    n_words = base[0][np.array(rows) - a]
                    mean[np.array(rows) - a] = np.where((counts > 0) & (n_words > 0), -sums / np.maximum(n_words, 1), np.nan)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(x, pa.int64()) for x in base),
                    pa.array(mean, pa.float64(), mask=np.isnan(mean)), *(batch.column(3 + i).slice(a, b - a) for i in range(len(more)))],
                    ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", *more])

    return docs.mapInArrow(score, f"doc_id long, lang string, {BASE}, log_perplexity double" + "".join(f", {c} long" for c in more))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bands(scores: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """``lang, low, high``: from the histogram of each language's documents."""
    def median(rows: DataFrame) -> DataFrame:
        histogram = rows.groupBy("lang", F.round(F.col("x") / BIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
        bins = histogram.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
        half = F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + x["n"]) / 2
        step = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("bin")),
                           lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.when(s["bin"].isNull() & (s["sum"] + x["n"] >= half), x["bin"]).otherwise(s["bin"]).alias("bin")))
        return bins.select("lang", (step["bin"] * BIN).alias("middle"))

    known = scores.where("log_perplexity is not null").where(~_base_failed())
    middle = median(known.select("lang", F.col("log_perplexity").alias("x")))
    spread = median(known.join(F.broadcast(middle), "lang").select("lang", F.abs(F.col("log_perplexity") - F.col("middle")).alias("x"))).withColumnRenamed("middle", "spread")
    width = F.greatest("spread", F.lit(LEAST_SPREAD))
    return middle.join(spread, "lang").select("lang", (F.col("middle") - below * width).alias("low"), (F.col("middle") + above * width).alias("high"))


def _backwards(grams_: np.ndarray) -> np.ndarray:
    """The context of each packed 5-gram, its last character first."""
    context = grams_ >> np.uint64(BITS)
    out = np.zeros(len(grams_), np.uint64)
    for _ in range(ORDER - 1):
        out = (out << np.uint64(BITS)) | (context & np.uint64((1 << BITS) - 1))
        context = context >> np.uint64(BITS)
    return out


def _all_orders(counts: DataFrame) -> DataFrame:
    """``lang, gram, n`` of 5-grams -> ``lang, k, gram, n, first``: grams of
    every order, and the first backwards context that has theirs at its start."""
    orders = [counts.select("lang", F.lit(ORDER).alias("k"), "gram", "n")]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        orders.append(durable(orders[-1].groupBy("lang", F.lit(k).alias("k"), shorter.alias("gram")).agg(F.count("*").alias("n"))))
    first = F.lit(0).cast("long")
    for i in range(ORDER - 1):
        first = first.bitwiseOR(F.shiftleft(F.shiftright("gram", BITS * (i + 1)).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * (ORDER - 2 - i)))
    whole = orders[0]
    for part in orders[1:]:
        whole = whole.union(part)
    return whole.withColumn("first", first)


def _load_range(whole: DataFrame, low: int, high: int, discounts: dict[int, np.ndarray]) -> Model:
    """The model of the contexts from ``low`` to before ``high``, from one
    language's rows of :func:`_all_orders`."""
    span = F.expr(f"shiftleft(1L, {BITS} * ({ORDER} - k))")
    t = whole.where((F.col("first") < high) & (F.col("first") + span > low)).select("k", "gram", "n").toArrow()
    k, gram, n = (t.column(c).to_numpy() for c in range(3))
    own = {i: (gram[k == i].astype(np.uint64), n[k == i]) for i in range(1, ORDER + 1)}
    return Model(*own[ORDER], ORDER, own, discounts)


def _range_sums(docs: DataFrame, model: Broadcast, low: int, high: int) -> DataFrame:
    """``docs(text, k1, k2)`` -> ``k1, k2, total``: for each document with a
    5-gram, the sum of log probabilities of those whose context is in a range."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(map(len, texts), SLICE_BYTES):
                codes, counts = _packed(texts[a:b])
                at = _backwards(codes)
                inside = (at >= np.uint64(low)) & (at < np.uint64(high))
                log_p = np.zeros(len(codes))
                log_p[inside] = model.value.log_p(codes[inside])
                rows = np.flatnonzero(counts > 0)
                keys = (batch.column(c).slice(a, b - a).take(pa.array(rows)) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(_sums(log_p, np.concatenate(([0], np.cumsum(counts))))[rows], pa.float64())], ["k1", "k2", "total"])

    return docs.mapInArrow(score, "k1 long, k2 long, total double")


def _in_ranges(docs: DataFrame, counts: DataFrame, sizes: dict[str, int], rows: int) -> DataFrame:
    """:func:`statistics` of the languages in ``sizes``, whose models are too
    large for one broadcast: ranges of about ``rows`` 5-grams are broadcast one
    after the other, and a document's sums are added up by the hash of its text
    (equal texts have equal sums)."""
    spark = docs.sparkSession
    whole = _all_orders(counts.where(F.col("lang").isin(list(sizes))))
    few = whole.where("n <= 4").groupBy("lang", "k", "n").count().collect()
    seen = {(r["lang"], r["k"], r["n"]): r["count"] for r in few}
    keyed = docs.where(F.col("lang").isin(list(sizes))).select("doc_id", "text", "lang", F.xxhash64("lang", "text").alias("k1"), F.xxhash64(F.lit(1), "lang", "text").alias("k2"))
    sums = None
    for lang, size in sorted(sizes.items()):
        n = -(-11 * size // (10 * rows))
        discounts = {k: _discount_table(*(seen.get((lang, k, i), 0) for i in (1, 2, 3, 4))) for k in range(1, ORDER + 1)}
        own = whole.where(F.col("lang") == lang)
        cuts = own.where(F.col("k") == ORDER).select(F.col("first").cast("double").alias("first")).approxQuantile("first", [i / n for i in range(1, n)], 0.02 / n)
        edges = [0, *sorted({int(c) for c in cuts} - {0}), 1 << (BITS * (ORDER - 1))]
        texts = keyed.where(F.col("lang") == lang).select("text", "k1", "k2")
        parts = None
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            shared = spark.sparkContext.broadcast(_load_range(own, low, high, discounts))
            part = durable(_range_sums(texts, shared, low, high))
            shared.destroy()
            parts = part if parts is None else parts.union(part)
        # a copy of a text has one row for each range
        total = parts.groupBy("k1", "k2").agg((F.avg("total") * (len(edges) - 1)).alias("total"))
        sums = total if sums is None else sums.union(total)
    base = statistics(keyed, spark.sparkContext.broadcast({})).drop("log_perplexity")
    return base.join(sums, ["k1", "k2"], "left").select(
        "doc_id", "lang", *(c.split()[0] for c in BASE.split(", ")), F.when(F.col("n_words") > 0, -F.col("total") / F.col("n_words")).alias("log_perplexity"))


def quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang,
    log_perplexity, low, high``.

    One row per input row. ``base_failed``: fewer than 50 words, or more than
    half of them in 3-word windows that the text repeats. ``kept``: not so,
    and a log perplexity a word inside the band of the document's language
    (``und`` for a null one, with a model of its own); without a 5-gram, or
    where no reference document has the language, the perplexity is null and
    the word rules alone decide. A null text is empty. Models of languages
    beyond ``model_rows`` n-grams are broadcast in turn, and that of one
    language with more in ranges of its contexts, so a broadcast holds about so
    many whatever the input; the order is 5 at any size."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    counts = durable(count_ngrams(docs))
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    large = {lang: size for lang, size in sizes.items() if size > max(model_rows, RANGE_ROWS)}
    blocks: list[list[str]] = [[]]
    held = 0
    for lang, size in sorted(sizes.items()):
        if lang in large:
            continue
        if blocks[-1] and held + size > model_rows:
            blocks.append([])
            held = 0
        blocks[-1].append(lang)
        held += size
    scores = _in_ranges(docs, counts, large, max(model_rows, RANGE_ROWS)) if large else None
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(load_models(counts, block) if block else {})
        others = [x for x in sizes if x not in block]  # the first block also takes languages without a model
        own = docs.where(~F.col("lang").isin(others)) if k == 0 and others else docs if k == 0 else docs.where(F.col("lang").isin(block))
        part = statistics(own, shared)
        scores = part if scores is None else scores.union(part)
    scores = durable(scores)
    failed = _base_failed()
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return (scores.join(F.broadcast(bands(scores, below, above)), "lang", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & inside).alias("kept"), "lang", "log_perplexity", "low", "high"))
