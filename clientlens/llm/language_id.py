"""Language of texts by hyperdimensional profiles of their letters.

Every letter has a random vector of signs. A trigram is the product of its
letters' vectors, the first rotated by two places and the second by one; a
text is the sum of its trigrams, a language the sum of its learning texts at
equal weight. A text gets the language whose vector has the largest cosine
with its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, texts_of
from .words import scramble

DIMENSIONS = 1024
UNKNOWN = "und"
SLICE_CHARS = 600_000
#: Codes of trigrams that are counted in one table; beyond, by sorting.
TABLE = 1 << 22
#: Sums are kept as whole numbers, so that their order does not matter.
SCALE = float(1 << 24)

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool))
    return _LETTERS[0]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The sign vector of each character, always the same."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    bits = scramble(points.astype(np.uint64)[:, None] * np.uint64(1 << 16) + words, salt=11)
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number of each trigram, its three characters' places in the
    returned alphabet as one code, alphabet). Other characters than letters
    count as one space between words."""
    flat = np.frombuffer("\n".join([" " + t.lower() + " " for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t.lower()) + 3 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)[:len(flat)]
    letter = _is_letter()[flat]
    keep = letter | np.concatenate(([True], letter[:-1])) | np.concatenate(([True], owner[1:] != owner[:-1]))
    flat, owner = np.where(letter, flat, 32)[keep], owner[keep]
    alphabet = np.flatnonzero(np.bincount(flat, minlength=33))
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    p, n = place[flat], max(0, len(flat) - 2)
    code = (p[:n] * len(alphabet) + p[1:n + 1]) * len(alphabet) + p[2:n + 2]
    one = (owner[:n] == owner[2:n + 2]) & (flat[1:n + 1] != 32)
    return owner[:n][one], code[one], alphabet


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of each text (zero without letters)."""
    owner, code, alphabet = _trigrams(texts)
    if not len(code):
        return np.zeros((len(texts), dimensions), np.float32)
    size = len(alphabet) ** 3
    if size <= TABLE:
        seen = np.flatnonzero(np.bincount(code, minlength=size))
        place = np.zeros(size, np.int32)
        place[seen] = np.arange(len(seen))
        number = place[code]
    else:
        seen, number = np.unique(code, return_inverse=True)
    letters = _letter_vectors(alphabet, dimensions)
    a, b, c = seen // len(alphabet) ** 2, seen // len(alphabet) % len(alphabet), seen % len(alphabet)
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    total = np.zeros((len(texts), dimensions), np.float32)
    step = max(1, TABLE // max(1, len(texts)))
    for lo in range(0, len(seen), step):
        hi = min(lo + step, len(seen))
        inside = slice(None) if hi - lo == len(seen) else (number >= lo) & (number < hi)
        counts = np.bincount(owner[inside].astype(np.int64) * (hi - lo) + (number[inside] - lo), minlength=len(texts) * (hi - lo)).reshape(len(texts), hi - lo)
        total += counts.astype(np.float32) @ (twice[a[lo:hi]] * once[b[lo:hi]] * letters[c[lo:hi]]).astype(np.float32)
    return total


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """``docs(text, lang)`` -> a unit vector for each language (a few KB each)."""
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = texts_of(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for x, y in slices(map(len, texts), SLICE_CHARS):
                own = np.rint(_unit(profiles(texts[x:y], dimensions)) * SCALE).astype(np.int64)
                for lang in set(langs[x:y]):
                    sums[lang] = sums.get(lang, 0) + own[langs[x:y] == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "v"])

    rows = (docs.select("text", "lang").mapInArrow(bundle, "lang string, v array<long>")
            .select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", "v.x").collect())
    return {r.lang: _unit(np.array(r.x, np.float64)).astype(np.float32) for r in sorted(rows, key=lambda r: r.lang) if any(r.x)}


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: a fifth of all, by its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict_language(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``doc_id, held_out, lang_pred, score``.

    Learns from the text and non-null lang of the documents that are not held
    out (those with a null doc_id are), predicts for every row from its whole
    text. ``score`` is the cosine with the language's vector, 0 at least; a
    null text or one without letters gets ``und`` and 0, as does every text
    where nothing could be learned. Equal cosines go to the first language by
    name. What is broadcast is one vector a language."""
    prepare(docs.sparkSession)
    known = learn(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), dimensions)
    names = list(known)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([known[n] for n in names], np.float32).reshape(len(names), dimensions))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, scores = texts_of(batch.column(2)), [], []
            for x, y in slices(map(len, texts), SLICE_CHARS):
                own = _unit(profiles(texts[x:y], dimensions))
                some = own.any(axis=1)
                if names:
                    cosine = own @ shared.value.T
                    best = cosine.argmax(axis=1)
                    langs += [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                    scores.append(np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0))
                else:
                    langs += [UNKNOWN] * (y - x)
                    scores.append(np.zeros(y - x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [[]]), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double"))
