"""Codes and whitening of vectors, and positive-unlabelled quality, against
brute force and on awkward tables."""

import hashlib
import math

import numpy as np
import pytest

from clientlens.llm import pu_quality as pu
from clientlens.llm import vector_codes as vc
from clientlens.llm import whitening as wh
from clientlens.llm.vectors import packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n string, whitened string, component string"


def awkward_vectors(dim=8, n=300):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=dim).astype(np.float32)], int(rng.integers(0, 3)) if i % 7 else None) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(120)]  # one vector, many times
    rows += [(7, rows[9][1], 2), (7, rows[9][1], 2), (None, rows[3][1], None), (None, [0.0] * dim, 0)]
    rows += [(2000, None, 1), (2001, [math.nan] * dim, 1), (2002, [1.0] * (dim - 1) + [None], 2), (2003, [math.inf] + [0.0] * (dim - 1), 2), (2004, [math.nan], None)]
    return [(*r, "a", "b", "c", "d") for r in rows]


def good(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(awkward_vectors(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_codes(rows, parts, size, rounds):
    rows = sorted(good(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(1024 * v) for v in r[1]] for r in rows]
    width = len(x[0]) // parts
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(parts):
        own = [tuple(v[p * width:(p + 1) * width]) for v in x]
        book = own[:size]
        for r in range(rounds + 1):
            found = [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)) for v in own]
            if r < rounds:
                for k in range(len(book)):
                    held = [v for v, f in zip(own, found) if f[1] == k]
                    if held:
                        book[k] = tuple(sum(c) // len(held) for c in zip(*held))
        for i, (d, k) in enumerate(found):
            codes[i].append(k)
            errors[i] += d
        books.append(book)
    label_error = {}
    for r, e in zip(rows, errors):
        label_error[r[2]] = label_error.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for k in c), e, label_error[r[2]], sha) for r, c, e in zip(rows, codes, errors)), key=str)


@pytest.mark.parametrize(("parts", "size", "rounds"), [(4, 16, 4), (2, 256, 2), (1, 1, 3), (8, 40, 6)])
def test_codes_equal_exhaustive_search(vectors, parts, size, rounds):
    found = sorted((tuple(r) for r in vc.vector_codes(vectors, parts, size, rounds).collect()), key=str)
    assert found == brute_codes(awkward_vectors(), parts, size, rounds)


def test_codes_of_awkward_tables(spark, vectors, no_vectors):
    empty = vc.vector_codes(no_vectors)
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.vector_codes(vectors.where("vec_id >= 2000")).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vc.vector_codes(vectors, parts=3)
    mixed = spark.createDataFrame([(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="different lengths"):
        vc.vector_codes(mixed).collect()
    large = spark.createDataFrame([(1, [1e6, 1.0], 0), (2, [-1e6, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [(r.code, r.error) for r in vc.vector_codes(large, parts=2, size=1, rounds=0).orderBy("vec_id").collect()] == [("0000", 0), ("0000", (2000000 * 1024) ** 2 + 1024 ** 2)]


def test_rings_and_still_balls_leave_codes_as_they_are():
    rng = np.random.default_rng(0)
    for spread in (1, 5, 60):
        x, entries = rng.integers(-spread, spread + 1, (4000, 3)), rng.integers(-spread, spread + 1, (50, 3))
        before, far = vc.first_nearest(vc.squared(x, entries))
        moved = entries.copy()
        moved[::9] += rng.integers(-1, 2, (6, 3))
        radius = np.zeros(50)
        np.maximum.at(radius, before, np.sqrt(far))
        way = np.sqrt(((moved - entries) ** 2).sum(axis=1))
        book = vc.Book(moved, (radius + way) * (1 + 1e-9) + 1e-6, way > 0)
        code, best = book.assign(x, before)
        want, least = vc.first_nearest(vc.squared(x, moved))
        assert (code == want).all() and (best == least).all()


def test_packed_numbers_come_back():
    rows = np.array([[0, -1, 5], [40_000, 2, 3], [-(1 << 40), 1, 0], [-32768, 32767, 0]], np.int64)
    column = packed(rows)
    assert [len(v.as_py()) for v in column] == [6, 12, 24, 6]
    assert (unpacked(column, 3) == rows).all() and (unpacked(column.slice(1, 2), 3) == rows[1:3]).all()


# --- whitening ----------------------------------------------------------------

def test_updates_equal_the_whole_decomposition():
    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(400, 12)), np.floor(rng.normal(size=(200, 9)) * 2), np.repeat(rng.normal(size=(3, 6)), 4, axis=0), np.zeros((4, 3)),
              rng.normal(size=(300, 10)) * np.geomspace(1, 1e-5, 10), rng.normal(size=(30, 1)), rng.integers(0, 2, (200, 7)).astype(float)]
    for v in tables:
        parts = np.array_split(v, 3)
        spectra = []
        for part in parts:
            own = wh.Spectrum(v.shape[1])
            for row in part:
                own.add(row)
            spectra.append(own)
        for other in spectra[1:]:
            spectra[0].join(other)
        own, scatter = spectra[0], (v - v.mean(axis=0)).T @ (v - v.mean(axis=0))
        scale = max(float(np.abs(scatter).max()), 1e-300)
        assert own.n == len(v) and np.allclose(own.mean, v.mean(axis=0))
        assert np.abs(own.basis.T @ own.basis - np.eye(v.shape[1])).max() < 1e-12
        assert np.abs(own.basis * own.values @ own.basis.T - scatter).max() < 1e-12 * scale


def test_secular_roots_near_their_poles():
    d, z = np.array([1.0, 1.0 + 1e-9, 2.0, 1e6]), np.array([1e-6, 1e-7, 0.5, 0.8])
    pole, x = wh.secular_roots(d, z, 3.0)
    roots = d[pole] + x
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and abs(roots.sum() - d.sum() - 3 * (z @ z)) < 1e-9


def test_whitening_equals_a_plain_computation(vectors, no_vectors):
    rows = good(awkward_vectors())
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    gap = (n * fit - total) / n
    values, basis = np.linalg.eigh(gap.T @ gap / n)
    values, basis = values[::-1], basis[:, ::-1]
    found = [r.asDict() for r in wh.whiten(vectors, most=5).collect()]
    assert len(found) == 5 * len(rows) and {r["n"] for r in found} == {n}
    assert all(r["identity_error"] < 1e-9 and abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 for r in found)
    plain = {}
    for r, own in zip(rows, x):
        white = ((n * own - total) / n) @ basis[:, :5] / np.sqrt(values[:5])
        plain.setdefault(r[0], set()).add((int(((n * own - total) ** 2).sum()), tuple(np.round(np.abs(white), 8))))
    for vec_id, wanted in plain.items():
        own = sorted((r["component"], r["deviation"], abs(r["whitened"])) for r in found if r["vec_id"] == vec_id)
        assert {d for _, d, _ in own} == {d for d, _ in wanted}
        for k in range(5):
            assert all(any(abs(v - w[k]) < 1e-6 for _, w in wanted) for c, _, v in own if c == k + 1)
    assert wh.whiten(no_vectors).collect() == []
    assert wh.whiten(vectors.where("vec_id >= 2000")).collect() == []


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (3, [0.5, 3.0])], "vec_id long, embedding array<double>")
    found = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened is None, round(r.explained, 9)) for r in wh.whiten(one).collect())
    assert found == [(i, c, 2, 64 ** 2, c == 2, float(c == 1)) for i in (1, 2, 3) for c in (1, 2)]
    same = wh.whiten(one.where("vec_id < 3")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in same)


def test_deviation_is_exact_beyond_doubles():
    rows = np.array([[10 ** 9, 3], [10 ** 9 + 1, -5]], np.int64)
    total = np.array([2 * 10 ** 9 + 1, -2], object)
    assert wh.deviations(rows, 2, total) == [sum((2 * int(v) - int(t)) ** 2 for v, t in zip(r, total)) for r in rows]
    wide, sums = np.array([[1 << 61, 0]], np.int64), np.array([0, 5], object)
    assert wh.deviations(wide, 3, sums) == [(3 << 61) ** 2 + 25]


# --- positive-unlabelled quality ----------------------------------------------

def prose(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "it", "was", "of", "the", "river", "stone", "under", "light"]
    return " ".join(rng.choice(words) + ("." if i % 9 == 8 else "") for i in range(n))


def junk(rng, n):
    return " ".join(rng.choice(["BUY", "NOW", "$$$", "###", "CLICK"]) + "!!" for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    texts = [(i, junk(rng, 40) if i % 4 == 0 else prose(rng, int(rng.integers(20, 200)))) for i in range(1200)]
    docs = [(i, t, "x", 0.5, "k") for i, t in texts] + [(3000, None, "x", 0.5, "k"), (3001, "", "x", 0.5, "k"), (None, prose(rng, 30), None, None, None), (5, texts[5][1], "x", 0.5, "k"), (3002, "w" * 70_000, "x", 0.5, "k")]
    marks = [(i, int(i % 4 != 0), 0) for i in range(0, 1200, 2)] + [(5, 1, 0), (5, None, 1), (7, 1, 0), (7, 0, 0), (None, 1, 0), (99_999, 1, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, positive string").repartition(5),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_quality_is_learned_from_positives_only(labelled):
    docs, labels = labelled
    found = pu.score_quality(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert 150 < len(held) < 330
    right = sum(r.predicted == int(r.doc_id % 4 != 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(r.held_out for r in found if r.doc_id is None)
    # marks of 0 and of held-out documents are never used
    again = pu.score_quality(docs, labels.where("quality = 1 or doc_id = 7 or doc_id is null").unionByName(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").selectExpr("doc_id", "1 - quality as quality", "toxic")))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in again.collect()) == sorted((str(r.doc_id), round(r.score, 6)) for r in found)


def test_quality_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert {(r.score, r.predicted) for r in pu.score_quality(docs, labels.limit(0)).collect()} == {(0.5, 1)}
    assert pu.score_quality(docs.limit(0), labels).collect() == []


def test_shapes_equal_plain_counts():
    texts = ["", " \n ", "one two two two\none two two two\nEND!! 12", "é " * 9, "a b c a b c"]
    found = pu.shape([t.encode() for t in texts])
    assert found.shape == (5, pu.SHAPES) and (found >= 0).all() and (found <= 1).all() and not found[:2].any()
    w = texts[2].split()
    assert found[2, 12] == pytest.approx(math.sqrt(4 / len(w)))  # same as the word before
    assert found[2, 13] == pytest.approx(math.sqrt(8 / len(w)))  # three-word windows found twice
    assert found[2, 15] == pytest.approx(4 / len(w)) and found[2, 16] == pytest.approx(math.sqrt(6 / len(w))) and found[2, 17] == pytest.approx(math.sqrt(4 / len(w)))
    assert found[4, 13] == 1 and found[4, 14] == 0 and found[3, 12] == pytest.approx(math.sqrt(8 / 9))
    x = pu.spread_out(found)
    assert np.allclose(x[:, :-1].sum(axis=1), pu.SHAPES) and (x[:, -1] == 1).all()


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    positive = np.histogram(rng.beta(8, 2, 20_000), pu.BINS, (0, 1))[0]
    every = np.histogram(np.concatenate([rng.beta(8, 2, 60_000), rng.beta(2, 8, 40_000)]), pu.BINS, (0, 1))[0]
    assert abs(pu.class_prior(positive, every) - 0.6) < 0.03


def test_risk_and_its_gradient():
    rng = np.random.default_rng(2)
    x, positive, prior = rng.normal(size=(60, pu.WIDTH)), np.arange(60) < 25, 0.4

    def sums(model):
        g = x @ model
        odds = 1 / (1 + np.exp(-g))
        parts = [(x[k], g[k], odds[k]) for k in (positive, slice(None))]
        mean = lambda f: np.array([f(*p).mean(axis=0) for p in parts])
        return pu.Sums(np.array([25, 60]), mean(lambda a, b, c: np.log1p(np.exp(-b))), mean(lambda a, b, c: np.log1p(np.exp(b))), mean(lambda a, b, c: a),
                       mean(lambda a, b, c: a * c[:, None]), np.array([(a * (c * (1 - c))[:, None]).T @ a / len(a) for a, b, c in parts]))

    model, way = rng.normal(size=pu.WIDTH) * 0.05, rng.normal(size=pu.WIDTH) * 1e-5
    s, up, down = sums(model), sums(model + way), sums(model - way)
    risk = pu.non_negative(prior)
    assert s.wrong[1] - prior * s.wrong[0] > 0
    assert risk(up)[0] - risk(down)[0] == pytest.approx(2 * float(risk(s)[1] @ way), rel=1e-5)
    # where the negatives' risk falls below 0, the step goes up on it
    back = pu.non_negative(50.0)
    below = lambda t: t.wrong[1] - 50.0 * t.wrong[0]
    assert below(s) < 0 and back(s)[0] == pytest.approx(50 * s.right[0])
    assert below(sums(model - 1e-4 * back(s)[1])) > below(s)
