import numpy as np
import pytest

from clientlens.operators import sparse_search
from clientlens.operators.sparse_search import sparse_top_k
from clientlens.operators.vector import vector_search


def sparse_rows(n, dim, seed):
    """Few components of very different rarity; copies, zero vectors, a row that nothing resembles."""
    rng = np.random.default_rng(seed)
    m = np.zeros((n, dim), np.float32)
    for i in range(n):
        at = np.minimum(dim - 2, (dim * rng.random(rng.integers(1, 7)) ** 2).astype(int))
        m[i, at] = rng.random(len(at)) + 0.1
    m[10:14] = m[3]
    m[20:23] = 0
    m[30] = 0
    m[30, dim - 1] = 1
    return m


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block, around", [(8192, 1024), (16, 8)])
def test_lists_give_the_exact_neighbours(spark, monkeypatch, block, around):
    monkeypatch.setattr(sparse_search, "BLOCK", block)
    monkeypatch.setattr(sparse_search, "AROUND", around)
    m = sparse_rows(150, 24, 5)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    for own in (True, False):
        got = rows_of(sparse_top_k(df, 5, "id", "v", exclude_self=own))
        assert got == rows_of(vector_search(df, df, 5, "id", "v", n_cells=4, block=64, exclude_self=own))
        assert len(got) == 150 * 5


def test_repeated_ids_and_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<float>")
    found = {}
    for r in sparse_top_k(df, 5, "id", "v", exclude_self=True).collect():
        found.setdefault(r.query_id, []).append(r.neighbor_id)
    assert {q: sorted(n) for q, n in found.items()} == {1: [2, 2, 3, 3], 2: [1, 1, 3], 3: [1, 1, 2]}
    assert sparse_top_k(df.limit(0), 5, "id", "v").count() == 0


def test_a_query_meets_few_lists(spark, monkeypatch):
    """The pairs compared stay far below all pairs."""
    rng = np.random.default_rng(1)
    m = np.zeros((2000, 128), np.float32)
    for i in range(2000):  # two rare components, four frequent ones
        m[i, rng.integers(0, 100, 2)] = 4
        m[i, 100 + rng.integers(0, 28, 4)] = 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    kept, keep = [], sparse_search.written
    monkeypatch.setattr(sparse_search, "written", lambda d: kept.append(keep(d)) or kept[-1])
    found = sparse_top_k(df, 5, "id", "v", exclude_self=True)
    asked = kept[-1].groupBy("list").count().collect()
    assert sum(r["count"] * int((m[:, r["list"]] != 0).sum()) for r in asked) < 0.15 * 2000 * 2000
    assert found.count() == 10_000
