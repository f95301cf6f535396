import numpy as np
import pytest

from clientlens.operators import block_search as bs


def brute(rows, k):
    out = {}
    for block in {r[1] for r in rows if r[1] is not None}:
        own = [(r[0], np.array(r[2], np.float32).astype(float)) for r in rows if r[1] == block and r[2] is not None]
        unit = {i: v / (np.linalg.norm(v) or 1.0) for i, v in own}
        for i, _ in own:
            near = sorted((round(1 - float(unit[i] @ unit[j]), 6), j) for j, _ in own if j != i)
            out[block, i] = [(r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return {key: v for key, v in out.items() if v}


@pytest.mark.parametrize("group", [1024, 16])
def test_nearest_in_a_block_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(bs, "GROUP_ROWS", group)
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 == 0 else f"b{i % 11}", [float(v) for v in np.round(rng.normal(size=6) + 3 * (i % 4), 2)]) for i in range(240)]
    rows += [(900, "alone", [1.0] * 6), (901, None, [1.0] * 6), (902, "hot", None), (903, "hot", [0.0] * 6), (904, "hot", [2.0] * 6), (905, "hot", [2.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, dom string, v array<float>, rank string")
    found = {}
    for r in bs.block_top_k(df, "dom", "id", "v", k=4, n_cells=5).collect():
        found.setdefault((r.block, r.query_id), []).append((r.rank, r.neighbor_id, r.distance))
    want = brute(rows, 4)
    assert set(found) == set(want)
    for key, near in want.items():
        assert [(r, d) for r, _, d in sorted(found[key])] == [(r, pytest.approx(d, abs=2e-6)) for r, _, d in near]
    assert all(r[1] != 902 for v in found.values() for r in v)


def test_no_rows_no_candidates(spark):
    df = spark.createDataFrame([], "id long, dom string, v array<float>")
    assert bs.block_top_k(df, "dom", "id", "v").collect() == []
