import numpy as np

from clientlens.operators import pq_index as pq


def test_index_finds_neighbours_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(pq, "GROUP_ROWS", 60)
    monkeypatch.setattr(pq, "QUERY_ROWS", 100)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 16)) * 2
    vectors = {i: np.float32(centre[i % 6] + rng.normal(size=16)) for i in range(400)}
    vectors |= {1000 + i: vectors[7] for i in range(90)}  # one vector, more often than a group holds
    rows = [(i, [float(x) for x in v], "s") for i, v in vectors.items()] + [(None, [1.0] * 16, "s"), (5000, None, "s"), (5001, [0.0] * 16, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance string").repartition(3)
    index = pq.build_index(df, "vec_id", "embedding", 6, 0.9)
    assert index.groups_of.max() > 1 and len(set(index.first_group.tolist())) > 1
    found = {}
    for r in pq.index_search(index, df, "vec_id", "embedding", 6, exclude_self=True).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.neighbor_id, r.distance))
    index.release()
    ids = sorted(vectors) + [5001]
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) if i in vectors else np.zeros(16) for i in ids]).astype(float)
    far = np.round(1 - unit @ unit.T, 6)
    np.fill_diagonal(far, 9)
    hits = 0
    for n, i in enumerate(ids[:-1]):
        own = sorted(found[i])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5, 6] and all(j != i for _, j, _ in own)
        assert all(abs(d - far[n, ids.index(j)]) <= 2e-6 for _, j, d in own)
        kth = np.sort(far[n])[5]
        hits += sum(d <= kth + 2e-6 for _, _, d in own)
    assert hits >= 0.9 * 6 * (len(ids) - 1) and 5000 not in found and None not in found


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [1.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.neighbor_id) for r in pq.approximate_top_k(few, "vec_id", "embedding", 6).orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert pq.approximate_top_k(few.limit(0), "vec_id", "embedding", 6).collect() == []


def test_the_numbers_of_probes_and_candidates_follow_the_recall(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)], "vec_id long, embedding array<float>")
    probes = []
    for recall in (0.3, 0.95):
        index = pq.build_index(df, "vec_id", "embedding", 5, recall, parts=4)
        probes.append(index.n_probe)
        index.release()
    assert probes[0] < probes[1] <= len(index.cells)
