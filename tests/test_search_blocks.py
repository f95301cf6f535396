import numpy as np
import pandas as pd

from clientlens.operators import pq_index as pq
from clientlens.operators import vector


def test_vectors_are_sent_for_few_blocks_and_scored_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(3000)], "id long, v array<float>")
    index = vector.CellIndex(df, "id", "v", n_cells=1)
    assert index.nblk.tolist() == [1]  # three blocks before, each with all queries
    index.release()
    rows = pd.DataFrame({"qid": range(300), "id": range(300), "vec": list(rng.normal(size=(300, 4)))})
    whole = vector._topk_block(5, True, 4)(rows[["qid", "vec"]], rows[["id", "vec"]])
    monkeypatch.setattr(vector, "SCORE_ROWS", 7)
    parts = vector._topk_block(5, True, 4)(rows[["qid", "vec"]], rows[["id", "vec"]])
    assert sorted(map(tuple, whole.to_numpy())) == sorted(map(tuple, parts.to_numpy()))


def test_an_index_search_in_small_pieces_finds_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)], "id long, v array<float>")
    index = pq.build_index(df, "id", "v", 5, 0.95, parts=4)
    whole = sorted(map(tuple, pq.index_search(index, df, "id", "v", 5).collect()))
    for name, n in (("SCORES", 100), ("CANDIDATES", 50), ("CELL_ROWS", 3)):
        monkeypatch.setattr(pq, name, n)
    assert sorted(map(tuple, pq.index_search(index, df, "id", "v", 5).collect())) == whole
    index.release()
