"""Vector top-k search (TVF-04): exact and approximate (IVF) cosine search.

Index ("cells"): k-means centroids of the unit vectors (MLlib ``KMeans``,
seeded); every vector is assigned to its nearest centroid and each cell
keeps its radius (largest member distance to the centroid).

Search, for all queries at once:

1. each query probes its ``n_probe`` nearest cells;
2. (exact mode) with ``d_k`` the k-th best distance found so far, a cell c
   can still hold a closer vector only if the triangle-inequality bound
   ``(max(0, |q − μ_c| − r_c))² / 2 ≤ d_k`` holds (cosine distance of unit
   vectors is ``|a − b|² / 2``); exactly those cells are probed next.

A probe never pairs rows with a join.  Queries and cell members are routed
to groups keyed by (cell, member block, query block), each side cut into
blocks of at most ``block`` rows, so a hot cell becomes many bounded groups.
Inside a group, ``cogroup().applyInPandas`` computes the distance block with
one numpy matrix product and emits only the per-query top-k (ties at the
k-th distance kept).  Per-query partial lists are merged with a
``row_number`` window (partial top-k before the shuffle).

Approximate (IVF) mode probes the ``n_probe`` nearest cells only; given a
``recall``, it probes as many as a hashed sample of the queries needs to find
that share of its exact neighbours.

Distances are rounded to 6 decimals and ordered by (distance, id), so the
result is deterministic.  Zero vectors are treated as orthogonal to every
vector (distance 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, spread

PAIR_SCHEMA = "query_id long, neighbor_id long, distance double"
DIST_DP = 6
#: Rows of a block on either side: vectors and partial lists are sent once for
#: every block they meet. Queries of a block whose distances are held at once.
BLOCK, SCORE_ROWS = 16_384, 256
#: Probes (a query's vector each) that a task holds at once.
PROBE_ROWS = 10_000
#: Queries by which the number of probes is found, and what is added to the
#: recall asked for, as a sample's differs from that of all queries.
SAMPLE_QUERIES, RECALL_MARGIN = 512, 0.02
#: Cells that are taken from the row count: its square root, within these.
LEAST_CELLS, MOST_CELLS = 16, 1024


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return mat / n


def _stack(col: pd.Series, dim: int) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, dim))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col])


def _normalize_batches(it):
    for pdf in it:
        if len(pdf) == 0:
            continue
        dim = len(pdf["vec"].iloc[0])
        U = _unit(_stack(pdf["vec"], dim))
        yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "uvec": list(U)})


def _cut(it, probes: int):
    """Batches of so few queries that their probes are ``PROBE_ROWS`` rows at most."""
    n = max(1, PROBE_ROWS // probes)
    for pdf in it:
        for a in range(0, len(pdf), n):
            yield pdf.iloc[a:a + n]


def _centroid_dist(U: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Euclidean distances rows × centroids via one matrix product
    (|u - c|² = |u|² + |c|² - 2 u·c), memory rows × centroids."""
    d2 = (U * U).sum(axis=1)[:, None] + (C * C).sum(axis=1)[None, :] - 2.0 * (U @ C.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _topk_block(k: int, exclude_self: bool, dim: int):
    def fn(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []})
        if len(q) == 0 or len(b) == 0:
            return empty
        B, bid = _unit(_stack(b["vec"], dim)), b["id"].to_numpy()
        place = np.empty(len(bid), np.int64)
        place[np.argsort(bid, kind="stable")] = np.arange(len(bid))
        return pd.concat([part(q.iloc[a:a + SCORE_ROWS], B, bid, place) for a in range(0, len(q), SCORE_ROWS)])

    def part(q: pd.DataFrame, B: np.ndarray, bid: np.ndarray, place: np.ndarray) -> pd.DataFrame:
        D = np.round(1.0 - _unit(_stack(q["vec"], dim)) @ B.T, DIST_DP)
        qid = q["qid"].to_numpy()
        if exclude_self:
            D = np.where(qid[:, None] == bid[None, :], np.inf, D)
        # exactly k a query: (distance, id) as one whole number, so ties go to the smaller id
        order = np.where(np.isfinite(D), np.rint(D * 10 ** DIST_DP), 4 * 10 ** DIST_DP).astype(np.int64) * len(bid) + place
        kk = min(k, D.shape[1])
        cols = np.argpartition(order, kk - 1, axis=1)[:, :kk].ravel()
        rows = np.repeat(np.arange(len(D)), kk)
        out = pd.DataFrame({"query_id": qid[rows], "neighbor_id": bid[cols], "distance": D[rows, cols]})
        return out[np.isfinite(out["distance"])]
    return fn


class CellIndex:
    """Cells over a base table: centroids (driver-side, ``n_cells`` × dim,
    a bounded parameter) and the assigned base rows."""

    def __init__(self, base: DataFrame, id_col: str, vec_col: str, n_cells: int = 16, block: int = BLOCK,
                 seed: int = 42, train_fraction: float | None = None):
        self.spark = base.sparkSession
        self.block = block
        # The base rows feed the k-means fit, the cell statistics and every
        # probe round: persist them once (lineage-backed, so a lost executor
        # recomputes its blocks).  ``release()`` frees them.
        b = spread(base.select(F.col(id_col).cast("long").alias("id"),
                               F.col(vec_col).cast("array<float>").alias("vec")), "id")
        # Unit vectors computed once, in numpy over Arrow batches, and
        # persisted with the raw vectors: they feed every k-means pass, the
        # cell statistics and every probe round (lineage-backed, so a lost
        # executor recomputes its blocks; ``release()`` frees them).
        unit = (b.mapInPandas(_normalize_batches, "id long, vec array<float>, uvec array<double>")
                .select("id", "vec", array_to_vector("uvec").alias("uvec"))
                .persist(StorageLevel.MEMORY_AND_DISK))
        self._persisted = [unit]
        train = unit if not train_fraction else unit.sample(fraction=train_fraction, seed=seed)
        if n_cells == 1:  # KMeans takes two or more
            centers = [train.select(Summarizer.mean(F.col("uvec"))).first()[0].toArray()]
        else:
            centers = KMeans(k=n_cells, seed=seed, featuresCol="uvec", maxIter=20).fit(train).clusterCenters()
        b = unit.select("id", "vec")
        cents = np.array([np.asarray(c, dtype=np.float64) for c in centers])
        self.dim = cents.shape[1]
        self.centroids = cents
        self._bc = self.spark.sparkContext.broadcast(cents)
        self.base = self._assign(b).persist(StorageLevel.MEMORY_AND_DISK)
        self._persisted.append(self.base)
        stats = (self.base.groupBy("cell").agg(F.max("dcell").alias("radius"), F.count("*").alias("n"))
                 .collect())  # one row per cell: bounded by n_cells
        self.radius = np.zeros(len(cents))
        self.size = np.zeros(len(cents), dtype=np.int64)
        for r in stats:
            self.radius[r["cell"]] = r["radius"]
            self.size[r["cell"]] = r["n"]
        self.nblk = np.maximum(1, np.ceil(self.size / block)).astype(int)
        nblk = F.element_at(F.array(*[F.lit(int(x)) for x in self.nblk]), F.col("cell") + 1)
        self.base = self.base.withColumn("bblk", F.pmod(F.xxhash64("id"), nblk).cast("int"))

    def release(self) -> None:
        for d in self._persisted:
            d.unpersist()

    def _assign(self, df: DataFrame) -> DataFrame:
        bc = self._bc

        def assign(it):
            cents = bc.value
            for pdf in it:
                if len(pdf) == 0:
                    continue
                U = _unit(_stack(pdf["vec"], cents.shape[1]))
                d = _centroid_dist(U, cents)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "cell": cell.astype("int32"),
                                    "dcell": d[np.arange(len(cell)), cell]})
        return df.mapInPandas(assign, "id long, vec array<float>, cell int, dcell double")

    # -- probing ------------------------------------------------------------------------------
    def nearest_cells(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """(qid, vec, cell) for each query's ``n_probe`` nearest cells."""
        bc = self._bc

        def near(it):
            cents = bc.value
            p = min(n_probe, len(cents))
            for pdf in _cut(it, p):
                if len(pdf) == 0:
                    continue
                U = _unit(_stack(pdf["vec"], cents.shape[1]))
                d = _centroid_dist(U, cents)
                idx = np.argsort(d, axis=1, kind="stable")[:, :p]
                yield pd.DataFrame({"qid": np.repeat(pdf["qid"].to_numpy(), p),
                                    "vec": np.repeat(pdf["vec"].to_numpy(), p),
                                    "cell": idx.ravel().astype("int32")})
        return queries.mapInPandas(near, "qid long, vec array<float>, cell int")

    def bounded_cells(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """(qid, vec, cell) for cells beyond the ``n_probe`` nearest whose
        lower bound does not exceed the query's current k-th distance ``dk``."""
        bc, rad = self._bc, self.radius

        def bound(it):
            cents = bc.value
            for pdf in _cut(it, len(cents)):
                if len(pdf) == 0:
                    continue
                U = _unit(_stack(pdf["vec"], cents.shape[1]))
                d = _centroid_dist(U, cents)
                order = np.argsort(d, axis=1, kind="stable")
                lb = np.maximum(0.0, d - rad[None, :]) ** 2 / 2.0
                # dk is rounded to 6 dp: widen by one unit so ties at dk are kept
                ok = lb <= pdf["dk"].to_numpy()[:, None] + 1e-6
                done = np.zeros_like(ok)
                np.put_along_axis(done, order[:, :n_probe], True, axis=1)
                r, c = np.nonzero(ok & ~done)
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[r], "vec": pdf["vec"].to_numpy()[r],
                                    "cell": c.astype("int32")})
        return queries.mapInPandas(bound, "qid long, vec array<float>, cell int")

    def probe(self, probes: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """Top-k partial lists of the (query, cell) probes."""
        nblk = F.element_at(F.array(*[F.lit(int(x)) for x in self.nblk]), F.col("cell") + 1)
        qcount = probes.groupBy("cell").agg(F.count("*").alias("nq"))
        q = (probes.join(F.broadcast(qcount), "cell")  # ≤ n_cells rows
             .withColumn("qblk", F.pmod(F.xxhash64("qid"), F.greatest(F.lit(1), F.ceil(F.col("nq") / self.block)))
                         .cast("int"))
             .withColumn("bblk", F.explode(F.sequence(F.lit(0), nblk - 1))))
        qb = q.select(F.col("cell").alias("qcell"), F.col("qblk").alias("qb")).distinct()
        # member rows replicated once per query block of their cell
        b = (self.base.join(qb, F.col("cell") == F.col("qcell"))
             .select("cell", "bblk", F.col("qb").alias("qblk"), "id", "vec"))
        fn = _topk_block(k, exclude_self, self.dim)
        return (q.select("cell", "bblk", "qblk", "qid", "vec")
                .groupBy("cell", "bblk", "qblk")
                .cogroup(b.select("cell", "bblk", "qblk", "id", "vec").groupBy("cell", "bblk", "qblk"))
                .applyInPandas(lambda a, c: fn(a, c), PAIR_SCHEMA))


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    # rounds probe disjoint cells, so a (query, neighbour) pair appears once
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_search(base: DataFrame, query: DataFrame, top_k: int = 5, id_col: str = "id", vec_col: str = "embedding",
                  query_id_col: str | None = None, query_vec_col: str | None = None, exact: bool = True,
                  n_probe: int = 1, n_cells: int | None = 16, block: int = BLOCK, exclude_self: bool = False,
                  index: CellIndex | None = None, recall: float | None = None) -> DataFrame:
    """Cosine top-k of every query row against ``base``.

    Output: query_id, rank (1..k), neighbor_id, distance (6 dp).
    ``exact=False`` is the IVF search over the ``n_probe`` nearest cells, or
    with ``recall`` over so many that about this share of the exact neighbours
    is found. ``n_cells=None`` takes the cells from the row count.
    """
    if index is None and n_cells is None:
        n_cells = int(min(MOST_CELLS, max(LEAST_CELLS, base.count() ** 0.5)))
    idx = index or CellIndex(base, id_col, vec_col, n_cells=n_cells, block=block)
    ensure_checkpoint_dir(base.sparkSession)
    q = spread(query.select(F.col(query_id_col or id_col).cast("long").alias("qid"),
                            F.col(query_vec_col or vec_col).cast("array<float>").alias("vec")), "qid")
    if not exact and recall is not None:
        n_probe = probes_for(idx, q, top_k, min(1.0, recall + RECALL_MARGIN), exclude_self)
    # Each round's probe list feeds both the block sizing and the probe, and
    # round one's top-k feeds both round two and the final merge: checkpoint
    # them (queries × n_probe and queries × k rows) so no numpy stage runs twice
    # and a lost executor costs at most one round.
    first = idx.probe(idx.nearest_cells(q, n_probe).checkpoint(), top_k, exclude_self)
    if not exact:
        return _rank(first, top_k).select("query_id", "rank", "neighbor_id", "distance")
    top1 = _rank(first, top_k).select(*PAIR_COLS).checkpoint()
    dk = (top1.groupBy("query_id").agg(F.max("distance").alias("dk"), F.count("*").alias("found"))
          .select(F.col("query_id").alias("qid"),
                  F.when(F.col("found") >= top_k, F.col("dk")).otherwise(F.lit(2.0)).alias("dk")))
    q2 = q.join(dk, "qid", "left").withColumn("dk", F.coalesce("dk", F.lit(2.0)))
    second = idx.probe(idx.bounded_cells(q2, n_probe).checkpoint(), top_k, exclude_self)
    return _rank(top1.unionByName(second), top_k).select("query_id", "rank", "neighbor_id", "distance")


def probes_for(idx: CellIndex, queries: DataFrame, top_k: int, recall: float, exclude_self: bool) -> int:
    """The fewest nearest cells that hold the share ``recall`` of the exact
    neighbours of a sample of ``queries(qid, vec)``: a neighbour is found if
    and only if its cell is probed."""
    sample = queries.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE_QUERIES).checkpoint()
    found = vector_search(queries, sample, top_k, "qid", "vec", exact=True, exclude_self=exclude_self, index=idx)
    cells = found.join(idx.base.select(F.col("id").alias("neighbor_id"), "cell"), "neighbor_id").select("query_id", "cell").toPandas()
    if cells.empty:
        return 1
    rows = sample.toPandas()
    distance = _centroid_dist(_unit(_stack(rows["vec"], idx.dim)), idx.centroids)
    place = np.argsort(np.argsort(distance, axis=1, kind="stable"), axis=1, kind="stable")
    at = pd.Series(np.arange(len(rows)), index=rows["qid"])[cells["query_id"]].to_numpy()
    need = np.sort(place[at, cells["cell"].to_numpy()])
    return int(need[min(len(need), max(1, int(np.ceil(recall * len(need))))) - 1]) + 1


PAIR_COLS = ["query_id", "neighbor_id", "distance"]


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact (query, neighbour) pairs that the approximate search found."""
    hit = exact.join(approx.select("query_id", "neighbor_id"), ["query_id", "neighbor_id"], "left_semi")
    return hit.agg(F.count("*").alias("hits")).select(
        (F.col("hits") / exact.agg(F.count("*")).scalar()).alias("recall"))


def lookalike_counts(pairs: DataFrame) -> DataFrame:
    """Neighbours per query excluding the query itself (RM-05 look-alikes)."""
    return (pairs.filter(F.col("neighbor_id") != F.col("query_id"))
            .groupBy("query_id").agg(F.count("*").alias("n_lookalikes")))
