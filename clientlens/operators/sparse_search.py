"""Exact cosine top-k of sparse vectors (TF-IDF texts) by inverted lists.

Components are ordered by rarity. A vector that shares none of a query's first
non-zero components has a cosine of at most the norm of the query's other ones,
so a query meets the lists of as many components as it takes for that norm to
fall below a cosine that ``k`` others are known to have:

1. rows are sorted by their first components and compared with the rows around
   them; the k-th best cosine found so bounds the true one from below;
2. each query is sent to the lists of its first components. Lists and their
   queries are cut into blocks; a block emits only rows within the bound, the
   best ``k`` for each query. A pair is compared in the list of the first
   component that it shares, so every pair of rows is met at most once;
3. a query without such a bound, once its components are used up, meets the
   list of all rows. Zero vectors are at distance 1 from every row.

Distances are rounded to 6 decimals and ordered by (distance, id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import spread, written
from .vector import DIST_DP, _unit

#: Rows that are compared with each other for the bound.
AROUND = 1024
#: Rows of a block on either side, and queries whose cosines are held at once.
BLOCK, SCORE_ROWS = 8192, 256
#: First components that rows are sorted by.
SORTED_BY = 6
#: Room for the rounding of distances.
ROUNDING = 3e-6
#: The list of all rows, and the bound of a query that has none.
ALL, UNKNOWN = -1, -2.0
_SPARSE = np.dtype([("at", "<u4"), ("x", "<f4")])


def _packed(vectors: pd.Series) -> list[bytes]:
    out = []
    for v in vectors:
        v = np.asarray(v, np.float32)
        at = np.flatnonzero(v)
        row = np.empty(len(at), _SPARSE)
        row["at"], row["x"] = at, v[at]
        out.append(row.tobytes())
    return out


def _dense(rows: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors of packed rows."""
    values = np.frombuffer(b"".join(rows), _SPARSE)
    out = np.zeros((len(rows), dim))
    out[np.repeat(np.arange(len(rows)), [len(r) // _SPARSE.itemsize for r in rows]), values["at"]] = values["x"]
    return _unit(out)


def _best(row: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each row, by (distance, id)."""
    order = np.lexsort((ids, distance, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def sparse_top_k(vectors: DataFrame, k: int, id_col: str, vec_col: str, exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the ``k`` nearest rows of
    every row of ``vectors`` by cosine."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, neighbor_id long, distance double"
    first = vectors.select(F.size(vec_col).alias("n")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim = first["n"]

    def pack(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "vec": _packed(frame["vec"])})

    rows = written(spread(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")), "id")
                   .mapInPandas(pack, "id long, vec binary"))

    def components(frames):
        n = np.zeros(dim, np.int64)
        for frame in frames:
            n += np.bincount(np.frombuffer(b"".join(frame["vec"]), _SPARSE)["at"], minlength=dim)
        yield pd.DataFrame({"at": np.flatnonzero(n), "n": n[n > 0]})

    often = np.zeros(dim, np.int64)
    for r in rows.select("vec").mapInPandas(components, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a component
        often[r["at"]] = r["n"]
    order = np.argsort(often, kind="stable")  # components by rarity
    place = np.argsort(order, kind="stable")
    shared = spark.sparkContext.broadcast((order, place))

    filled = rows.where(F.length("vec") > 0)
    bounded = _bounded(filled, shared, k, dim, exclude_self)

    def route(frames):
        order_, _ = shared.value
        for frame in frames:
            u = _dense(frame["vec"], dim)[:, order_]
            rest = np.sqrt(np.maximum(0.0, (u * u)[:, ::-1].cumsum(axis=1)[:, ::-1]))  # norm from a component on
            low = frame["low"].to_numpy()
            row, at = np.nonzero((u != 0) & (rest >= low[:, None]))
            open_ = np.flatnonzero(low == UNKNOWN)
            row, lists = np.concatenate([row, open_]), np.concatenate([order_[at], np.full(len(open_), ALL)])
            yield pd.DataFrame({"list": lists.astype("int32"), "qid": frame["id"].to_numpy()[row], "low": low[row], "qvec": frame["vec"].to_numpy()[row]})

    asked = written(bounded.mapInPandas(route, "list int, qid long, low double, qvec binary"))
    queries = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # one row a component
    size = {c: rows.count() if c == ALL else int(often[c]) for c in queries}
    parts = spark.createDataFrame([(c, -(-n // BLOCK), -(-size[c] // BLOCK)) for c, n in queries.items()], "list int, of_queries int, of_members int")
    lists = spark.sparkContext.broadcast(np.array(sorted(queries), np.int64))

    def members(frames):
        wanted = lists.value
        for frame in frames:
            n = [len(r) // _SPARSE.itemsize for r in frame["vec"]]
            row, at = np.repeat(np.arange(len(frame)), n), np.frombuffer(b"".join(frame["vec"]), _SPARSE)["at"].astype(np.int64)
            if len(wanted) and wanted[0] == ALL:
                row, at = np.concatenate([row, np.arange(len(frame))]), np.concatenate([at, np.full(len(frame), ALL)])
            keep = np.isin(at, wanted)
            row, at = row[keep], at[keep]
            yield pd.DataFrame({"list": at.astype("int32"), "id": frame["id"].to_numpy()[row], "vec": frame["vec"].to_numpy()[row]})

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []})
        if not len(left) or not len(right):
            return empty
        _, place_ = shared.value
        before = np.ones(dim, bool) if key[0] == ALL else place_ < place_[key[0]]  # components whose lists have the pair already
        b, ids = _dense(right["vec"], dim), right["id"].to_numpy()
        b_before = (b[:, before] != 0).astype(np.float32)
        outs = []
        for a in range(0, len(left), SCORE_ROWS):
            part = left.iloc[a:a + SCORE_ROWS]
            q, qid = _dense(part["qvec"], dim), part["qid"].to_numpy()
            cosine = q @ b.T
            row, col = np.nonzero(cosine >= part["low"].to_numpy()[:, None])
            fresh = np.ones(len(row), bool)
            if before.any() and len(row):
                met = (q[:, before] != 0).astype(np.float32) @ b_before.T
                fresh = met[row, col] == 0
            if exclude_self:
                fresh &= qid[row] != ids[col]
            row, col = row[fresh], col[fresh]
            distance = np.round(1.0 - cosine[row, col], DIST_DP)
            best = _best(row, distance, ids[col], k)
            outs.append(pd.DataFrame({"query_id": qid[row[best]], "neighbor_id": ids[col[best]], "distance": distance[best]}))
        return pd.concat(outs)

    routed = (asked.join(F.broadcast(parts), "list").withColumn("qblk", F.pmod(F.xxhash64("qid"), "of_queries").cast("int"))
              .withColumn("bblk", F.explode(F.sequence(F.lit(0), F.col("of_members") - 1))).select("list", "qblk", "bblk", "qid", "low", "qvec"))
    placed = (rows.mapInPandas(members, "list int, id long, vec binary").join(F.broadcast(parts), "list").withColumn("bblk", F.pmod(F.xxhash64("id"), "of_members").cast("int"))
              .withColumn("qblk", F.explode(F.sequence(F.lit(0), F.col("of_queries") - 1))).select("list", "qblk", "bblk", "id", "vec"))
    keys = ["list", "qblk", "bblk"]
    found = routed.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(compare, "query_id long, neighbor_id long, distance double")
    # zero vectors: the smallest ids, whose rows may repeat
    smallest = [r["id"] for r in rows.groupBy("id").count().orderBy("id").limit(k + 1).collect() for _ in range(min(k, r["count"]))]  # k * (k + 1) at most
    nearest = rows.where(F.length("vec") == 0).select(F.col("id").alias("query_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in smallest])).alias("neighbor_id"))
    if exclude_self:
        nearest = nearest.where("query_id <> neighbor_id")
    found = found.union(nearest.select("query_id", "neighbor_id", F.lit(1.0).alias("distance")))
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def _bounded(rows: DataFrame, shared, k: int, dim: int, exclude_self: bool) -> DataFrame:
    """``id, vec, low``: a cosine, less the room for rounding, that ``k`` other
    rows have with the row; ``UNKNOWN`` where none above 0 is known."""
    def keyed(frames):
        _, place = shared.value
        for frame in frames:
            keys = [place[np.frombuffer(r, _SPARSE)["at"]] for r in frame["vec"]]
            yield pd.DataFrame({"id": frame["id"], "vec": frame["vec"], "key": [np.sort(x)[:SORTED_BY].astype("int32") for x in keys]})

    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = (rows.mapInPandas(keyed, "id long, vec binary, key array<int>").repartitionByRange(n, "key", "vec", "id")
            .sortWithinPartitions("key", "vec", "id").select("id", "vec"))

    def bound(frames):
        for frame in frames:
            # as few parts as have AROUND rows at most: none is a small rest
            for part in np.array_split(np.arange(len(frame)), max(1, -(-len(frame) // AROUND))):
                if not len(part):
                    continue
                part = frame.iloc[part]
                u, ids = _dense(part["vec"], dim), part["id"].to_numpy()
                cosine = u @ u.T
                if exclude_self:
                    cosine[ids[:, None] == ids[None, :]] = -1.0
                low = np.partition(cosine, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.zeros(len(ids))
                yield pd.DataFrame({"id": part["id"], "vec": part["vec"], "low": np.where(low > ROUNDING, low - ROUNDING, UNKNOWN)})

    return near.mapInPandas(bound, "id long, vec binary, low double")
