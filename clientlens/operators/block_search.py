"""ER-05: the nearest records of each record inside its own block.

Candidates of a record are the ``k`` nearest vectors (cosine) among the rows of
its block, for example of its domicile or birth date; rows of other blocks are
never compared. A block with more rows than fit in one group is divided among
cells (k-means centroids of a bounded sample), each with its number of rows and
its radius in that block. A record first searches the nearest cell that its
block has, then those whose triangle-inequality bound can still beat its k-th
distance, so the result is exact and a hot block is not searched pair by pair.
Both sides of a cell are cut into groups of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_table, write_table
from .vector import DIST_DP, _centroid_dist, _stack, _topk_block, _unit

#: Rows of one side of a group, and of the sample that the cells are fitted to.
GROUP_ROWS, SAMPLE_ROWS = 1024, 20_000
_PAIR = "query_id long, neighbor_id long, distance double"


def _cells(rows: DataFrame, n_cells: int) -> np.ndarray:
    """Unit centroids by a few Lloyd steps over a hashed sample."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toPandas()
    units = _unit(_stack(sample["vec"], len(sample["vec"].iloc[0])))
    cells = units[:n_cells].copy()
    for _ in range(8):
        near = _centroid_dist(units, cells).argmin(axis=1)
        for c in range(len(cells)):
            own = units[near == c]
            if len(own):
                cells[c] = own.mean(axis=0)
    return cells


def block_top_k(rows: DataFrame, block: str, id_col: str, vec_col: str, k: int = 5, n_cells: int = 64) -> DataFrame:
    """``rows`` -> ``block, query_id, rank, neighbor_id, distance``: for every
    row the ``k`` nearest others of its block (cosine distance to 6 decimals,
    ties to the smaller id).

    Rows without a block or a vector are left out; a block of one row gives
    nothing. A zero vector is at distance 1 from every other. Ids must be
    unique within a block."""
    spark = rows.sparkSession
    base = (rows.where(F.col(block).isNotNull() & F.col(vec_col).isNotNull())
            .select(F.col(block).cast("string").alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")))
    found = f"block {rows.schema[block].dataType.simpleString()}, query_id long, rank int, neighbor_id long, distance double"
    first = base.select("vec").first()
    if first is None:
        return spark.createDataFrame([], found)
    dim, cells = len(first.vec), _cells(base, n_cells)
    shared = spark.sparkContext.broadcast(cells)
    sizes, _ = write_table(base.groupBy(F.col("block").alias("name")).agg(F.count("*").alias("block_rows")).withColumn("block", F.monotonically_increasing_id()))
    base = base.withColumnRenamed("block", "name").join(sizes, "name").drop("name")

    def assign(frames):
        for frame in frames:
            if len(frame):
                away = _centroid_dist(_unit(_stack(frame["vec"], dim)), shared.value)
                whole = (frame["block_rows"] <= GROUP_ROWS).to_numpy()  # one cell is enough
                cell = np.where(whole, -1, away.argmin(axis=1))
                yield pd.DataFrame({"block": frame["block"], "id": frame["id"], "vec": frame["vec"], "cell": cell.astype("int32"),
                                    "away": np.where(whole, 0.0, away[np.arange(len(cell)), np.maximum(cell, 0)])})

    member, member_path = write_table(base.mapInPandas(assign, "block long, id long, vec array<float>, cell int, away double"))
    stats, _ = write_table(member.groupBy("block", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")))
    parts = F.ceil(F.col("n") / GROUP_ROWS)
    search = _topk_block(k, True, dim)

    def probe(queries: DataFrame) -> DataFrame:
        """Best ``k`` of each of ``queries(block, cell, qid, vec)`` in its cell."""
        counts = queries.groupBy("block", "cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("query_parts"))
        cut = counts.join(stats.select("block", "cell", parts.alias("parts")), ["block", "cell"])
        q = (queries.join(cut, ["block", "cell"]).withColumn("query_part", F.pmod(F.xxhash64("qid"), "query_parts"))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("block", "cell", "query_part", "part", "qid", "vec"))
        b = (member.join(cut, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
             .withColumn("query_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1))).select("block", "cell", "query_part", "part", "id", "vec"))
        keys = ["block", "cell", "query_part", "part"]

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            own = search(left, right)
            return pd.DataFrame({"block": [key[0]] * len(own), **{c: own[c] for c in ("query_id", "neighbor_id", "distance")}})
        # both sides may come from the same table: fresh names for one of them
        other = b.select(*(F.col(c).alias(f"{c}_") for c in keys), F.col("id").alias("id"), F.col("vec").alias("vec"))
        pairs = q.select(*(F.col(c).alias(c) for c in keys), F.col("qid").alias("qid"), F.col("vec").alias("vec")).groupBy(*keys).cogroup(other.groupBy(*(f"{c}_" for c in keys))).applyInPandas(run, f"block long, {_PAIR}")
        best = Window.partitionBy("block", "query_id").orderBy("distance", "neighbor_id")
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    one, one_path = write_table(probe(member.select("block", "cell", F.col("id").alias("qid"), "vec")))
    # other cells of the same block whose bound can still beat the k-th distance
    reach = one.groupBy("block", F.col("query_id").alias("qid")).agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    asked = (member.where("cell >= 0").select("block", F.col("id").alias("qid"), "vec", F.col("cell").alias("own"))
             .join(reach, ["block", "qid"], "left").select("block", "qid", "vec", "own", F.expr(f"CASE WHEN n >= {k} THEN far ELSE 2.0D END").alias("far"))
             .join(stats.select("block", F.col("cell").alias("cell"), "radius"), "block").where("cell <> own"))

    def near(frames):
        for frame in frames:
            if len(frame):
                units, cells_ = _unit(_stack(frame["vec"], dim)), shared.value[frame["cell"].to_numpy()]
                gap = np.sqrt(((units - cells_) ** 2).sum(axis=1))
                least = np.maximum(0.0, gap - frame["radius"].to_numpy()) ** 2 / 2
                own = least <= frame["far"].to_numpy() + 10.0 ** -DIST_DP
                yield frame.loc[own, ["block", "cell", "qid", "vec"]]

    more, more_path = write_table(asked.select("block", "cell", "qid", "vec", "radius", "far").mapInPandas(near, "block long, cell int, qid long, vec array<float>"))
    both = one.drop("rank").unionByName(probe(more).drop("rank"))
    best = Window.partitionBy("block", "query_id").orderBy("distance", "neighbor_id")
    out, _ = write_table(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    for path in (member_path, one_path, more_path):
        drop_table(spark, path)
    out = out.join(sizes.select("block", "name"), "block").drop("block").withColumnRenamed("name", "block")
    return out.select(F.col("block").cast(rows.schema[block].dataType).alias("block"), "query_id", "rank", "neighbor_id", "distance")
