"""Key drivers by level-wise (Apriori) search, for many dimensions.

All grouping sets of 12 dimensions are 4,096 times the leaf cells. With a
metric that is never negative a segment's support is at most that of each
segment it lies in, so the search can go by order instead:

1. leaf cells and, from them, the values of single dimensions with enough
   support (order 1). Values without it are taken out of the cells, and cells
   that are then equal become one;
2. order n: every surviving segment of order n - 1 is extended by the items to
   its right in the cells that it holds. A candidate stays only if the segment
   of its last n - 1 items survived, too. What is left of a cell to the right
   of a segment is all that later orders need, so rows are added up by
   (segment, rest): the table a level leaves shrinks with the rest;
3. sums by segment, support, survivors; the table is kept for survivors only.

Survivors are few by the support itself: a set of dimensions has at most
``2 / min_apriori_support`` of them. They are broadcast while a counted size
allows, and joined beyond it. Without a support over 0 nothing can be pruned:
results are the same, the search then visits every segment of the cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .keydrivers import NEGATIVE, measures, selected

#: Survivors or items that are broadcast; beyond, they are joined.
BROADCAST_ROWS = 200_000
_SUMS = ("_mi", "_mr", "_n")


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` as a table, and their number, from one pass."""
    seen = Observation()
    table, _ = write_table(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _item(j: int) -> Column:
    """Dimension ``j`` of a cell as one word; a null value has a word of its own."""
    return F.expr(f"CASE WHEN _d{j} IS NULL THEN '{j:02d}!' ELSE concat('{j:02d}=', _d{j}) END")


def _extended(table: DataFrame) -> DataFrame:
    """Every segment of ``table(seg, rest)`` with each item of its rest; what
    is to the right of that item is the new rest."""
    return (table.select("seg", "rest", F.posexplode("rest").alias("at", "item"), *_SUMS)
            .select(F.expr("concat(seg, array(item))").alias("seg"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"), *_SUMS))


def key_drivers_by_levels(df: DataFrame, metric_col: str, dimension_cols: list[str], interest_label_col: str,
                          top_k: int | None = None, min_apriori_support: float | None = None,
                          enable_pruning: bool = True, max_order: int | None = None,
                          baseline: str = "population") -> DataFrame:
    """The rows of :func:`~.keydrivers.key_drivers`, found level by level.

    A null dimension value is a value like any other (its token is left out of
    ``drivers``). An empty ``df`` gives the population row alone. The metric may
    be negative only without support and ``top_k``; otherwise this raises.
    A level's table is written to the checkpoint folder and dropped once the
    next one is there; the survivors stay."""
    dims, bound, spark = list(dimension_cols), float(min_apriori_support or 0.0), df.sparkSession
    lab, met = f"`{interest_label_col}`", f"`{metric_col}`"
    zero = f"CAST(0 AS {df.schema[metric_col].dataType.simpleString()})"
    leaf, leaf_path = write_table(
        df.groupBy(*[F.expr(f"CAST(`{c}` AS STRING)").alias(f"_d{j}") for j, c in enumerate(dims)])
        .agg(F.expr(f"sum(CASE WHEN {lab} THEN {met} ELSE {zero} END)").alias("_mi"),
             F.expr(f"sum(CASE WHEN NOT {lab} THEN {met} ELSE {zero} END)").alias("_mr"),
             F.expr(f"count(CASE WHEN {lab} IS NOT NULL THEN 1 END)").alias("_n"), F.expr(f"min({met})").alias("_min")))
    totals, _ = write_table(leaf.agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("_min").alias("_mn"), F.expr("sum(abs(_mi - _mr))").alias("_abs_leaf")))
    all_ = totals.first()
    if all_["_mn"] is not None and all_["_mn"] < 0 and (bound > 0 or top_k is not None):
        raise ValueError(NEGATIVE)
    known = {"_ti": F.lit(all_["_mi"]).cast(totals.schema["_mi"].dataType), "_tr": F.lit(all_["_mr"]).cast(totals.schema["_mr"].dataType),
             "_abs_leaf": F.lit(all_["_abs_leaf"]).cast(totals.schema["_abs_leaf"].dataType)}
    support = measures("population")["apriori_support"]

    def enough(rows: DataFrame) -> DataFrame:
        return rows.withColumns(known).filter(f"{support} >= {bound!r}").drop(*known) if bound > 0 else rows

    # order 1, and the cells without the items that did not survive
    items = leaf.select(F.explode(F.array(*[_item(j) for j in range(len(dims))])).alias("item"), *_SUMS)
    items, alive = _counted(enough(_added(items, "item")))
    for j in range(len(dims)):
        own = items.filter(F.col("item").startswith(f"{j:02d}")).select(F.col("item").alias(f"_i{j}"))
        leaf = leaf.join(_small(own, alive), _item(j) == F.col(f"_i{j}"), "left")
    rest = F.filter(F.array(*[F.col(f"_i{j}") for j in range(len(dims))]), lambda x: x.isNotNull())
    cells = leaf.select(F.array().cast("array<string>").alias("seg"), rest.alias("rest"), *_SUMS).filter("size(rest) > 0")
    table, path = write_table(_added(cells, "seg", "rest"))
    drop_table(spark, leaf_path)

    level = items.select(F.array("item").alias("seg"), *_SUMS)
    levels, order = [level], 1
    table, last = write_table(_added(_extended(table), "seg", "rest"))
    drop_table(spark, path)
    while order < (max_order or len(dims)) and alive:
        order += 1
        grown = _extended(table.filter("size(rest) > 0"))
        if order > 2:
            grown = grown.join(_small(level.select(F.col("seg").alias("_seg")), alive), F.expr(f"slice(seg, 2, {order - 1}) = _seg"), "left_semi")
        table, path = write_table(_added(grown, "seg", "rest"))
        drop_table(spark, last)
        level, alive = _counted(enough(_added(table, "seg")))
        last = path
        levels.append(level)
        table = table.join(_small(level.select(F.col("seg").alias("_seg")), alive), F.expr("seg = _seg"), "left_semi")
    drop_table(spark, last)

    found = totals.select(F.array().cast("array<string>").alias("seg"), *_SUMS)
    for level in levels:
        found = found.unionByName(level)
    found, _ = write_table(found)  # as a table its keys are no constants that would turn the joins below into products
    if enable_pruning:
        # a segment's rows are a subset of those of the segments one item
        # shorter, so equal numbers mean the same rows
        shorter = found.select("seg", "_n", F.explode(F.expr("transform(seg, (x, i) -> filter(seg, (y, j) -> j != i))")).alias("_short"))
        same = shorter.join(found.select(F.col("seg").alias("_short"), "_n"), ["_short", "_n"]).select("seg").distinct()
        found = found.join(same, "seg", "left_anti")
    names = ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in dims)
    tokens = f"transform(filter(seg, x -> substr(x, 3, 1) = '='), x -> concat(element_at(array({names}), int(substr(x, 1, 2)) + 1), substr(x, 3)))"
    out = found.withColumns(known).select(
        F.expr(f"CASE WHEN size({tokens}) = 0 THEN array('all') ELSE {tokens} END").alias("drivers"),
        *[F.expr(sql).alias(name) for name, sql in measures(baseline).items()], F.size("seg").alias("_order"),
        F.col("_ti").cast("double").alias("population_interest"), F.col("_tr").cast("double").alias("population_reference"))
    return selected(out, top_k, min_apriori_support)
