"""Key-driver read models: RM-12 (ranked list), RM-13 (segment drill-down)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import bar_scale, rnd
from ..functions.text import kv_label, money_label, parse_kv_tokens, signed_pct
from ..operators.canonical import AS_OF, Client360, months_before_py
from ..operators.keydrivers import (KD_DIMS, KD_METRICS, KD_PARAMS, OUTPUT_COLUMNS, WIDE_DIMS, flow_drivers_input,
                                    key_drivers, wide_drivers_input)


def key_drivers_table(c: Client360, metric: str = "nna", as_of: str = AS_OF, **overrides) -> DataFrame:
    """One of the reference's three key-driver instances (nna / inflow / outflow)."""
    col = KD_METRICS[metric][0]
    params = {**KD_PARAMS[metric], **overrides}
    inp = flow_drivers_input(c.clients, c.client_flows_from(months_before_py(as_of, 12)), as_of)
    return key_drivers(inp, col, KD_DIMS, "is_recent", **params)


def key_drivers_wide(c: Client360, metric: str, min_apriori_support: float, as_of: str = AS_OF) -> DataFrame:
    """Drivers over twelve client dimensions, by level-wise search."""
    inp = wide_drivers_input(c.clients, c.client_flows_from(months_before_py(as_of, 12)), as_of)
    return key_drivers(inp, KD_METRICS[metric][0], WIDE_DIMS, "is_recent", min_apriori_support=min_apriori_support)


def flatten_drivers(kd: DataFrame) -> DataFrame:
    """``drivers`` array → ``; ``-joined text (for tabular comparison)."""
    return kd.select(F.array_join("drivers", "; ").alias("drivers"), *OUTPUT_COLUMNS[1:], "n_dimensions")


def key_drivers_view(c: Client360, metric: str = "nna", n: int = 12, as_of: str = AS_OF) -> DataFrame:
    """RM-12: top ``n`` segments by |unexpected difference| in USD m.

    Population totals (from the ``['all']`` row) are the headline figures;
    ``listed_*`` are the sums over the listed, overlapping segments (D5).
    """
    _, _, favourable = KD_METRICS[metric]
    kd = key_drivers_table(c, metric, as_of)
    pop = {"pi": F.col("population_interest"), "pr": F.col("population_reference")}
    top = (kd.filter(F.col("n_dimensions") > 0)
           .orderBy(F.abs("unexpected_difference").desc(), F.array_join("drivers", "|"))
           .limit(n))  # the top-n list is the feature
    listed = Window.partitionBy()  # over the n listed rows only (after the limit)
    out = top.select(
        kv_label(parse_kv_tokens("drivers")).alias("label"),
        F.array_join("drivers", "|").alias("segment"),
        rnd(F.col("metric_interest") / 1e6, 2).alias("metric_interest_usd_m"),
        rnd(F.col("metric_reference") / 1e6, 2).alias("metric_reference_usd_m"),
        rnd(F.col("difference") / 1e6, 2).alias("difference_usd_m"),
        rnd(F.coalesce("relative_difference", F.lit(0.0)), 4).alias("relative_difference"),
        rnd(F.col("unexpected_difference") / 1e6, 2).alias("unexpected_difference_usd_m"),
        rnd(F.coalesce("contribution", F.lit(0.0)), 4).alias("contribution"),
        rnd(F.coalesce("apriori_support", F.lit(0.0)), 4).alias("apriori_support"),
        F.when(F.col("difference") >= 0, "up").otherwise("down").alias("direction"),
        ((F.col("difference") >= 0) == F.lit(favourable == "higher")).alias("favourable"),
        rnd(pop["pi"] / 1e6, 1).alias("total_interest_usd_m"),
        rnd(pop["pr"] / 1e6, 1).alias("total_reference_usd_m"),
        rnd((pop["pi"] - pop["pr"]) / 1e6, 1).alias("net_change_usd_m"),
        rnd(F.sum(F.col("metric_interest").cast("decimal(38,2)")).over(listed).cast("double") / 1e6, 1)
        .alias("listed_interest_usd_m"),
        rnd(F.sum(F.col("metric_reference").cast("decimal(38,2)")).over(listed).cast("double") / 1e6, 1)
        .alias("listed_reference_usd_m"),
        money_label("metric_interest").alias("interest_label"),
        F.to_json("drivers").alias("drivers_json"),
    )
    return (out.withColumn("relative_change_label", signed_pct("relative_difference"))
            .withColumn("bar_pct", rnd(bar_scale("unexpected_difference_usd_m",
                                                 F.max(F.abs("unexpected_difference_usd_m")).over(listed)), 1)))


def segment_key_drivers(c: Client360, metric: str, seg: str, top_k: int = 10, as_of: str = AS_OF) -> DataFrame:
    """TVF-03: key drivers inside a segment over the dimensions it leaves free."""
    from ..operators.segments_filter import free_dimensions, parse_segment
    pred, pairs = parse_segment(seg)
    col = KD_METRICS[metric][0]
    inp = flow_drivers_input(c.clients, c.client_flows_from(months_before_py(as_of, 12)), as_of)
    inp = inp.withColumn("dual_banked", F.col("banking").startswith("Dual")).filter(pred)
    return key_drivers(inp, col, free_dimensions(pairs), "is_recent", top_k=top_k)


def segment_stats(kd: DataFrame, seg: str) -> DataFrame:
    """JN-11: the driver row whose (name, value) pairs equal the requested
    segment's as a set (order-insensitive)."""
    pairs = [p.split(":", 1) for p in seg.split("|") if ":" in p]
    want = F.array_sort(F.array(*[F.struct(F.lit(n.strip()).alias("name"), F.lit(v.strip()).alias("value"))
                                  for n, v in pairs]))
    return kd.filter(F.array_sort(parse_kv_tokens("drivers")) == want)
