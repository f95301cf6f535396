"""Segment drill-down (RM-13) and forecast view (RM-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_before, year_month
from ..functions.numeric import MONEY, rnd
from ..functions.text import banking_label
from ..operators.canonical import AS_OF, Client360, months_before_py
from ..operators.forecast import forecast, heuristic_anomalies
from ..operators.keydrivers import KD_METRICS
from ..operators.segments_filter import free_dimensions, parse_segment
from .readmodels import monthly_history


def segment_base(c: Client360, seg: str, as_of: str = AS_OF, window_months: int = 12) -> DataFrame:
    """Flows of the segment's clients over the trailing window (FLT-09, FLT-10)."""
    pred, _ = parse_segment(seg)
    cl = (c.clients.select("client_key", "segment_tier", "region", "booking_centre", "risk_profile", "dual_banked")
          .withColumn("banking", banking_label("dual_banked")).filter(pred))
    flows = c.client_flows_from(months_before_py(as_of, window_months))
    return flows.filter(F.col("month") >= months_before(as_of, window_months)).join(cl, "client_key")


def segment_trend(c: Client360, metric: str, seg: str, as_of: str = AS_OF) -> DataFrame:
    """RM-13 "what happened": monthly USD m (2 dp) with anomaly flags
    (WIN-04 / WIN-06 heuristic; prior average over the real prior count)."""
    col = KD_METRICS[metric][0]
    t = (segment_base(c, seg, as_of).groupBy(year_month("month").alias("ts"))
         .agg(rnd(F.sum(col).cast("double") / 1e6, 2).alias("value")))
    return heuristic_anomalies(t, "value", "ts")


def segment_factors(c: Client360, metric: str, seg: str, as_of: str = AS_OF, k: int = 3) -> DataFrame:
    """RM-13 "why" / AGG-13: change by the first dimension the segment leaves
    free: ``(Σ recent − Σ prior) / 1e6`` (1 dp), top k by |impact|."""
    col = KD_METRICS[metric][0]
    _, pairs = parse_segment(seg)
    free = free_dimensions(pairs)
    if not free:
        return c.spark.createDataFrame([], "factor string, impact_usd_m double")
    sub = free[0]
    cut = months_before(as_of, 6)
    zero = F.lit(0).cast(MONEY)
    g = (segment_base(c, seg, as_of).groupBy(F.col(sub).alias("k"))
         .agg((F.sum(F.when(F.col("month") >= cut, F.col(col)).otherwise(zero))
               - F.sum(F.when(F.col("month") < cut, F.col(col)).otherwise(zero))).alias("d"))
         .select(F.concat(F.lit(sub.replace("_", " ") + ": "), F.col("k").cast("string")).alias("factor"),
                 rnd(F.col("d").cast("double") / 1e6, 1).alias("impact_usd_m")))
    return g.orderBy(F.abs("impact_usd_m").desc(), "factor").limit(k)


def segment_forecast(c: Client360, metric: str, seg: str, as_of: str = AS_OF, horizon: int = 6,
                     confidence_level: float = 0.9) -> DataFrame:
    """RM-13 "what's next": forecast of the segment's monthly series (USD m, 2 dp)."""
    col = KD_METRICS[metric][0]
    s = segment_base(c, seg, as_of).groupBy("month").agg(F.sum(col).alias("v"))
    f = forecast(s, "v", "month", None, horizon, confidence_level)
    return f.select(year_month("forecast_timestamp").alias("ts"),
                    rnd(F.col("forecast_value") / 1e6, 2).alias("yhat"),
                    rnd(F.col("prediction_interval_lower_bound") / 1e6, 2).alias("lo"),
                    rnd(F.col("prediction_interval_upper_bound") / 1e6, 2).alias("hi"))


def forecast_view(c: Client360, metric: str = "aum", division: str = "all", region: str = "all",
                  horizon: int = 12, confidence_level: float = 0.9) -> DataFrame:
    """RM-11: history + summed forecast and bounds (SET-04).

    Bounds are plain sums of the per-series bounds, as in the reference —
    not a joint interval.  A bridge row repeats the last actual as the
    first forecast point so the two lines connect."""
    ts = c.ts_monthly(metric)
    hist = monthly_history(ts, division, region)
    f = ts
    if division and division != "all":
        f = f.filter(F.col("division") == division)
    if region and region != "all":
        f = f.filter(F.col("region") == region)
    fc = (forecast(f, "value", "month", ["division", "region"], horizon, confidence_level)
          .groupBy(year_month("forecast_timestamp").alias("ts"))
          .agg(rnd(F.sum(F.col("forecast_value").cast("decimal(38,4)")).cast("double"), 2).alias("yhat"),
               rnd(F.sum(F.col("prediction_interval_lower_bound").cast("decimal(38,4)")).cast("double"), 2).alias("lo"),
               rnd(F.sum(F.col("prediction_interval_upper_bound").cast("decimal(38,4)")).cast("double"), 2).alias("hi")))
    last = hist.orderBy(F.col("ts").desc()).limit(1)
    bridge = last.select("ts", "yhat", F.col("yhat").alias("lo"), F.col("yhat").alias("hi"),
                         F.lit("bridge").alias("kind"), F.lit(None).cast("double").alias("actual"))
    h = hist.select("ts", "yhat", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                    F.lit("history").alias("kind"), F.col("yhat").alias("actual"))
    fo = fc.select("ts", "yhat", "lo", "hi", F.lit("forecast").alias("kind"), F.lit(None).cast("double").alias("actual"))
    return h.unionByName(bridge).unionByName(fo)
