"""Multi-series forecasting (TVF-06) and anomaly detection (TVF-07).

The hosted forecasting model of the reference is unavailable; these are our
definitions, computed per series entirely with grouped aggregates and joins
(every series is independent, so the work partitions by series id):

* **trend**: ordinary least squares of value on the month index
  ``x = 12·year + month``, from exact decimal sums Σx, Σy, Σxy, Σx² (so the
  fit does not depend on summation order);
* **season**: mean trend residual per calendar month;
* **noise**: sample standard deviation of the de-seasonalised residual;
* **forecast** for step h: ``a + b·x_h + season(x_h)``; interval
  ``± z·σ·sqrt(1 + h/n)``, z the two-sided normal quantile of
  ``confidence_level``.

``detect_anomalies`` scores each point by the z-score of its residual from
the series' own trend + season, ``probability = 2Φ(|z|) − 1``.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf, rnd

Y = "decimal(26,8)"  # values up to 10^18
FIRST_MONTH = 1990 * 12  # months count from here, so that their sums stay small


def _single_series_key(ts_col: str) -> F.Column:
    """Series id for a frame without id columns.  It is built from a data
    column (``'all' || ''``) so Catalyst cannot constant-fold it and the
    per-series joins stay hash equi-joins instead of becoming a cross join."""
    return F.concat(F.lit("all"), F.substring(F.col(ts_col).cast("string"), 1, 0))


def month_index(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.year(c) * 12 + F.month(c)).cast("long")


def _fit(df: DataFrame, ids: list[str], y: str, t: str) -> tuple[DataFrame, DataFrame]:
    """Per-series OLS (exact sums) and per-point residuals."""
    pts = df.select(*ids, F.col(t).cast("date").alias("_t"), F.col(y).cast(Y).alias("_y")) \
            .withColumn("_x", month_index("_t") - FIRST_MONTH)
    xd = F.col("_x").cast("decimal(6,0)")
    st = (pts.groupBy(*ids).agg(
        F.count("*").alias("_n"), F.sum(xd).alias("_sx"), F.sum("_y").alias("_sy"),
        F.sum(xd * F.col("_y")).alias("_sxy"), F.sum(xd * xd).alias("_sxx"), F.max("_x").alias("_last"),
        F.max("_t").alias("_last_t")))
    # Decimal widths keep every product and difference within 38 digits, so
    # no scale is dropped and the fit is exact up to the final double casts.
    n, sx = F.col("_n").cast("decimal(9,0)"), F.col("_sx").cast("decimal(9,0)")
    sy, sxy, sxx = F.col("_sy").cast("decimal(28,8)"), F.col("_sxy").cast("decimal(28,8)"), F.col("_sxx").cast("decimal(26,0)")
    num = (n * sxy - sx * sy).cast("double")
    den = (n * sxx - sx * sx).cast("double")
    slope = F.when(den != 0, num / den).otherwise(F.lit(0.0))
    st = st.withColumn("_b", slope).withColumn(
        "_a", (F.col("_sy").cast("double") - F.col("_b") * F.col("_sx").cast("double")) / F.col("_n").cast("double"))
    pts = pts.join(st.select(*ids, "_a", "_b"), ids).withColumn(
        "_r", F.col("_y").cast("double") - (F.col("_a") + F.col("_b") * F.col("_x").cast("double")))
    return st, pts


def _season(pts: DataFrame, ids: list[str]) -> DataFrame:
    """Seasonal part by calendar month; a month seen once says nothing of the
    season (its residual would vanish), so it has none."""
    return pts.groupBy(*ids, F.month("_t").alias("_moy")).agg(F.when(F.count("*") >= 2, F.avg("_r")).otherwise(F.lit(0.0)).alias("_s"))


def forecast(df: DataFrame, data_col: str, timestamp_col: str, id_cols: list[str] | None = None,
             horizon: int = 12, confidence_level: float = 0.9, seasonal: bool = True) -> DataFrame:
    """Monthly forecast per series.

    Output: ids, forecast_timestamp (date), forecast_value,
    prediction_interval_lower_bound, prediction_interval_upper_bound (4 dp).
    """
    ids = list(id_cols or [])
    if not ids:
        df = df.withColumn("_series", _single_series_key(timestamp_col))
        ids_work = ["_series"]
    else:
        ids_work = ids
    z = NormalDist().inv_cdf((1 + confidence_level) / 2)
    st, pts = _fit(df, ids_work, data_col, timestamp_col)
    if seasonal:
        seas = _season(pts, ids_work)
        pts = pts.withColumn("_moy", F.month("_t")).join(seas, ids_work + ["_moy"])
        resid = F.col("_r") - F.col("_s")
    else:
        resid = F.col("_r")
    sig = pts.groupBy(*ids_work).agg(F.coalesce(F.stddev_samp(resid), F.lit(0.0)).alias("_sig"))
    steps = (st.select(*ids_work, "_a", "_b", "_n", "_last", "_last_t",
                       F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
             .withColumn("_ft", F.add_months("_last_t", F.col("_h")))
             .withColumn("_moy", F.month("_ft"))
             .join(sig, ids_work))
    if seasonal:
        steps = steps.join(seas, ids_work + ["_moy"], "left")
        s = F.coalesce(F.col("_s"), F.lit(0.0))
    else:
        s = F.lit(0.0)
    val = F.col("_a") + F.col("_b") * (F.col("_last") + F.col("_h")).cast("double") + s
    half = F.lit(z) * F.col("_sig") * F.sqrt(F.lit(1.0) + F.col("_h") / F.col("_n"))
    out = steps.select(*ids, F.col("_ft").alias("forecast_timestamp"),
                       rnd(val, 4).alias("forecast_value"),
                       rnd(val - half, 4).alias("prediction_interval_lower_bound"),
                       rnd(val + half, 4).alias("prediction_interval_upper_bound"))
    return out


def detect_anomalies(df: DataFrame, data_col: str, timestamp_col: str, id_cols: list[str] | None = None,
                     anomaly_prob_threshold: float = 0.95, seasonal: bool = False) -> DataFrame:
    """Per point: is_anomaly, anomaly_probability = 2Φ(|z|) − 1 of the residual."""
    ids = list(id_cols or [])
    if not ids:
        df = df.withColumn("_series", _single_series_key(timestamp_col))
        ids_work = ["_series"]
    else:
        ids_work = ids
    st, pts = _fit(df, ids_work, data_col, timestamp_col)
    if seasonal:
        seas = _season(pts, ids_work)
        pts = (pts.withColumn("_moy", F.month("_t")).join(seas, ids_work + ["_moy"])
               .withColumn("_r", F.col("_r") - F.col("_s")))
    sig = pts.groupBy(*ids_work).agg(F.stddev_samp("_r").alias("_sig"))
    z = F.when(F.col("_sig") > 0, F.abs(F.col("_r")) / F.col("_sig")).otherwise(F.lit(0.0))
    prob = F.lit(2.0) * normal_cdf(z) - F.lit(1.0)
    return (pts.join(sig, ids_work)
            .select(*ids, F.col("_t").alias(timestamp_col), F.col("_y").cast("double").alias(data_col),
                    (prob > anomaly_prob_threshold).alias("is_anomaly"),
                    rnd(prob, 4).alias("anomaly_probability")))


def heuristic_anomalies(trend: DataFrame, value_col: str = "value", ts_col: str = "ts", last_n: int = 6,
                        down_factor: float = 0.85, up_factor: float = 1.15, legacy_divisor: int | None = None,
                        direction: str | None = None, id_cols: list[str] | None = None) -> DataFrame:
    """The in-code flag of the reference (WIN-04 / WIN-06, D13), for one
    short series (≤ a few dozen rows, e.g. a 13-month segment trend):
    the last ``last_n`` points are flagged below ``down_factor`` × prior
    average when the move is down, above ``up_factor`` × when up.  The
    prior average divides by the real count of prior points
    (``legacy_divisor=6`` reproduces the reference's fixed divisor)."""
    from pyspark.sql.window import Window
    keys = [F.col(c) for c in (id_cols or [])] or [F.lit(1)]  # per series; a series is short
    w_all = Window.partitionBy(*keys)
    w_ord = Window.partitionBy(*keys).orderBy(F.col(ts_col).desc())
    t = trend.withColumn("_pos", F.row_number().over(w_ord))
    recent = F.sum(F.when(F.col("_pos") <= last_n, F.col(value_col))).over(w_all)
    prior = F.sum(F.when(F.col("_pos") > last_n, F.col(value_col))).over(w_all)
    n_prior = F.count(F.when(F.col("_pos") > last_n, 1)).over(w_all)
    div = F.lit(float(legacy_divisor)) if legacy_divisor else n_prior.cast("double")
    prior_avg = F.when(div > 0, F.coalesce(prior, F.lit(0.0)) / div).otherwise(F.lit(0.0))
    down = (F.lit(direction == "down") if direction else (recent - F.coalesce(prior, F.lit(0.0))) < 0)
    flag = (F.col("_pos") <= last_n) & F.when(down, F.col(value_col) < prior_avg * down_factor) \
        .otherwise(F.col(value_col) > prior_avg * up_factor)
    return t.withColumn("is_anomaly", flag).drop("_pos")
