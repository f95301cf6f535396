import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.operators import holt_winters as hw
from clientlens.operators.forecast import forecast


def plain(y, horizon, weights):
    """Textbook additive recursion for one set of weights."""
    a, b, g = weights
    first = sum(y[:12]) / 12
    trend = (sum(y[12:24]) / 12 - first) / 12
    level = first + trend * 5.5
    season = [y[m] - (first + trend * (m - 5.5)) for m in range(12)]
    errors = []
    for t in range(12, len(y)):
        guess = level + trend + season[t % 12]
        errors.append(y[t] - guess)
        old = level
        level = a * (y[t] - season[t % 12]) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        season[t % 12] = g * (y[t] - level) + (1 - g) * season[t % 12]
    return [level + trend * h + season[(len(y) - 1 + h) % 12] for h in range(1, horizon + 1)], sum(e * e for e in errors), math.sqrt(sum(e * e for e in errors) / len(errors))


def series(seed, n, jump=False):
    rng = np.random.default_rng(seed)
    x = np.arange(n)
    return 500 + (x * 3.0 if not jump else np.where(x < n * 0.6, x * 1.0, 900 - x * 4.0)) + 40 * np.sin(x / 12 * 2 * np.pi) + rng.normal(size=n) * 5


def test_recursion_equals_the_textbook():
    y = series(1, 50, jump=True)
    found, noise = hw.holt_winters(y, 8)
    runs = [plain(y.tolist(), 8, w) for w in hw.WEIGHTS]
    best = min(runs, key=lambda r: r[1])
    assert np.allclose(found, best[0]) and noise == pytest.approx(best[2])


def test_line_equals_the_grouped_forecast(spark):
    y = series(2, 40)
    rows = [("a", datetime.date(2018 + m // 12, m % 12 + 1, 1), float(round(v, 4))) for m, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, t date, v double")
    want = [r.forecast_value for r in forecast(df, "v", "t", ["k"], 6).orderBy("forecast_timestamp").collect()]
    assert np.allclose(hw.line_and_season(np.array([r[2] for r in rows]), 6)[0], want, atol=1e-3)


def test_the_better_method_is_taken_for_each_series(spark):
    rows = []
    for k, y in {"steady": series(3, 60), "turning": series(4, 60, jump=True), "short": series(5, 20), "two": np.array([1.0, 3.0])}.items():
        rows += [(k, i, datetime.date(2015 + m // 12, m % 12 + 1, 1), float(v), "x") for i, part in enumerate((0.25, 0.75)) for m, v in enumerate(y * part)]
    rows += [("gap", 0, datetime.date(2015, 1, 1), 5.0, "x"), ("gap", 0, datetime.date(2015, 4, 9), 5.0, "x"), ("gap", 0, None, 5.0, "x"), ("gap", 0, datetime.date(2015, 3, 1), None, "x"), (None, 0, datetime.date(2015, 1, 1), 7.0, "x")]
    df = spark.createDataFrame(rows, "k string, part int, t date, v double, method string").repartition(3)
    found = {}
    for r in hw.forecast_best(df, "v", "t", ["k"], 6, 0.9).orderBy("forecast_timestamp").collect():
        found.setdefault(r.k, []).append(r)
    assert set(found) == {"steady", "turning", "short", "two", "gap", None} and all(len(v) == 6 for v in found.values())
    assert found["turning"][0].method == "holt_winters" and found["turning"][0].mae_holt_winters < found["turning"][0].mae_line
    assert found["short"][0].method == "line" and found["short"][0].mae_line is None
    assert found["gap"][0].forecast_timestamp == datetime.date(2015, 5, 1)
    for k, y in (("steady", series(3, 60)), ("turning", series(4, 60, jump=True))):
        line, own = [], []
        for cut in (42, 48, 54):  # three cuts, six months apart
            line.append(np.abs(hw.line_and_season(y[:cut], 6)[0] - y[cut:cut + 6]).mean())
            best = min((plain(y[:cut].tolist(), 6, w) for w in hw.WEIGHTS), key=lambda r: r[1])
            own.append(np.abs(np.array(best[0]) - y[cut:cut + 6]).mean())
        r = found[k][0]
        assert (r.mae_line, r.mae_holt_winters) == (pytest.approx(np.mean(line), abs=1e-3), pytest.approx(np.mean(own), abs=1e-3))
        value = (hw.holt_winters if r.method == "holt_winters" else hw.line_and_season)(y, 6)[0]
        assert np.allclose([x.forecast_value for x in found[k]], value, atol=1e-3)
    assert all(r.prediction_interval_lower_bound <= r.forecast_value <= r.prediction_interval_upper_bound for v in found.values() for r in v)
    assert hw.forecast_best(df.where(F.lit(False)), "v", "t", ["k"]).collect() == []
