"""TVF-06 (b): Holt-Winters forecasts, and the better method for each series.

Level, trend and season are a recursive state, so a series is one group and is
run through in order; its points are monthly, one a month, and a group is
bounded by the months that a series has. Many series share a task. The
smoothing weights come from a fixed grid by the squared error of one-step
forecasts. A rolling back-test compares the method with the straight line plus
season of :mod:`.forecast`: the series is cut at several ends, both methods see
only what lies before a cut, and the mean absolute error over the months after
it decides."""

from __future__ import annotations

import itertools
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON = 12
#: Grid of the weights of level, trend and season.
WEIGHTS = [np.array(w) for w in itertools.product((0.1, 0.3, 0.5, 0.8), (0.0, 0.1, 0.3), (0.05, 0.2, 0.5))]
_GRID = np.array(WEIGHTS)


def smoothed(y: np.ndarray, season: int = SEASON) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Additive Holt-Winters over one series for all weights of the grid at
    once: (last level, last trend, last seasons, one-step errors), a row for
    each weights. Needs two whole seasons; the first gives the start: its mean,
    the mean step to the second, and what each month is off the mean."""
    a, b, g = _GRID.T
    first, second = y[:season], y[season:2 * season]
    trend = np.full(len(_GRID), (second.mean() - first.mean()) / season)
    level = first.mean() + trend * (season - 1) / 2  # at the first season's end
    line = first.mean() + trend[0] * (np.arange(season) - (season - 1) / 2)
    seasons = np.tile(first - line, (len(_GRID), 1))
    errors = np.empty((len(_GRID), len(y) - season))
    for t in range(season, len(y)):
        m = t % season
        guess = level + trend
        errors[:, t - season] = y[t] - guess - seasons[:, m]
        level = a * (y[t] - seasons[:, m]) + (1 - a) * guess
        trend = b * (level - (guess - trend)) + (1 - b) * trend
        seasons[:, m] = g * (y[t] - level) + (1 - g) * seasons[:, m]
    return level, trend, seasons, errors


def holt_winters(y: np.ndarray, horizon: int, season: int = SEASON) -> tuple[np.ndarray, float]:
    """(forecasts of the next ``horizon`` points, standard deviation of the
    one-step errors) by the weights with the smallest squared error."""
    level, trend, seasons, errors = smoothed(y, season)
    best = int(np.argmin((errors ** 2).sum(axis=1)))
    steps = np.arange(1, horizon + 1)
    return level[best] + trend[best] * steps + seasons[best][(len(y) - 1 + steps) % season], float(np.sqrt((errors[best] ** 2).mean()))


def line_and_season(y: np.ndarray, horizon: int, season: int = SEASON) -> tuple[np.ndarray, float]:
    """The method of :func:`.forecast.forecast` on a series without gaps."""
    n = len(y)
    x = np.arange(n)
    gap = x - x.mean()
    slope = float(gap @ y / (gap @ gap)) if n > 1 else 0.0
    start = float(y.mean() - slope * x.mean())
    rest = y - (start + slope * x)
    month = np.array([rest[m::season].mean() if len(rest[m::season]) >= 2 else 0.0 for m in range(season)])
    off = rest - month[x % season]
    steps = n - 1 + np.arange(1, horizon + 1)
    return start + slope * steps + month[steps % season], float(off.std(ddof=1)) if n > 1 else 0.0


def back_test(y: np.ndarray, horizon: int, folds: int) -> tuple[float, float] | None:
    """Mean absolute error of (line, Holt-Winters) over the months after each
    of ``folds`` cuts, ``horizon`` months apart; none where the first part
    would be shorter than two seasons and a half."""
    cuts = [len(y) - horizon * k for k in range(folds, 0, -1) if len(y) - horizon * k >= SEASON * 5 // 2]
    if not cuts:
        return None
    line, hw = [], []
    for cut in cuts:
        line.append(np.abs(line_and_season(y[:cut], horizon)[0] - y[cut:cut + horizon]).mean())
        hw.append(np.abs(holt_winters(y[:cut], horizon)[0] - y[cut:cut + horizon]).mean())
    return float(np.mean(line)), float(np.mean(hw))


def forecast_best(df: DataFrame, data_col: str, timestamp_col: str, id_cols: list[str], horizon: int = 12,
                  confidence_level: float = 0.9, folds: int = 3, test_horizon: int = 6) -> DataFrame:
    """``id_cols, forecast_timestamp, forecast_value`` with its interval,
    ``method``, ``mae_line`` and ``mae_holt_winters`` for each series.

    Values of one month are added up; a month without a row between the first
    and the last counts as 0; rows with a null date or value are left out.
    Where a series is too short for the back-test the line is taken and the
    errors are null; equal errors take the line. Values have 4 decimals."""
    z = NormalDist().inv_cdf((1 + confidence_level) / 2)
    points = (df.where(F.col(timestamp_col).isNotNull() & F.col(data_col).isNotNull())
              .groupBy(*id_cols, F.trunc(F.col(timestamp_col).cast("date"), "MM").alias("_month")).agg(F.sum(F.col(data_col).cast("decimal(38,8)")).cast("double").alias("_y")))
    kinds = [f"{c} {points.schema[c].dataType.simpleString()}" for c in id_cols]
    schema = ", ".join([*kinds, "forecast_timestamp date, forecast_value double, prediction_interval_lower_bound double, prediction_interval_upper_bound double, "
                                "method string, mae_line double, mae_holt_winters double"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_month")
        months = np.array([m.year * 12 + m.month - 1 for m in frame["_month"]])
        y = np.zeros(int(months[-1] - months[0]) + 1)
        y[months - months[0]] = frame["_y"].to_numpy()
        errors = back_test(y, test_horizon, folds)
        method = "holt_winters" if errors and errors[1] < errors[0] else "line"
        value, noise = (holt_winters if method == "holt_winters" else line_and_season)(y, horizon)
        steps = np.arange(1, horizon + 1)
        half = z * noise * np.sqrt(1 + steps / len(y))
        ahead = months[-1] + steps
        out = {c: [k] * horizon for c, k in zip(id_cols, key, strict=True)}
        out |= {"forecast_timestamp": [pd.Timestamp(int(m // 12), int(m % 12) + 1, 1).date() for m in ahead], "forecast_value": np.round(value, 4),
                "prediction_interval_lower_bound": np.round(value - half, 4), "prediction_interval_upper_bound": np.round(value + half, 4), "method": [method] * horizon,
                "mae_line": [round(errors[0], 4) if errors else None] * horizon, "mae_holt_winters": [round(errors[1], 4) if errors else None] * horizon}
        return pd.DataFrame(out)

    return points.groupBy(*id_cols).applyInPandas(run, schema)
