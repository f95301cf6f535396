"""Oracle SQL for forecasting (TVF-06), anomalies (TVF-07) and RM-11 / RM-13."""

from __future__ import annotations

from statistics import NormalDist

from ..operators.canonical import AS_OF
from ..operators.forecast import FIRST_MONTH
from .oracle_sql import R, months_before_sql, with_


def fit_ctes(src: str, ids: list[str], y: str, t: str) -> list[tuple[str, str]]:
    il = ", ".join(ids)
    return [
        ("pts0", f"SELECT {il}, CAST({t} AS DATE) AS _t, CAST({y} AS DECIMAL(26,8)) AS _y, "
                 f"CAST(year({t}) * 12 + month({t}) - {FIRST_MONTH} AS BIGINT) AS _x FROM {src}"),
        ("st", f"""SELECT {il}, COUNT(*) AS _n, SUM(CAST(_x AS DECIMAL(6,0))) AS _sx, SUM(_y) AS _sy,
                  SUM(CAST(_x AS DECIMAL(6,0)) * _y) AS _sxy, SUM(CAST(_x AS DECIMAL(6,0)) * CAST(_x AS DECIMAL(6,0))) AS _sxx,
                  MAX(_x) AS _last, MAX(_t) AS _last_t FROM pts0 GROUP BY {il}"""),
        ("st1", """SELECT *, CAST(CAST(_n AS DECIMAL(9,0)) * CAST(_sxy AS DECIMAL(28,8)) - CAST(_sx AS DECIMAL(9,0)) * CAST(_sy AS DECIMAL(28,8)) AS DOUBLE) AS _num,
                  CAST(CAST(_n AS DECIMAL(9,0)) * CAST(_sxx AS DECIMAL(26,0)) - CAST(_sx AS DECIMAL(9,0)) * CAST(_sx AS DECIMAL(9,0)) AS DOUBLE) AS _den
                  FROM st"""),
        ("st2", "SELECT *, CASE WHEN _den <> 0 THEN _num / _den ELSE 0.0 END AS _b FROM st1"),
        ("st3", "SELECT *, (CAST(_sy AS DOUBLE) - _b * CAST(_sx AS DOUBLE)) / CAST(_n AS DOUBLE) AS _a FROM st2"),
        ("pts", f"SELECT p.*, s._a, s._b, CAST(p._y AS DOUBLE) - (s._a + s._b * CAST(p._x AS DOUBLE)) AS _r "
                f"FROM pts0 p JOIN st3 s USING ({il})"),
    ]


def forecast_sql(src: str, ids: list[str], y: str, t: str, horizon: int, cl: float, out_ids: list[str],
                 extra: list[tuple[str, str]] | None = None, prefix: tuple[str, ...] = ()) -> tuple[str, str]:
    """(WITH clause, select) producing the forecast table ``fc``."""
    z = NormalDist().inv_cdf((1 + cl) / 2)
    il = ", ".join(ids)
    ctes = (extra or []) + fit_ctes(src, ids, y, t) + [
        ("seas", f"SELECT {il}, month(_t) AS _moy, CASE WHEN COUNT(*) >= 2 THEN AVG(_r) ELSE 0.0 END AS _s FROM pts GROUP BY {il}, month(_t)"),
        ("sig", f"SELECT p.{ids[0]}{''.join(', p.' + i for i in ids[1:])}, coalesce(stddev_samp(p._r - s._s), 0.0) AS _sig "
                f"FROM pts p JOIN seas s ON {' AND '.join(f'p.{i} = s.{i}' for i in ids)} AND month(p._t) = s._moy "
                f"GROUP BY {', '.join('p.' + i for i in ids)}"),
        ("steps", f"""SELECT st3.*, h.h AS _h, CAST(st3._last_t + to_months(CAST(h.h AS INTEGER)) AS DATE) AS _ft
                      FROM st3, range(1, {horizon + 1}) h(h)"""),
        ("fc", f"""SELECT {', '.join('x.' + i for i in ids)}, x._ft AS forecast_timestamp,
                     x._a + x._b * CAST(x._last + x._h AS DOUBLE) + coalesce(se._s, 0.0) AS _v,
                     CAST({z!r} AS DOUBLE) * g._sig * sqrt(1.0 + x._h / x._n) AS _half
                   FROM steps x JOIN sig g ON {' AND '.join(f'x.{i} = g.{i}' for i in ids)}
                   LEFT JOIN seas se ON {' AND '.join(f'x.{i} = se.{i}' for i in ids)} AND se._moy = month(x._ft)"""),
    ]
    w = with_(*prefix, extra=ctes)
    sel = ", ".join(out_ids + ["forecast_timestamp", f"{R('_v', 4)} AS forecast_value",
                               f"{R('_v - _half', 4)} AS prediction_interval_lower_bound",
                               f"{R('_v + _half', 4)} AS prediction_interval_upper_bound"])
    return w, sel


def normal_cdf_sql(z: str) -> str:
    x = f"abs({z})"
    t = f"(CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + CAST(0.2316419 AS DOUBLE) * {x}))"
    poly = (f"({t} * (CAST(0.319381530 AS DOUBLE) + {t} * (CAST(-0.356563782 AS DOUBLE) + {t} * ("
            f"CAST(1.781477937 AS DOUBLE) + {t} * (CAST(-1.821255978 AS DOUBLE) + {t} * CAST(1.330274429 AS DOUBLE))))))")
    pdf = f"(exp((-{x}) * {x} / 2.0) / CAST(2.5066282746310002 AS DOUBLE))"
    upper = f"(CAST(1.0 AS DOUBLE) - {pdf} * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE CAST(1.0 AS DOUBLE) - {upper} END)"


def anomalies_sql(src: str, ids: list[str], y: str, t: str, thr: float, prefix: tuple[str, ...]) -> str:
    il = ", ".join(ids)
    ctes = fit_ctes(src, ids, y, t) + [
        ("sig", f"SELECT {il}, stddev_samp(_r) AS _sig FROM pts GROUP BY {il}"),
        ("sc", f"SELECT p.*, CASE WHEN g._sig > 0 THEN abs(p._r) / g._sig ELSE 0.0 END AS _z FROM pts p JOIN sig g USING ({il})"),
        ("pr", f"SELECT *, CAST(2.0 AS DOUBLE) * {normal_cdf_sql('_z')} - CAST(1.0 AS DOUBLE) AS _p FROM sc"),
    ]
    return with_(*prefix, extra=ctes) + (f"SELECT {il}, _t AS {t}, CAST(_y AS DOUBLE) AS {y}, _p > {thr} AS is_anomaly, "
                                         f"{R('_p', 4)} AS anomaly_probability FROM pr")


def tvf06_sql(metric: str = "aum") -> str:
    src = f"ts_{metric}"
    w, sel = forecast_sql(src, ["division", "region"], "value", "month", 12, 0.9, ["division", "region"], prefix=(src,))
    return w + f"SELECT {sel} FROM fc"


def tvf07_sql() -> str:
    return anomalies_sql("ts_aum", ["division", "region"], "value", "month", 0.95, ("ts_aum",))


def rm11_sql(metric: str = "aum", where: str | None = None) -> str:
    src = f"ts_{metric}" if where is None else f"(SELECT * FROM ts_{metric} WHERE {where})"
    w, _ = forecast_sql(src, ["division", "region"], "value", "month", 12, 0.9, ["division", "region"], prefix=(f"ts_{metric}",))
    return w + f""",
hist AS (SELECT strftime(month, '%Y-%m') AS ts, {R('CAST(SUM(CAST(value AS DECIMAL(38,8))) AS DOUBLE)', 2)} AS yhat
         FROM {src} GROUP BY strftime(month, '%Y-%m')),
fcs AS (SELECT strftime(forecast_timestamp, '%Y-%m') AS ts,
               {R('CAST(SUM(CAST(' + R('_v', 4) + ' AS DECIMAL(38,4))) AS DOUBLE)', 2)} AS yhat,
               {R('CAST(SUM(CAST(' + R('_v - _half', 4) + ' AS DECIMAL(38,4))) AS DOUBLE)', 2)} AS lo,
               {R('CAST(SUM(CAST(' + R('_v + _half', 4) + ' AS DECIMAL(38,4))) AS DOUBLE)', 2)} AS hi
        FROM fc GROUP BY strftime(forecast_timestamp, '%Y-%m'))
SELECT ts, yhat, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, 'history' AS kind, yhat AS actual FROM hist
UNION ALL
SELECT ts, yhat, yhat, yhat, 'bridge', CAST(NULL AS DOUBLE) FROM (SELECT * FROM hist ORDER BY ts DESC LIMIT 1)
UNION ALL
SELECT ts, yhat, lo, hi, 'forecast', CAST(NULL AS DOUBLE) FROM fcs"""


SEG = "region:AFRICA|banking:Dual"


def _seg_base(col: str, as_of: str = AS_OF) -> str:
    return (f"SELECT f.month, f.{col} AS v, c.segment_tier, c.booking_centre, c.risk_profile FROM client_flows f "
            f"JOIN clients c ON f.client_key = c.client_key "
            f"WHERE c.region = 'AFRICA' AND c.dual_banked = TRUE AND f.month >= {months_before_sql(as_of, 12)}")


def rm13_trend_sql(col: str = "net_new_money_usd") -> str:
    return with_("clients", "client_flows", extra=[
        ("base", _seg_base(col)),
        ("tr", f"SELECT strftime(month, '%Y-%m') AS ts, {R('CAST(SUM(v) AS DOUBLE) / 1e6', 2)} AS value FROM base "
               f"GROUP BY strftime(month, '%Y-%m')"),
        ("p", "SELECT *, ROW_NUMBER() OVER (ORDER BY ts DESC) AS _pos FROM tr"),
        ("agg", "SELECT SUM(CASE WHEN _pos <= 6 THEN value END) AS recent, SUM(CASE WHEN _pos > 6 THEN value END) AS prior, "
                "COUNT(CASE WHEN _pos > 6 THEN 1 END) AS n_prior FROM p"),
    ]) + """
SELECT p.ts, p.value,
       (p._pos <= 6) AND CASE WHEN a.recent - coalesce(a.prior, 0.0) < 0
                              THEN p.value < (CASE WHEN a.n_prior > 0 THEN coalesce(a.prior, 0.0) / CAST(a.n_prior AS DOUBLE) ELSE 0.0 END) * 0.85
                              ELSE p.value > (CASE WHEN a.n_prior > 0 THEN coalesce(a.prior, 0.0) / CAST(a.n_prior AS DOUBLE) ELSE 0.0 END) * 1.15 END AS is_anomaly
FROM p, agg a"""


def rm13_factors_sql(col: str = "net_new_money_usd", as_of: str = AS_OF) -> str:
    cut = months_before_sql(as_of, 6)
    return with_("clients", "client_flows", extra=[("base", _seg_base(col))]) + f"""
SELECT 'segment tier: ' || segment_tier AS factor,
       {R(f'CAST(SUM(CASE WHEN month >= {cut} THEN v ELSE 0 END) - SUM(CASE WHEN month < {cut} THEN v ELSE 0 END) AS DOUBLE) / 1e6', 1)} AS impact_usd_m
FROM base GROUP BY segment_tier ORDER BY abs(impact_usd_m) DESC, factor LIMIT 3"""


def rm13_forecast_sql(col: str = "net_new_money_usd") -> str:
    w, _ = forecast_sql("ser", ["_series"], "v", "month", 6, 0.9, [], prefix=("clients", "client_flows"),
                        extra=[("base", _seg_base(col)),
                               ("ser", "SELECT 'all' AS _series, month, SUM(v) AS v FROM base GROUP BY month")])
    return w + f"""
SELECT strftime(forecast_timestamp, '%Y-%m') AS ts, {R(R('_v', 4) + ' / 1e6', 2)} AS yhat,
       {R(R('_v - _half', 4) + ' / 1e6', 2)} AS lo, {R(R('_v + _half', 4) + ' / 1e6', 2)} AS hi FROM fc"""
