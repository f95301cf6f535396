"""Oracle SQL for key drivers (TVF-02) and its read models.

Pruning is written from its definition (a segment is dropped when a
segment with one dimension fewer has the same row count), independently of
the Spark operator's constant-dimension formulation.
"""

from __future__ import annotations

from ..operators.canonical import AS_OF
from ..operators.keydrivers import KD_DIMS, KD_METRICS, WIDE_DIMS, tenure_band_sql
from .oracle_sql import dbl_div, months_before_sql, with_

BANK = "CASE WHEN c.dual_banked THEN 'Dual-banked (Apex + Summit)' ELSE 'Single-bank' END"


def kd_input_cte(metric_col: str, as_of: str = AS_OF, where: str = "TRUE") -> str:
    return f"""
SELECT c.segment_tier, c.region, c.booking_centre, c.risk_profile, {BANK} AS banking,
       f.{metric_col} AS m, f.month >= {months_before_sql(as_of, 6)} AS is_recent
FROM client_flows f JOIN clients c ON f.client_key = c.client_key
WHERE f.month >= {months_before_sql(as_of, 12)} AND ({where})"""


def kd_ctes(metric: str, top_k: int | None = None, min_support: float | None = None,
            prune: bool = True, as_of: str = AS_OF, dims: list[str] | None = None, where: str = "TRUE"):
    col = KD_METRICS[metric][0]
    dims = dims or KD_DIMS
    dl = ", ".join(dims)
    gcols = ", ".join(f"grouping({x}) AS g{i}" for i, x in enumerate(dims))
    parent_conds = []
    for j in range(len(dims)):
        cc = [f"c.g{j} = 0", f"p.g{j} = 1"]
        for i, x in enumerate(dims):
            if i != j:
                cc.append(f"p.g{i} = c.g{i}")
                cc.append(f"p.{x} IS NOT DISTINCT FROM c.{x}")
        parent_conds.append("(" + " AND ".join(cc) + ")")
    pruned = (f"SELECT c.* FROM cube c WHERE NOT EXISTS (SELECT 1 FROM cube p WHERE p.n = c.n AND ("
              + " OR ".join(parent_conds) + "))") if prune else "SELECT * FROM cube"
    label = "concat_ws('; ', " + ", ".join(f"CASE WHEN g{i} = 0 THEN '{x}=' || CAST({x} AS VARCHAR) END"
                                           for i, x in enumerate(dims)) + ")"
    order = " + ".join(f"(1 - g{i})" for i in range(len(dims)))
    vlabel = "concat_ws(' · ', " + ", ".join(f"CASE WHEN g{i} = 0 THEN CAST({x} AS VARCHAR) END"
                                             for i, x in enumerate(dims)) + ")"
    mi, mr = "CAST(mi AS DOUBLE)", "CAST(mr AS DOUBLE)"
    ti, tr = "CAST(t.ti AS DOUBLE)", "CAST(t.tr AS DOUBLE)"
    diff = "CAST(mi - mr AS DOUBLE)"
    expected = dbl_div(f"{mr} * {ti}", tr)
    support = f"greatest({dbl_div(mi, ti)}, {dbl_div(mr, tr)})"
    body = f"""
SELECT CASE WHEN {label} = '' THEN 'all' ELSE {label} END AS drivers,
       {mi} AS metric_interest, {mr} AS metric_reference, {diff} AS difference,
       {dbl_div(diff, f'abs({mr})')} AS relative_difference,
       {mi} - {expected} AS unexpected_difference,
       {dbl_div(f'{mi} - {expected}', f'abs({expected})')} AS relative_unexpected_difference,
       {dbl_div(f'abs({diff})', 'CAST(t.abs_leaf AS DOUBLE)')} AS contribution,
       {support} AS apriori_support,
       CAST({order} AS INTEGER) AS n_dimensions,
       replace({label}, '; ', '|') AS _sort,
       {vlabel} AS _label
FROM pruned, tot t"""
    ctes = [
        ("inp", kd_input_cte(col, as_of, where)),
        ("leaf", f"SELECT {dl}, SUM(CASE WHEN is_recent THEN m ELSE 0 END) AS mi, "
                 f"SUM(CASE WHEN NOT is_recent THEN m ELSE 0 END) AS mr, COUNT(*) AS n FROM inp GROUP BY {dl}"),
        ("tot", "SELECT SUM(mi) AS ti, SUM(mr) AS tr, SUM(abs(mi - mr)) AS abs_leaf FROM leaf"),
        ("cube", f"SELECT {dl}, {gcols}, SUM(mi) AS mi, SUM(mr) AS mr, SUM(n) AS n FROM leaf GROUP BY CUBE ({dl})"),
        ("pruned", pruned),
        ("kd", body),
    ]
    sel = ("drivers, metric_interest, metric_reference, difference, relative_difference, unexpected_difference, "
           "relative_unexpected_difference, contribution, apriori_support, n_dimensions")
    kdt = "SELECT * FROM kd"
    if min_support is not None:
        kdt += f" WHERE n_dimensions = 0 OR apriori_support >= {float(min_support)}"
    if top_k is not None:
        kdt = (f"SELECT * FROM kd WHERE n_dimensions = 0 UNION ALL "
               f"SELECT * FROM (SELECT * FROM kd WHERE n_dimensions > 0 "
               f"ORDER BY apriori_support DESC NULLS LAST, _sort LIMIT {top_k})")
    ctes.append(("kdt", kdt))
    return with_("clients", "client_flows", extra=ctes), sel


def kd_sql(metric: str, top_k: int | None = None, min_support: float | None = None,
           prune: bool = True, as_of: str = AS_OF) -> str:
    """Full key-driver table (flattened: ``drivers`` as ``; ``-joined text)."""
    w, sel = kd_ctes(metric, top_k, min_support, prune, as_of)
    return w + f"SELECT {sel} FROM kdt"


def kd_view_sql(metric: str, n: int = 12, as_of: str = AS_OF) -> str:
    """RM-12: the ranked driver list in USD m with population and listed totals."""
    from ..operators.keydrivers import KD_PARAMS
    p = KD_PARAMS[metric]
    w, _ = kd_ctes(metric, top_k=p.get("top_k"), min_support=p.get("min_apriori_support"), as_of=as_of)
    fav = KD_METRICS[metric][2]

    def r(x, k):
        return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {k}) AS DOUBLE)"
    return w + f""",
pop AS (SELECT metric_interest AS pi, metric_reference AS pr FROM kdt WHERE n_dimensions = 0),
top AS (SELECT * FROM kdt WHERE n_dimensions > 0 ORDER BY abs(unexpected_difference) DESC, _sort LIMIT {n})
SELECT _label AS label, _sort AS segment,
       {r('metric_interest / 1e6', 2)} AS metric_interest_usd_m,
       {r('metric_reference / 1e6', 2)} AS metric_reference_usd_m,
       {r('difference / 1e6', 2)} AS difference_usd_m,
       {r('coalesce(relative_difference, 0)', 4)} AS relative_difference,
       {r('unexpected_difference / 1e6', 2)} AS unexpected_difference_usd_m,
       {r('coalesce(contribution, 0)', 4)} AS contribution,
       {r('coalesce(apriori_support, 0)', 4)} AS apriori_support,
       CASE WHEN difference >= 0 THEN 'up' ELSE 'down' END AS direction,
       ((difference >= 0) = {'TRUE' if fav == 'higher' else 'FALSE'}) AS favourable,
       {r('pop.pi / 1e6', 1)} AS total_interest_usd_m,
       {r('pop.pr / 1e6', 1)} AS total_reference_usd_m,
       {r('(pop.pi - pop.pr) / 1e6', 1)} AS net_change_usd_m,
       {r('CAST(SUM(CAST(metric_interest AS DECIMAL(38,2))) OVER () AS DOUBLE) / 1e6', 1)} AS listed_interest_usd_m,
       {r('CAST(SUM(CAST(metric_reference AS DECIMAL(38,2))) OVER () AS DOUBLE) / 1e6', 1)} AS listed_reference_usd_m,
       {money('metric_interest')} AS interest_label,
       CAST(to_json(string_split(drivers, '; ')) AS VARCHAR) AS drivers_json,
       (CASE WHEN {r('coalesce(relative_difference, 0)', 4)} * 100.0 > 0 THEN '+' ELSE '' END)
         || printf('%.1f', {r(r('coalesce(relative_difference, 0)', 4) + ' * 100.0', 1)}) || '%' AS relative_change_label,
       {r(f"greatest(4.0, abs({r('unexpected_difference / 1e6', 2)}) / greatest(max(abs({r('unexpected_difference / 1e6', 2)})) OVER (), 1.0) * 100.0)", 1)} AS bar_pct
FROM top, pop"""


def wide_sql(metric: str, min_support: float, as_of: str = AS_OF) -> str:
    """Twelve dimensions: the full cube, cut by support and then pruned (what
    a segment with enough support lies in has enough, too)."""
    n, col = len(WIDE_DIMS), KD_METRICS[metric][0]
    derived = {"banking": BANK, "tenure_band": tenure_band_sql("c.tenure_days")}
    dims = ", ".join(f"CAST({derived.get(x, 'c.' + x)} AS VARCHAR) AS {x}" for x in WIDE_DIMS)
    dl = ", ".join(WIDE_DIMS)

    def key(skip: int | None = None) -> str:
        return "concat_ws('; ', " + ", ".join(f"CASE WHEN g{i} = 0 THEN '{x}=' || coalesce({x}, '?') END" for i, x in enumerate(WIDE_DIMS) if i != skip) + ")"
    mi, mr, ti, tr = "CAST(mi AS DOUBLE)", "CAST(mr AS DOUBLE)", "CAST(t.ti AS DOUBLE)", "CAST(t.tr AS DOUBLE)"
    diff, expected = "CAST(mi - mr AS DOUBLE)", dbl_div(f"{mr} * {ti}", tr)
    order = " + ".join(f"(1 - g{i})" for i in range(n))
    parents = " UNION ALL ".join(f"SELECT key, n, {key(i)} AS parent FROM enough WHERE g{i} = 0" for i in range(n))
    ctes = [
        ("inp", f"SELECT {dims}, f.{col} AS m, f.month >= {months_before_sql(as_of, 6)} AS is_recent FROM client_flows f JOIN clients c ON f.client_key = c.client_key "
                f"WHERE f.month >= {months_before_sql(as_of, 12)}"),
        ("leaf", f"SELECT {dl}, SUM(CASE WHEN is_recent THEN m ELSE 0 END) AS mi, SUM(CASE WHEN NOT is_recent THEN m ELSE 0 END) AS mr, COUNT(*) AS n FROM inp GROUP BY {dl}"),
        ("tot", "SELECT SUM(mi) AS ti, SUM(mr) AS tr, SUM(abs(mi - mr)) AS abs_leaf FROM leaf"),
        ("cube", f"SELECT {dl}, {', '.join(f'grouping({x}) AS g{i}' for i, x in enumerate(WIDE_DIMS))}, SUM(mi) AS mi, SUM(mr) AS mr, SUM(n) AS n FROM leaf GROUP BY CUBE ({dl})"),
        ("enough", f"SELECT c.*, {key()} AS key, {order} AS n_dims FROM cube c, tot t WHERE {order} = 0 OR greatest({dbl_div(mi, ti)}, {dbl_div(mr, tr)}) >= {float(min_support)}"),
        ("same", f"SELECT DISTINCT p.key FROM ({parents}) p JOIN enough e ON p.parent = e.key AND p.n = e.n"),
    ]
    return with_("clients", "client_flows", extra=ctes) + f"""
SELECT CASE WHEN key = '' THEN 'all' ELSE key END AS drivers,
       {mi} AS metric_interest, {mr} AS metric_reference, {diff} AS difference, {dbl_div(diff, f'abs({mr})')} AS relative_difference,
       {mi} - {expected} AS unexpected_difference, {dbl_div(f'{mi} - {expected}', f'abs({expected})')} AS relative_unexpected_difference,
       {dbl_div(f'abs({diff})', 'CAST(t.abs_leaf AS DOUBLE)')} AS contribution, greatest({dbl_div(mi, ti)}, {dbl_div(mr, tr)}) AS apriori_support,
       CAST(n_dims AS INTEGER) AS n_dimensions
FROM enough, tot t WHERE key NOT IN (SELECT key FROM same)"""


def money(x: str) -> str:
    def r(v, k):
        return f"CAST(ROUND(CAST({v} AS DECIMAL(38,10)), {k}) AS DOUBLE)"
    return (f"(CASE WHEN {x} >= 1e9 THEN '$' || printf('%.1f', {r(x + ' / 1e9', 1)}) || 'bn' "
            f"WHEN {x} >= 1e6 THEN '$' || printf('%.1f', {r(x + ' / 1e6', 1)}) || 'm' "
            f"WHEN {x} >= 1e3 THEN '$' || printf('%.0f', {r(x + ' / 1e3', 0)}) || 'k' "
            f"ELSE '$' || printf('%.0f', {r(x, 0)}) END)")


SEG_KD = "region:AFRICA|banking:Dual-banked (Apex + Summit)"


def segment_kd_sql(metric: str = "nna", top_k: int = 10) -> str:
    w, sel = kd_ctes(metric, top_k=top_k, dims=["segment_tier", "booking_centre", "risk_profile"],
                     where="c.region = 'AFRICA' AND c.dual_banked = TRUE")
    return w + f"SELECT {sel} FROM kdt"


def segment_stats_sql(metric: str = "nna") -> str:
    w, sel = kd_ctes(metric, min_support=0.0)
    return w + (f"SELECT {sel} FROM kdt WHERE list_sort(string_split(drivers, '; ')) = "
                "list_sort(['region=AFRICA', 'banking=Dual-banked (Apex + Summit)'])")
