"""Key-driver (contribution) analysis — TVF-02 / TVF-03.

``key_drivers`` answers "which dimension segments explain the move of a
metric between an interest and a reference period".  The hosted function
in the reference has no published definition; the formulas here are ours
and are stated in the docstring.

Plan shape (all native Spark, no UDF):

1. leaf cells: one ``groupBy(dims)`` with conditional sums — the only pass
   over the input, with map-side partial aggregation, so a hot dimension
   value costs nothing extra;
2. grouping sets over the *leaf cells* (never over raw rows, which would
   expand the input 2^d times);
3. population totals as scalar subqueries over the leaf cells (no cross
   join, no unpartitioned window);
4. formulas, then redundancy pruning by an equi-join of every segment to
   its immediate parents (exact: a child selects a subset of its parent's
   rows, so equal row counts mean equal row sets).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT_COLUMNS = ["drivers", "metric_interest", "metric_reference", "difference", "relative_difference",
                  "unexpected_difference", "relative_unexpected_difference", "contribution", "apriori_support"]


#: Dimensions up to which every subset of them is a grouping set.
CUBE_DIMENSIONS = 8

NEGATIVE = "key_drivers: negative metric values need min_apriori_support=0"


def measures(baseline: str) -> dict[str, str]:
    """Output column -> SQL over a segment's sums ``_mi, _mr`` and the
    population's ``_ti, _tr, _abs_leaf``."""
    def div(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN CAST(NULL AS DOUBLE) ELSE ({a}) / ({b}) END)"
    mi, mr, ti, tr = "CAST(_mi AS DOUBLE)", "CAST(_mr AS DOUBLE)", "CAST(_ti AS DOUBLE)", "CAST(_tr AS DOUBLE)"
    diff = "CAST(_mi - _mr AS DOUBLE)"
    expected = div(f"{mr} * {ti}", tr) if baseline == "population" else div(f"{mr} * ({ti} - {mi})", f"{tr} - {mr}")
    return {
        "metric_interest": mi, "metric_reference": mr, "difference": diff,
        "relative_difference": div(diff, f"abs({mr})"),
        "unexpected_difference": f"{mi} - {expected}",
        "relative_unexpected_difference": div(f"{mi} - {expected}", f"abs({expected})"),
        "contribution": div(f"abs({diff})", "CAST(_abs_leaf AS DOUBLE)"),
        "apriori_support": f"greatest({div(mi, ti)}, {div(mr, tr)})",
    }


def selected(out: DataFrame, top_k: int | None, min_apriori_support: float | None) -> DataFrame:
    """Segments of enough support, the ``top_k`` of largest support, and the
    population row."""
    if min_apriori_support is not None:
        out = out.filter(f"_order = 0 OR apriori_support >= {float(min_apriori_support)!r}")
    if top_k is not None:
        # top-k is the feature here: a TakeOrderedAndProject over the segments
        # (per-partition partial top-k, then a k-row merge), plus the population row.
        seg = (out.filter("_order > 0")
               .orderBy(F.col("apriori_support").desc_nulls_last(), F.expr("array_join(drivers, '|')"))
               .limit(top_k))
        out = out.filter("_order = 0").unionByName(seg)
    return out.select(*OUTPUT_COLUMNS, F.col("_order").alias("n_dimensions"),
                      "population_interest", "population_reference")


def key_drivers(df: DataFrame, metric_col: str, dimension_cols: list[str], interest_label_col: str,
                top_k: int | None = None, min_apriori_support: float | None = None,
                enable_pruning: bool = True, max_order: int | None = None,
                baseline: str = "population") -> DataFrame:
    """Driver segments of ``metric_col`` between label TRUE (interest) and FALSE (reference).

    For a segment with sums ``Mi``/``Mr`` and population sums ``Ti``/``Tr``:

    * ``difference = Mi - Mr``; ``relative_difference = difference / |Mr|``
    * ``expected = Mr * Ti / Tr`` (population trend) or, with
      ``baseline="complement"``, ``Mr * (Ti - Mi) / (Tr - Mr)``
    * ``unexpected_difference = Mi - expected``;
      ``relative_unexpected_difference = unexpected / |expected|``
    * ``contribution = |difference| / Σ_leaf |leaf difference|``
    * ``apriori_support = greatest(Mi / Ti, Mr / Tr)``

    Divisions by zero give NULL.  ``drivers`` is an array of ``name=value``
    strings in ``dimension_cols`` order; the population row is ``['all']``.
    A negative metric value is only accepted with ``min_apriori_support=0``
    (or unset with no ``top_k``); otherwise evaluation raises.
    Pruning drops a segment that selects exactly the rows of a segment with
    fewer dimensions.  Beyond 8 dimensions without a ``max_order`` the segments
    are searched level by level (:mod:`.driver_levels`), which a support over 0
    keeps small.  ``top_k`` keeps the k segments of largest support
    (ties by label), ``min_apriori_support`` keeps support ≥ the bound; the
    ``['all']`` row is always kept.
    """
    dims = list(dimension_cols)
    d = len(dims)
    if not 1 <= d <= 12:
        raise ValueError("key_drivers needs 1 to 12 dimension columns")
    if baseline not in ("population", "complement"):
        raise ValueError("baseline must be 'population' or 'complement'")
    if max_order is None:
        if d > CUBE_DIMENSIONS:
            from .driver_levels import key_drivers_by_levels
            return key_drivers_by_levels(df, metric_col, dims, interest_label_col, top_k, min_apriori_support, enable_pruning, baseline=baseline)
        max_order = d
    # Expressions are written as SQL text (``F.expr``): the same plan as the
    # Column API, but one JVM call per expression instead of thousands.
    E = F.expr
    bq = [f"`{c}`" for c in dims]
    lab, met = f"`{interest_label_col}`", f"`{metric_col}`"
    mtype = df.schema[metric_col].dataType.simpleString()
    dtypes = [df.schema[c].dataType.simpleString() for c in dims]

    # 1) leaf cells -------------------------------------------------------------
    leaf = (df.groupBy(*dims)
            .agg(E(f"sum(CASE WHEN {lab} THEN {met} ELSE CAST(0 AS {mtype}) END)").alias("_mi"),
                 E(f"sum(CASE WHEN NOT {lab} THEN {met} ELSE CAST(0 AS {mtype}) END)").alias("_mr"),
                 E(f"count(CASE WHEN {lab} IS NOT NULL THEN 1 END)").alias("_n"),
                 E(f"min({met})").alias("_min")))

    # 3) population totals: a one-row global aggregate over the leaf cells,
    #    attached below by a broadcast hash join on a constant aggregate key
    #    (size bound: exactly one row).  Being in the same plan as the
    #    grouping sets, the leaf exchange is reused and the input is scanned
    #    once; a scalar subquery would be planned apart and rescan it.
    tot = leaf.agg(E("sum(_mi)").alias("_ti"), E("sum(_mr)").alias("_tr"), E("min(_min)").alias("_mn"),
                   E("sum(abs(_mi - _mr))").alias("_abs_leaf"), E("sum(_n)").alias("_rows"),
                   E("max(1)").alias("_one"))

    # 2) grouping sets over leaf cells ---------------------------------------------
    #    min/max/null flags of every dimension inside each group tell whether
    #    that dimension is constant there (used by pruning, no extra pass).
    sets = [list(s) for r in range(0, max_order + 1) for s in combinations(dims, r)]
    fd_aggs = []
    if enable_pruning:
        for j, c in enumerate(bq):
            fd_aggs += [E(f"min({c})").alias(f"_lo{j}"), E(f"max({c})").alias(f"_hi{j}"),
                        E(f"max(CAST({c} IS NULL AS INT))").alias(f"_anynull{j}"),
                        E(f"min(CAST({c} IS NULL AS INT))").alias(f"_allnull{j}")]
    cube = (leaf.groupingSets(sets, *dims)
            .agg(E("sum(_mi)").alias("_mi"), E("sum(_mr)").alias("_mr"), E("sum(_n)").alias("_n"),
                 E("min(_min)").alias("_min"), E("max(1)").alias("_one"),
                 *[E(f"grouping({c})").alias(f"_g{j}") for j, c in enumerate(bq)], *fd_aggs)
            .withColumn("_mask", E(" + ".join(f"(CASE WHEN _g{j} = 0 THEN {1 << j} ELSE 0 END)" for j in range(d)))))

    # 4) redundancy pruning ---------------------------------------------------------
    #    A child P ∪ {j = v} selects exactly the rows of its parent P iff
    #    dimension j is constant (= v) inside P.  One pass, no self-join:
    #    every row emits its own key (kind 0) and the keys of its redundant
    #    children (kind 1); a key group holding a kind-1 record is dropped.
    #    Null-safe by construction (groupBy groups NULLs).  Only parents below
    #    max_order emit, as their children must exist.
    if enable_pruning:
        order = " + ".join(f"(1 - _g{j})" for j in range(d))

        def rec(kind, kmask, vals):
            fields = ", ".join(f"'k{i}', CAST({v} AS {dtypes[i]})" for i, v in enumerate(vals))
            return f"named_struct('kind', {kind}, 'kmask', {kmask}, {fields})"
        recs = [rec(0, "_mask", bq)]
        for j in range(d):
            const = f"(_allnull{j} = 1 OR (_anynull{j} = 0 AND _lo{j} = _hi{j}))"
            value = f"(CASE WHEN _allnull{j} = 1 THEN NULL ELSE _lo{j} END)"
            vals = [value if i == j else c for i, c in enumerate(bq)]
            recs.append(f"CASE WHEN _g{j} = 1 AND {const} AND ({order}) < {max_order} "
                        f"THEN {rec(1, f'_mask + {1 << j}', vals)} END")
        keep = [x for x in cube.columns if not x.startswith(("_lo", "_hi", "_anynull", "_allnull"))]
        payload = "struct(" + ", ".join(f"`{x}`" for x in keep) + ")"
        keyed = (cube.select(E(payload).alias("_row"),
                             E(f"explode(filter(array({', '.join(recs)}), x -> x IS NOT NULL))").alias("_k"))
                 .select(E("CASE WHEN _k.kind = 0 THEN _row END").alias("_row"), "_k.*"))
        cube = (keyed.groupBy("kmask", *[f"k{i}" for i in range(d)])
                .agg(E("max(kind)").alias("_killed"), E("first(_row, true)").alias("_row"))
                .filter("_killed = 0 AND _row IS NOT NULL")
                .select("_row.*"))

    cube = cube.join(F.broadcast(tot), "_one")

    # formulas ----------------------------------------------------------------------------
    formulas = measures(baseline)
    if (min_apriori_support is not None and min_apriori_support == 0) or (min_apriori_support is None and top_k is None):
        checked = formulas["apriori_support"]
    else:
        checked = f"CASE WHEN _mn < 0 THEN raise_error('{NEGATIVE}') ELSE {formulas['apriori_support']} END"
    tokens = ("filter(array(" + ", ".join(f"CASE WHEN _g{j} = 0 THEN concat('{c}=', CAST({bq[j]} AS STRING)) END"
                                          for j, c in enumerate(dims)) + "), x -> x IS NOT NULL)")
    out = cube.select(
        E(f"CASE WHEN size({tokens}) = 0 THEN array('all') ELSE {tokens} END").alias("drivers"),
        *[E(checked if name == "apriori_support" else sql).alias(name) for name, sql in formulas.items()],
        E(" + ".join(f"(1 - _g{j})" for j in range(d))).alias("_order"),
        E("CAST(_ti AS DOUBLE)").alias("population_interest"), E("CAST(_tr AS DOUBLE)").alias("population_reference"),
    )
    return selected(out, top_k, min_apriori_support)


def flow_drivers_input(clients: DataFrame, flows: DataFrame, as_of: str, recent_months: int = 6,
                       window_months: int = 12, exclude_current_month: bool = False) -> DataFrame:
    """The key-driver input view: client-month flows with five dimensions and
    ``is_recent`` (PRJ-03, PRJ-04, FLT-10, JN-01).

    Bounds follow the reference SQL: ``month >= trunc(as_of) - window`` and
    ``is_recent = month >= trunc(as_of) - recent``, both counting the current
    month (D3).  ``exclude_current_month=True`` drops it for a true 6 v 6.
    """
    from ..functions.dates import months_before
    from ..functions.text import banking_label
    lo = months_before(as_of, window_months)
    cut = months_before(as_of, recent_months)
    f = flows.filter(F.col("month") >= lo)
    if exclude_current_month:
        f = f.filter(F.col("month") < months_before(as_of, 0))
    c = clients.select("client_key", "segment_tier", "region", "booking_centre", "risk_profile", "dual_banked")
    return (f.join(c, "client_key")
            .select("segment_tier", "region", "booking_centre", "risk_profile",
                    banking_label("dual_banked").alias("banking"),
                    "net_new_money_usd", "inflow_usd", "outflow_usd",
                    (F.col("month") >= cut).alias("is_recent")))


KD_DIMS = ["segment_tier", "region", "booking_centre", "risk_profile", "banking"]
#: The labels of the tenure bands, by their first day.
TENURE_BANDS = {0: "under 2 years", 730: "2 to 5 years", 1826: "5 to 10 years", 3652: "10 years and more"}
#: The five dimensions and seven more of the client table.
WIDE_DIMS = [*KD_DIMS, "domicile", "kyc_status", "languages", "source_banks", "is_entity", "marketing_consent", "tenure_band"]


def tenure_band_sql(days: str = "tenure_days") -> str:
    """The band of a number of days, as SQL text."""
    whens = " ".join(f"WHEN {days} >= {first} THEN '{label}'" for first, label in sorted(TENURE_BANDS.items(), reverse=True))
    return f"(CASE {whens} END)"


def wide_drivers_input(clients: DataFrame, flows: DataFrame, as_of: str) -> DataFrame:
    """As :func:`flow_drivers_input`, with twelve dimensions."""
    from ..functions.dates import months_before
    from ..functions.text import banking_label
    c = clients.select("client_key", *(d for d in WIDE_DIMS if d not in ("banking", "tenure_band")),
                       banking_label("dual_banked").alias("banking"), F.expr(tenure_band_sql()).alias("tenure_band"))
    return (flows.filter(F.col("month") >= months_before(as_of, 12)).join(c, "client_key")
            .select(*WIDE_DIMS, "net_new_money_usd", "inflow_usd", "outflow_usd", (F.col("month") >= months_before(as_of, 6)).alias("is_recent")))


# metric id → (column, display label, favourable direction)
KD_METRICS = {
    "nna": ("net_new_money_usd", "Net New Money", "higher"),
    "inflow": ("inflow_usd", "Gross Inflows", "higher"),
    "outflow": ("outflow_usd", "Gross Outflows", "lower"),
}
# metric id → key_drivers options used by the reference's three instances
KD_PARAMS = {
    "nna": {"min_apriori_support": 0.0},
    "inflow": {"top_k": 20},
    "outflow": {"top_k": 20},
}
