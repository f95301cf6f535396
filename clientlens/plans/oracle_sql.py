"""Independent SQL (DuckDB dialect) for the correctness oracle.

The canonical mapping is restated here as SQL common table expressions over
the driver's tables, so that every registered Spark query can be checked
against a second engine from the raw parquet up.  Money is summed as
DECIMAL(18,2) in both engines; ratios are IEEE doubles computed in the same
order, so values agree exactly.
"""

from __future__ import annotations

from ..operators.canonical import (ACCOUNT_TYPE_BY_PRIORITY, ADVISOR_ROLES, AS_OF,
                                   ASSET_CLASS_BY_PART_TYPE, COUNTERPARTIES, DIVISION_BY_MKTSEGMENT,
                                   ENTITY_TYPES, KYC_BY_KEY_MOD10, LANGUAGES,
                                   LIABILITY_ACCOUNT_TYPES, PLATFORMS, RISK_PROFILES,
                                   SEGMENT_BY_MKTSEGMENT, SEGMENT_TIERS, TXN_TYPE_BY_FLAG_STATUS, UBO_STRIDE)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str | None) -> str:
    whens = " ".join(f"WHEN {q(str(k)) if isinstance(k, str) else k} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {q(default) if default is not None else 'NULL'} END)"


def pick(expr: str, values: list[str]) -> str:
    arr = "[" + ", ".join(q(v) for v in values) + "]"
    return f"({arr})[({expr}) % {len(values)} + 1]"


def cli(expr: str) -> str:
    return f"('CLI_' || lpad(CAST({expr} AS VARCHAR), 10, '0'))"


def acct_id(key: str, prio: str) -> str:
    t = case_map(prio, ACCOUNT_TYPE_BY_PRIORITY, "unmapped")
    return f"('ACC_' || lpad(CAST({key} AS VARCHAR), 10, '0') || '_' || substr({t}, 1, 3))"


MONEY = "DECIMAL(18,2)"
LIAB = ", ".join(q(x) for x in LIABILITY_ACCOUNT_TYPES)

CTES: dict[str, tuple[str, list[str]]] = {
    "clients": (f"""
SELECT c.c_custkey AS client_key,
       {cli('c.c_custkey')} AS client_id,
       c.c_name AS full_name,
       (c.c_custkey % 17 = 0) AS is_entity,
       CAST(DATE '1940-01-01' + CAST((c.c_custkey * 37) % 20000 AS INTEGER) AS DATE) AS dob,
       {case_map('c.c_mktsegment', SEGMENT_BY_MKTSEGMENT, 'Affluent')} AS segment_tier,
       n.n_name AS domicile, n.n_name AS booking_centre, r.r_name AS region,
       {pick('c.c_custkey', RISK_PROFILES)} AS risk_profile,
       {case_map('c.c_custkey % 10', KYC_BY_KEY_MOD10, 'verified')} AS kyc_status,
       CASE WHEN c.c_custkey % 3 = 0 THEN {pick('c.c_custkey', LANGUAGES)} || '|' || {pick('c.c_custkey + 3', LANGUAGES)}
            ELSE {pick('c.c_custkey', LANGUAGES)} END AS languages,
       'ADV_' || lpad(CAST(c.c_custkey % greatest(1, (SELECT COUNT(*) FROM supplier)) AS VARCHAR), 6, '0') AS primary_advisor_id,
       CASE WHEN c.c_custkey % 9 < 2 THEN 'apex|summit' WHEN c.c_custkey % 2 = 0 THEN 'apex' ELSE 'summit' END AS source_banks,
       (c.c_custkey % 9 < 2) AS dual_banked,
       CAST(CAST(CAST(greatest(c.c_acctbal, 0.0) AS {MONEY}) * 1000 AS {MONEY}) AS DOUBLE) AS total_aum_usd,
       CAST(120 + c.c_custkey % 7910 AS INTEGER) AS tenure_days,
       CASE WHEN c.c_custkey % 5 < 3 THEN 'HH' || lpad(CAST(c.c_custkey // 8 AS VARCHAR), 10, '0')
            ELSE 'HH_SOLO_' || CAST(c.c_custkey AS VARCHAR) END AS household_id,
       (c.c_custkey % 4 <> 0) AS marketing_consent
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""", []),
    "accounts": (f"""
SELECT 'ACC_' || lpad(CAST(client_key AS VARCHAR), 10, '0') || '_' || substr(account_type, 1, 3) AS account_id,
       {cli('client_key')} AS client_id, client_key, account_type,
       CAST(CASE WHEN account_type IN ({LIAB}) THEN -gross ELSE gross END AS DOUBLE) AS balance_usd
FROM (SELECT o_custkey AS client_key, {case_map('o_orderpriority', ACCOUNT_TYPE_BY_PRIORITY, 'unmapped')} AS account_type,
             SUM(CAST(o_totalprice AS {MONEY})) AS gross
      FROM orders GROUP BY 1, 2) g""", []),
    "holdings": (f"""
SELECT 'PF_' || lpad(CAST(l.l_orderkey AS VARCHAR), 12, '0') AS portfolio_id,
       {cli('o.o_custkey')} AS client_id, o.o_custkey AS client_key,
       {case_map('p.p_type', ASSET_CLASS_BY_PART_TYPE, 'unmapped')} AS asset_class,
       l.l_quantity AS quantity, l.l_extendedprice AS market_value_usd
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""", []),
    "transactions": (f"""
SELECT 'TXN_' || lpad(CAST(l.l_orderkey AS VARCHAR), 12, '0') || '_' || CAST(l.l_linenumber AS VARCHAR) AS txn_id,
       {acct_id('o.o_custkey', 'o.o_orderpriority')} AS account_id,
       {cli('o.o_custkey')} AS client_id, o.o_custkey AS client_key,
       {case_map("l.l_returnflag || '|' || l.l_linestatus", TXN_TYPE_BY_FLAG_STATUS, 'unmapped')} AS txn_type,
       l.l_extendedprice AS amount_usd,
       CAST(l.l_shipdate AS DATE) AS value_date,
       {pick('l.l_suppkey', COUNTERPARTIES)} AS counterparty
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", []),
    "client_flows": (f"""
SELECT {cli('o.o_custkey')} AS client_id, o.o_custkey AS client_key,
       CAST(date_trunc('month', CAST(l.l_shipdate AS DATE)) AS DATE) AS month,
       SUM(CASE WHEN l.l_returnflag = 'N' THEN CAST(l.l_extendedprice AS {MONEY}) ELSE 0 END)
     - SUM(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_extendedprice AS {MONEY}) ELSE 0 END) AS net_new_money_usd,
       SUM(CASE WHEN l.l_returnflag = 'N' THEN CAST(l.l_extendedprice AS {MONEY}) ELSE 0 END) AS inflow_usd,
       SUM(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_extendedprice AS {MONEY}) ELSE 0 END) AS outflow_usd
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY 1, 2, 3""", []),
    "advisors": (f"""
SELECT 'ADV_' || lpad(CAST(s.s_suppkey AS VARCHAR), 6, '0') AS advisor_id, s.s_name AS name,
       {pick('s.s_suppkey', ADVISOR_ROLES)} AS role, r.r_name || ' desk' AS desk,
       n.n_name AS booking_centre, r.r_name AS market
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""", []),
    "legal_entities": (f"""
SELECT 'LE_' || lpad(CAST(s.s_suppkey AS VARCHAR), 6, '0') AS entity_id,
       {pick('s.s_suppkey', ENTITY_TYPES)} AS entity_type,
       s.s_name || ' Holdings' AS name, n.n_name AS jurisdiction,
       {cli(f's.s_suppkey * {UBO_STRIDE}')} AS ubo_client_id, s.s_suppkey * {UBO_STRIDE} AS ubo_client_key,
       (s.s_acctbal < 0) AS risk_flag
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""", []),
    "products": (f"""
SELECT 'PRD_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS product_id,
       {case_map('p_type', ASSET_CLASS_BY_PART_TYPE, 'unmapped')} AS product_type,
       p_name AS name,
       {pick('p_partkey', SEGMENT_TIERS)} AS target_segment_hint,
       {pick('p_partkey', PLATFORMS)} AS origin_platform
FROM part""", []),
}


CTES["portfolios"] = (f"""
SELECT {cli('o_custkey')} AS client_id, o_custkey AS client_key,
       {case_map('o_orderpriority', ACCOUNT_TYPE_BY_PRIORITY, 'unmapped')} AS mandate_type,
       o_totalprice AS market_value_usd
FROM orders""", [])
CTES["households"] = ("""
SELECT m.household_id, m.household_id AS address_key, CAST(m.member_count AS INTEGER) AS member_count,
       CAST(m.aum AS DOUBLE) AS total_aum_usd, coalesce(l.lines_held, '') AS lines_held
FROM (SELECT household_id, COUNT(*) AS member_count, SUM(CAST(total_aum_usd AS DECIMAL(18,2))) AS aum
      FROM clients WHERE NOT starts_with(household_id, 'HH_SOLO_') GROUP BY household_id) m
LEFT JOIN (SELECT household_id, string_agg(account_type, '|' ORDER BY account_type) AS lines_held
           FROM (SELECT DISTINCT c.household_id, a.account_type FROM clients c JOIN accounts a ON a.client_key = c.client_key
                 WHERE NOT starts_with(c.household_id, 'HH_SOLO_')) d GROUP BY household_id) l
  ON l.household_id = m.household_id""", ["clients", "accounts"])
# (me)-[BELONGS_TO]->(h)<-[BELONGS_TO]-(mate)-[HOLDS]->(a), written as the literal path join.
CTES["mate_products"] = ("""
SELECT me.client_key, me.client_id, a.account_type AS product, COUNT(*) AS signal
FROM clients me JOIN households h ON me.household_id = h.household_id
JOIN clients mate ON mate.household_id = h.household_id
JOIN accounts a ON a.client_key = mate.client_key
GROUP BY me.client_key, me.client_id, a.account_type""", ["clients", "households", "accounts"])


def R(x: str, n: int) -> str:
    """Engine-stable rounding (same as the Spark helper ``rnd``)."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


def ts_cte(metric: str) -> str:
    amt = f"CAST(o.o_totalprice AS {MONEY})"
    v = {"aum": amt, "revenue": amt,
         "nna": f"CASE WHEN o.o_orderstatus = 'F' THEN {amt} WHEN o.o_orderstatus = 'O' THEN -{amt} ELSE 0 END"}[metric]
    scale = "1e8" if metric == "revenue" else "1e6"
    return f"""
SELECT month, division, region, CAST(v AS DOUBLE) / {scale} AS value
FROM (SELECT CAST(date_trunc('month', CAST(o.o_orderdate AS DATE)) AS DATE) AS month,
             {case_map('c.c_mktsegment', DIVISION_BY_MKTSEGMENT, 'GWM')} AS division,
             r.r_name AS region, SUM({v}) AS v
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
      GROUP BY 1, 2, 3) t"""


CTES["ts_aum"] = (ts_cte("aum"), [])
CTES["ts_nna"] = (ts_cte("nna"), [])
CTES["ts_revenue"] = (ts_cte("revenue"), [])


def with_(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named canonical CTEs (+ extra ones)."""
    seen: list[str] = []

    def add(n):
        if n in seen:
            return
        for dep in CTES[n][1]:
            add(dep)
        seen.append(n)
    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][0]}\n)" for n in seen] + [f"{n} AS ({s}\n)" for n, s in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"


def months_before_sql(as_of: str, n: int) -> str:
    return f"CAST(date_trunc('month', DATE '{as_of}') - INTERVAL {n} MONTH AS DATE)"


def dbl_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


__all__ = ["R", "initcap", "with_", "CTES", "AS_OF", "q", "case_map", "pick", "months_before_sql", "dbl_div", "MONEY"]
