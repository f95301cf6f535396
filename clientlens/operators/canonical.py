"""Map the driver's TPC-H-like tables onto the canonical Client-360 model.

Every canonical table is a lazy DataFrame derived from the given tables, so
its size grows with them.  Attributes the source tables lack (risk profile,
KYC status, household, source bank) are derived deterministically from the
customer key; money is carried as exact ``decimal(18,2)`` so that sums are
independent of partitioning and match a SQL oracle bit for bit.

Each table also carries a numeric ``client_key`` so joins run on longs; the
string ``client_id`` is what users see.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MONEY
from ..functions.text import map_lookup
from ..sources.testdata import TestData

# ---------------------------------------------------------------------------
# Fixed values of the mapping (ours; domain values follow the reference's
# enumerations so operators see the same vocabulary).
# ---------------------------------------------------------------------------
AS_OF = "2001-10-15"            # reporting date for all period logic
SEGMENT_BY_MKTSEGMENT = {
    "AUTOMOBILE": "Affluent", "BUILDING": "HNW", "FURNITURE": "UHNW",
    "HOUSEHOLD": "Family Office", "MACHINERY": "Institutional",
}
SEGMENT_TIERS = ["Affluent", "HNW", "UHNW", "Family Office", "Institutional"]
RISK_PROFILES = ["Conservative", "Balanced", "Growth", "Aggressive"]
KYC_BY_KEY_MOD10 = {0: "expired", 1: "review_required", 2: "pending"}   # else verified
LANGUAGES = ["German", "French", "Italian", "English", "Mandarin", "Spanish", "Portuguese"]
ACCOUNT_TYPE_BY_PRIORITY = {
    "1-URGENT": "discretionary", "2-HIGH": "advisory", "3-MEDIUM": "execution_only",
    "4-NOT SPECIFIED": "lombard", "5-LOW": "mortgage",
}
LIABILITY_ACCOUNT_TYPES = ["lombard", "mortgage"]
ASSET_CLASS_BY_PART_TYPE = {
    "ECONOMY": "equity", "LARGE": "fixed_income", "MEDIUM": "fund",
    "PROMO": "structured", "SMALL": "alternative", "STANDARD": "cash",
}
TXN_TYPE_BY_FLAG_STATUS = {
    "A|F": "transfer_out", "A|O": "buy", "N|F": "transfer_in",
    "N|O": "sell", "R|F": "fee", "R|O": "fx",
}
COUNTERPARTIES = ["internal", "custodian", "broker", "external"]
ADVISOR_ROLES = ["Client Advisor", "Senior Client Advisor", "Investment Specialist"]
ENTITY_TYPES = ["trust", "holdco", "foundation", "spv"]
PLATFORMS = ["Apex Bank", "Summit Bank"]
DIVISION_BY_MKTSEGMENT = {
    "AUTOMOBILE": "GWM", "BUILDING": "P&C", "FURNITURE": "Asset Management",
    "HOUSEHOLD": "Investment Bank", "MACHINERY": "GWM",
}
UBO_STRIDE = 11          # supplier k is owned by customer 11*k


def _pick(key, values: list[str]):
    """values[key % len(values)] as a Column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _sql_lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _sql_case(expr: str, mapping: dict, default: str) -> str:
    """Literal lookup as SQL ``CASE`` text."""
    whens = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {_sql_lit(default)} END)"


def _sql_pick(expr: str, values: list[str]) -> str:
    """values[expr mod n] as SQL text."""
    arr = ", ".join(_sql_lit(v) for v in values)
    return f"element_at(array({arr}), CAST(pmod({expr}, {len(values)}) + 1 AS INT))"


def _ts_ntz(date_str: str):
    """Timestamp literal of the column's own type (keeps the filter pushable)."""
    return F.expr(f"TIMESTAMP_NTZ '{date_str} 00:00:00'")


def months_before_py(as_of: str, n: int) -> str:
    """First day of the month ``n`` months before as_of's month."""
    y, m = int(as_of[:4]), int(as_of[5:7]) - n
    while m <= 0:
        y, m = y - 1, m + 12
    return f"{y:04d}-{m:02d}-01"


def client_id_of(key):
    return F.format_string("CLI_%010d", key.cast("long"))


class Client360:
    """Canonical tables over one test-data directory."""

    def __init__(self, data: TestData, as_of: str = AS_OF):
        self.data = data
        self.spark = data.spark
        self.as_of = as_of

    @cached_property
    def advisor_pool(self) -> int:
        """Advisors that clients are dealt to: all of them (a count from the
        file's footer)."""
        return max(1, self.data.supplier.count())

    # -- clients --------------------------------------------------------------
    @cached_property
    def clients(self) -> DataFrame:
        d = self.data
        nation = d.nation.select("n_nationkey", "n_name", "n_regionkey")
        region = d.region.select("r_regionkey", "r_name")
        c = (d.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
             # nation and region are fixed 25 / 5-row dimensions: safe to broadcast.
             .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
        # One SQL expression per column (a single JVM call each).
        k = "c_custkey"
        dual = f"pmod({k}, 9) < 2"
        tenure = f"CAST(120 + pmod({k}, 7910) AS INT)"
        return c.selectExpr(
            f"{k} AS client_key",
            f"format_string('CLI_%010d', CAST({k} AS BIGINT)) AS client_id",
            "c_name AS full_name",
            f"pmod({k}, 17) = 0 AS is_entity",
            f"date_add(DATE'1940-01-01', CAST(pmod({k} * 37, 20000) AS INT)) AS dob",
            f"{_sql_case('c_mktsegment', SEGMENT_BY_MKTSEGMENT, 'Affluent')} AS segment_tier",
            "n_name AS domicile", "n_name AS booking_centre", "r_name AS region",
            f"{_sql_pick(k, RISK_PROFILES)} AS risk_profile",
            f"{_sql_case(f'pmod({k}, 10)', KYC_BY_KEY_MOD10, 'verified')} AS kyc_status",
            f"CASE WHEN pmod({k}, 3) = 0 THEN concat({_sql_pick(k, LANGUAGES)}, '|', {_sql_pick(f'{k} + 3', LANGUAGES)}) "
            f"ELSE {_sql_pick(k, LANGUAGES)} END AS languages",
            "concat(lower(regexp_replace(c_name, '#', '.')), '@example.com') AS email",
            f"format_string('+41 %012d', {k} * 7919) AS phone",
            f"format_string('%d Lake Road', pmod({k}, 97) + 1) AS address_line",
            "n_name AS city",
            f"format_string('ADV_%06d', pmod({k}, {self.advisor_pool})) AS primary_advisor_id",
            f"CASE WHEN {dual} THEN 'apex|summit' WHEN pmod({k}, 2) = 0 THEN 'apex' ELSE 'summit' END AS source_banks",
            f"{dual} AS dual_banked",
            f"CAST(CAST(CAST(greatest(c_acctbal, 0.0D) AS {MONEY}) * 1000 AS {MONEY}) AS DOUBLE) AS total_aum_usd",
            f"date_sub(DATE'{self.as_of}', {tenure}) AS first_seen_date",
            f"{tenure} AS tenure_days",
            f"CASE WHEN pmod({k}, 5) < 3 THEN format_string('HH%010d', CAST(floor({k} / 8) AS BIGINT)) "
            f"ELSE format_string('HH_SOLO_%d', {k}) END AS household_id",
            f"pmod({k}, 4) != 0 AS marketing_consent",
        )

    # -- accounts -------------------------------------------------------------
    @cached_property
    def accounts(self) -> DataFrame:
        o = self.data.orders.select("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
        acct_type = map_lookup("o_orderpriority", ACCOUNT_TYPE_BY_PRIORITY, "unmapped")
        # Partial aggregation per (client, account type) before the shuffle.
        g = (o.groupBy(F.col("o_custkey").alias("client_key"), acct_type.alias("account_type"))
             .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("gross"),
                  F.min("o_orderdate").alias("opened")))
        liab = F.col("account_type").isin(*LIABILITY_ACCOUNT_TYPES)
        return g.select(
            F.format_string("ACC_%010d_%s", "client_key", F.substring("account_type", 1, 3)).alias("account_id"),
            client_id_of(F.col("client_key")).alias("client_id"),
            "client_key", "account_type",
            F.lit("USD").alias("currency"),
            F.lit("active").alias("status"),
            F.to_date("opened").alias("open_date"),
            F.when(liab, -F.col("gross")).otherwise(F.col("gross")).cast(MONEY).cast("double").alias("balance_usd"),
        )

    # -- portfolios / holdings -------------------------------------------------
    @cached_property
    def portfolios(self) -> DataFrame:
        o = self.data.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
        acct_type = map_lookup("o_orderpriority", ACCOUNT_TYPE_BY_PRIORITY, "unmapped")
        return o.select(
            F.format_string("PF_%012d", "o_orderkey").alias("portfolio_id"),
            F.format_string("ACC_%010d_%s", "o_custkey", F.substring(acct_type, 1, 3)).alias("account_id"),
            client_id_of(F.col("o_custkey")).alias("client_id"),
            F.col("o_custkey").alias("client_key"),
            acct_type.alias("mandate_type"),
            F.lit("MSCIWORLD").alias("benchmark"),
            F.lit("USD").alias("currency"),
            F.col("o_totalprice").alias("market_value_usd"),
            F.to_date("o_orderdate").alias("inception_date"),
        )

    @cached_property
    def holdings(self) -> DataFrame:
        d = self.data
        li = d.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
        o = d.orders.select("o_orderkey", "o_custkey")
        p = d.part.select("p_partkey", "p_name", "p_type")
        h = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        return h.select(
            F.format_string("H_%012d_%d", "l_orderkey", "l_linenumber").alias("holding_id"),
            F.format_string("PF_%012d", "l_orderkey").alias("portfolio_id"),
            client_id_of(F.col("o_custkey")).alias("client_id"),
            F.col("o_custkey").alias("client_key"),
            F.format_string("XS%010d", "p_partkey").alias("isin"),
            F.col("p_name").alias("instrument_name"),
            map_lookup("p_type", ASSET_CLASS_BY_PART_TYPE, "unmapped").alias("asset_class"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("market_value_usd"),
            F.lit("USD").alias("currency"),
        )

    # -- transactions -----------------------------------------------------------
    @cached_property
    def transactions(self) -> DataFrame:
        d = self.data
        li = d.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                               "l_returnflag", "l_linestatus", "l_shipdate")
        o = d.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
        t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        acct_type = map_lookup("o_orderpriority", ACCOUNT_TYPE_BY_PRIORITY, "unmapped")
        return t.select(
            F.format_string("TXN_%012d_%d", "l_orderkey", "l_linenumber").alias("txn_id"),
            F.format_string("ACC_%010d_%s", "o_custkey", F.substring(acct_type, 1, 3)).alias("account_id"),
            client_id_of(F.col("o_custkey")).alias("client_id"),
            F.col("o_custkey").alias("client_key"),
            map_lookup(F.concat_ws("|", "l_returnflag", "l_linestatus"), TXN_TYPE_BY_FLAG_STATUS, "unmapped")
             .alias("txn_type"),
            F.col("l_extendedprice").alias("amount_usd"),
            F.lit("USD").alias("currency"),
            F.to_date("l_shipdate").alias("value_date"),
            _pick(F.col("l_suppkey"), COUNTERPARTIES).alias("counterparty"),
        )

    # -- monthly client flows ----------------------------------------------------
    @cached_property
    def client_flows(self) -> DataFrame:
        """Per client and month: inflow (flag N), outflow (flag R), net = in − out.

        Kept as exact decimals; every month of the data is in.
        """
        return self.client_flows_from(None)

    def client_flows_from(self, first_month: str | None) -> DataFrame:
        """``client_flows`` restricted to months ≥ ``first_month`` (a date
        string).  The bound is also stated on the raw ship timestamp so it
        reaches the parquet scan as a pushed filter (row-group skipping)."""
        d = self.data
        li = d.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag", "l_shipdate")
        if first_month:
            li = li.filter(F.col("l_shipdate") >= _ts_ntz(first_month))
        o = d.orders.select("o_orderkey", "o_custkey")
        month = F.trunc(F.to_date("l_shipdate"), "MM")
        amt = F.col("l_extendedprice").cast(MONEY)
        f = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy(F.col("o_custkey").alias("client_key"), month.alias("month"))
             .agg(F.sum(F.when(F.col("l_returnflag") == "N", amt).otherwise(F.lit(0).cast(MONEY))).alias("inflow_usd"),
                  F.sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(F.lit(0).cast(MONEY))).alias("outflow_usd")))
        return f.select(
            client_id_of(F.col("client_key")).alias("client_id"), "client_key", "month",
            (F.col("inflow_usd") - F.col("outflow_usd")).alias("net_new_money_usd"),
            "inflow_usd", "outflow_usd")

    def client_activity(self, recent_from) -> DataFrame:
        """Per client: ``n_txns`` order lines, the net flow ``recent`` of the
        months from ``recent_from`` (a date Column) on, and all in- and outflow
        (``fin``, ``fout``): the sums of ``transactions`` and ``client_flows``.

        One join of lines and orders gives all of them, and its rows are added
        up by client at once: no row per client and month is made.
        """
        d = self.data
        zero = F.lit(0).cast(MONEY)
        side = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).cast("byte")
        li = d.lineitem.select("l_orderkey", F.col("l_extendedprice").cast(MONEY).alias("amt"), side.alias("side"),
                               (F.trunc(F.to_date("l_shipdate"), "MM") >= recent_from).alias("is_recent"))
        o = d.orders.select("o_orderkey", "o_custkey")
        into, out = (F.when(F.col("side") == i, F.col("amt")).otherwise(zero) for i in (1, 2))
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("client_key"))
                .agg(F.count("*").alias("n_txns"), F.sum(F.when(F.col("is_recent"), into - out).otherwise(zero)).alias("recent"),
                     F.sum(into).alias("fin"), F.sum(out).alias("fout")))

    # -- market time series ----------------------------------------------------------
    def ts_monthly(self, metric: str = "aum") -> DataFrame:
        """Monthly marts: (month, division, region, value) in USD bn-like units.

        ``aum`` = order value, ``nna`` = finished minus open order value,
        ``revenue`` = 1 % of order value.
        """
        d = self.data
        o = d.orders.select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
        c = d.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        nation = d.nation.select("n_nationkey", "n_regionkey")
        region = d.region.select("r_regionkey", "r_name")
        amt = F.col("o_totalprice").cast(MONEY)
        if metric == "aum":
            v = amt
        elif metric == "nna":
            v = (F.when(F.col("o_orderstatus") == "F", amt)
                 .when(F.col("o_orderstatus") == "O", -amt).otherwise(F.lit(0).cast(MONEY)))
        elif metric == "revenue":
            v = amt
        else:
            raise ValueError(f"unknown metric {metric!r}")
        j = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
             .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
        g = (j.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month"),
                       map_lookup("c_mktsegment", DIVISION_BY_MKTSEGMENT, "GWM").alias("division"),
                       F.col("r_name").alias("region"))
             .agg(F.sum(v).alias("v")))
        scale = 1e8 if metric == "revenue" else 1e6
        return g.select("month", "division", "region", (F.col("v").cast("double") / scale).alias("value"))

    # -- advisors, legal entities, products ---------------------------------------
    @cached_property
    def advisors(self) -> DataFrame:
        d = self.data
        k = F.col("s_suppkey")
        s = (d.supplier.select("s_suppkey", "s_name", "s_nationkey")
             .join(F.broadcast(d.nation.select("n_nationkey", "n_name", "n_regionkey")),
                   F.col("s_nationkey") == F.col("n_nationkey"))
             .join(F.broadcast(d.region.select("r_regionkey", "r_name")),
                   F.col("n_regionkey") == F.col("r_regionkey")))
        return s.select(
            F.format_string("ADV_%06d", k).alias("advisor_id"),
            F.col("s_name").alias("name"),
            _pick(k, ADVISOR_ROLES).alias("role"),
            F.concat(F.col("r_name"), F.lit(" desk")).alias("desk"),
            F.col("n_name").alias("booking_centre"),
            F.col("r_name").alias("market"),
            _pick(k, LANGUAGES).alias("languages"),
            F.when(F.pmod(k, F.lit(2)) == 0, "apex").otherwise("summit").alias("source_bank"),
        )

    @cached_property
    def legal_entities(self) -> DataFrame:
        d = self.data
        k = F.col("s_suppkey")
        s = (d.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
             .join(F.broadcast(d.nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")))
        return s.select(
            F.format_string("LE_%06d", k).alias("entity_id"),
            _pick(k, ENTITY_TYPES).alias("entity_type"),
            F.concat(F.col("s_name"), F.lit(" Holdings")).alias("name"),
            F.col("n_name").alias("jurisdiction"),
            client_id_of(k * UBO_STRIDE).alias("ubo_client_id"),
            (k * UBO_STRIDE).alias("ubo_client_key"),
            (F.col("s_acctbal") < 0).alias("risk_flag"),
        )

    @cached_property
    def products(self) -> DataFrame:
        k = F.col("p_partkey")
        p = self.data.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        return p.select(
            F.format_string("PRD_%08d", k).alias("product_id"),
            map_lookup("p_type", ASSET_CLASS_BY_PART_TYPE, "unmapped").alias("product_type"),
            F.col("p_name").alias("name"),
            F.format_string("%s %s mandate, size %d", "p_brand", "p_type", "p_size").alias("description"),
            _pick(k, SEGMENT_TIERS).alias("target_segment_hint"),
            _pick(k, PLATFORMS).alias("origin_platform"),
        )

    # -- households (AGG-15) --------------------------------------------------------
    @cached_property
    def households(self) -> DataFrame:
        """member_count, total AuM (2 dp) and the sorted distinct account types
        held by members.  Solo ids (``HH_SOLO_*``) have no household row."""
        c = self.clients.filter(~F.col("household_id").startswith("HH_SOLO_"))
        members = (c.groupBy("household_id")
                   .agg(F.count("*").alias("member_count"),
                        F.sum(F.col("total_aum_usd").cast(MONEY)).alias("aum")))
        # Distinct (household, type) first: bounded by 6 types per household,
        # so collect_set below never gathers an unbounded group.
        lines = (c.select("household_id", "client_key")
                 .join(self.accounts.select("client_key", "account_type"), "client_key")
                 .select("household_id", "account_type").distinct()
                 .groupBy("household_id")
                 .agg(F.array_join(F.array_sort(F.collect_list("account_type")), "|").alias("lines_held")))
        return (members.join(lines, "household_id", "left")
                .select("household_id",
                        F.col("household_id").alias("address_key"),
                        F.col("member_count").cast("int").alias("member_count"),
                        F.col("aum").cast("double").alias("total_aum_usd"),
                        F.coalesce("lines_held", F.lit("")).alias("lines_held")))
