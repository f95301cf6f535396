"""What a client's order lines add up to: one pass, same sums as by month."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clientlens.functions.numeric import safe_divide
from clientlens.operators import features as feat
from clientlens.operators.canonical import AS_OF, Client360

LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_returnflag string, l_linestatus string, l_shipdate string")


@pytest.fixture(scope="module")
def client360(spark):
    line = [(1, "N", 10.25, "2001-09-30 10:00:00"), (1, "R", 4.5, "2001-09-01 00:00:00"), (1, "A", 7.0, "2001-08-01 00:00:00"),
            (2, "R", 100.0, "2001-04-01 00:00:00"), (2, "N", 30.0, "2001-03-31 23:59:59"),  # at the edge of what is recent
            (3, "N", None, "2001-09-01 00:00:00"), (3, "N", None, "2001-08-01 00:00:00"),  # nothing but nulls
            (4, None, 5.0, "2001-09-01 00:00:00"), (4, "R", 6.0, None), (4, "R", None, "2001-09-02 00:00:00"),
            (5, "N", 1.0, "2001-09-01 00:00:00"), (5, "N", 1.0, "2001-09-01 00:00:00"),  # an order and a line twice
            (6, "R", 2.0, "1999-01-01 00:00:00"), (7, "N", 3.0, "2001-09-01 00:00:00"), (None, "N", 9.0, "2001-09-01 00:00:00")]
    rows = [(o, 1, 1, i, 1.0, p, f, "O", t) for i, (o, f, p, t) in enumerate(line)]
    lineitem = spark.createDataFrame(rows, LINES).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    orders = spark.createDataFrame([(1, 11), (2, 11), (3, 12), (4, 13), (5, 14), (5, 14), (6, 15), (7, None), (None, 16), (8, 17)], "o_orderkey long, o_custkey long")
    orders = orders.withColumn("o_orderpriority", F.lit("1-URGENT")).withColumn("o_totalprice", F.lit(1.0)).withColumn("o_orderdate", F.lit("2001-01-01").cast("timestamp_ntz"))
    return Client360(SimpleNamespace(spark=spark, lineitem=lineitem, orders=orders))


def test_activity_is_that_of_transactions_and_flows(client360):
    got = feat.flow_stats(client360.client_activity(feat.recent_from(AS_OF)))
    got = {r["client_key"]: (r["n_txns"], r["recent_net_flow_usd"] or 0.0, r["outflow_ratio"]) for r in got.collect()}
    count = {r["client_key"]: r["n"] for r in feat.counts_per_client(client360.transactions, "n").collect()}
    flows = client360.client_flows.groupBy("client_key").agg(
        F.sum(F.when(F.col("month") >= feat.recent_from(AS_OF), F.col("net_new_money_usd")).otherwise(F.lit(0))).cast("double").alias("recent"),
        F.sum("inflow_usd").alias("i"), F.sum("outflow_usd").alias("o")).withColumn("ratio", safe_divide(F.col("o"), F.col("i") + F.col("o") + 1))
    assert got == {r["client_key"]: (count[r["client_key"]], r["recent"] or 0.0, r["ratio"]) for r in flows.collect()}
    assert got[11][:2] == (5, 10.25 - 4.5 - 100.0) and got[14][:2] == (4, 4.0) and got[12] == (2, 0.0, None)


def _reads_of_lines(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("LogicalRDD" in line and "l_orderkey" in line for line in plan.splitlines())


def test_lines_are_read_once_and_not_grouped_by_month(client360, spark):
    clients = spark.createDataFrame([("CLI_11", 11, "HNW", "ASIA", "Growth", 100, 5.0, True, "expired")],
                                    "client_id string, client_key long, segment_tier string, region string, risk_profile string, tenure_days int, total_aum_usd double, dual_banked boolean, kyc_status string")
    f = feat.attrition_features(clients, client360.accounts, client360.client_activity(feat.recent_from(AS_OF)))
    assert _reads_of_lines(f) == 1
    row = f.collect()[0]
    assert (row["n_accounts"], row["n_txns"], row["recent_net_flow_usd"]) == (1, 5, -94.25)


def test_counts_at_hand_give_the_same_features(client360, spark):
    clients = spark.createDataFrame([(f"CLI_{k}", k, 100, 5.0) for k in (11, 11, 14, 17, 18, None)], "client_id string, client_key long, tenure_days int, total_aum_usd double")
    holdings = client360.transactions.select("client_key", F.lit("equity").alias("asset_class"), F.col("amount_usd").alias("market_value_usd"))
    whole = feat.client_features(clients, client360.accounts, client360.transactions, holdings)
    counted = whole.select("client_key", "n_accounts", "n_txns")
    short = feat.client_features(clients, client360.accounts, client360.transactions, holdings, counted)
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect()))
    assert len(whole.collect()) == 6
