"""Hot-key fixtures: one key holds a third of all rows.  Results must stay
whole and equal to a brute-force computation."""

import pandas as pd
from pyspark.sql import functions as F

from clientlens.operators import graph as G
from clientlens.operators import resolve as ER
from clientlens.operators.keydrivers import key_drivers


def test_key_drivers_with_hot_dimension_value(spark):
    rows = []
    for i in range(900):
        tier = "HOT" if i % 3 == 0 else f"T{i % 7}"
        rows.append((tier, f"R{i % 4}", float(i % 50 + 1), i % 2 == 0))
    pdf = pd.DataFrame(rows, columns=["tier", "region", "m", "recent"])
    df = spark.createDataFrame(pdf)
    kd = {tuple(r.drivers): r for r in key_drivers(df, "m", ["tier", "region"], "recent", enable_pruning=False).collect()}
    hot = pdf[pdf.tier == "HOT"]
    assert kd[("tier=HOT",)].metric_interest == hot[hot.recent].m.sum()
    assert kd[("tier=HOT",)].metric_reference == hot[~hot.recent].m.sum()
    assert kd[("all",)].metric_interest == pdf[pdf.recent].m.sum()
    assert len(kd) == 1 + pdf.tier.nunique() + pdf.region.nunique() + pdf.groupby(["tier", "region"]).ngroups


def test_graph_with_hot_household(spark):
    n = 900
    hh = ["HOT" if i < n // 3 else f"H{i // 3}" for i in range(n)]
    clients = spark.createDataFrame([(i, hh[i], "A1", 1.0) for i in range(n)],
                                    "client_key long, household_id string, primary_advisor_id string, total_aum_usd double")
    households = clients.select("household_id").distinct()
    acc_rows = [(i, "advisory" if i % 2 else "lombard") for i in range(n)] + [(i, "deposit") for i in range(0, n, 5)]
    accounts = spark.createDataFrame(acc_rows, "client_key long, account_type string").withColumn("account_id", F.lit("x"))
    advisors = spark.createDataFrame([("A1", "Ann", "desk")], "advisor_id string, name string, desk string")
    got = {(r.client_key, r.product): r.signal
           for r in G.household_mate_products(G.client_graph(clients, households, accounts, advisors)).collect()}
    a = pd.DataFrame(acc_rows, columns=["client_key", "product"])
    a["household_id"] = [hh[k] for k in a.client_key]
    per_hh = a.groupby(["household_id", "product"]).size()
    want = {(i, p): int(c) for i in range(n) for (h, p), c in per_hh.items() if h == hh[i]}
    assert got == want
    assert got[(0, "deposit")] == len(range(0, n // 3, 5))


def test_resolution_with_hot_blocking_key(spark):
    rows = []
    for i in range(300):
        bank = "apex" if i % 2 == 0 else "summit"
        phone = "41000000000" if i < 100 else f"41{i:09d}"  # a third share one phone (and dob)
        dob = "1970-01-01" if i < 100 else f"19{50 + i % 40}-01-{1 + i % 28:02d}"
        rows.append((bank, f"K{i}", f"Person {i}", dob, phone, f"p{i}"))
    recs = (spark.createDataFrame(rows, "source_bank string, source_key string, full_name string, dob string, "
                                        "phone string, email_local string")
            .withColumn("dob", F.to_date("dob"))
            .withColumn("record_id", F.concat_ws(":", "source_bank", "source_key"))
            .withColumn("name_norm", ER.name_norm("full_name")))
    cl = {r.record_id: r.cluster_id for r in ER.resolve(recs).collect()}
    hot = {cl[f"{'apex' if i % 2 == 0 else 'summit'}:K{i}"] for i in range(100)}
    assert len(hot) == 1 and len(cl) == 300
    assert len(set(cl.values())) == 1 + 200
