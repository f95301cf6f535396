"""Results stay right past the sizes at which ids, keys and groups used to wrap."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientlens.operators import resolve as ER
from clientlens.operators.canonical import Client360
from clientlens.operators.components import connected_components
from clientlens.operators.embed import chunk
from clientlens.operators.forecast import forecast
from clientlens.operators.keydrivers import key_drivers
from clientlens.operators.vector import _topk_block
from clientlens.plans import unify


class Customers:
    """Test data with generated customers."""

    def __init__(self, spark, n):
        self.spark = spark
        key = F.col("id")
        self.customer = spark.range(1, n + 1).select(key.alias("c_custkey"), F.format_string("Customer#%09d", key).alias("c_name"), (key % 25).cast("int").alias("c_nationkey"),
                                                     F.lit(100.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
        self.nation = spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), F.lit(0).alias("n_regionkey"))
        self.supplier = spark.range(10)
        self.region = spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string")


def test_resolution_finds_every_client_past_20000(spark):
    c = Client360(Customers(spark, 60_000))
    resolved = unify.resolved(c).persist()
    acc = ER.pairwise_accuracy(resolved, unify.truth(c)).first()
    assert acc.precision >= 0.99 and acc.recall >= 0.99
    assert resolved.select("cluster_id").distinct().count() == 60_000


def test_strangers_with_one_key_in_common_stay_apart(spark):
    rows = [("a:1", "Ann Lee", "ann lee", "1980-01-01", "4411111111", "ann.lee"), ("b:1", "Ann Lee", "ann lee", "1980-01-01", "4499887766", "x77"),
            ("a:2", "Bob Roe", "bob roe", "1970-01-01", "4422222222", "info"), ("b:2", "Cy Poe", "cy poe", "1970-01-01", "4433333333", "info")]
    records = spark.createDataFrame(rows, "record_id string, full_name string, name_norm string, dob string, phone string, email_local string")
    cluster = {r.record_id: r.cluster_id for r in ER.resolve(records).collect()}
    assert len(set(cluster.values())) == 4


def test_every_pair_under_a_hot_default_key_is_compared(spark, monkeypatch):
    monkeypatch.setattr(ER, "FEW", 8)
    dob, phone = "1900-01-01", "0000000000"
    stranger = lambda i: "".join(chr(97 + (i * p + i // 7) % 26) for p in (3, 5, 7, 11, 17, 19, 23, 25)) + f" {i}"
    names = [("a:0", "aaaa first"), *((f"m:{i}", stranger(i)) for i in range(1, 120)),
             ("b:1", "jonathan meyerhof"), ("n:1", "jonathan meyerhoff"),  # one person, not the first record
             ("c:1", "katharina wolf"), ("z:1", "katharina wolf"), ("z:2", "katharina wolf"),  # copies
             ("d:1", "aaaa firstxyz"), ("x:1", "aabb firstxyzw")]  # d links with the first record, x with d alone
    records = spark.createDataFrame([(i, n, n, dob, phone, None, None) for i, n in names],
                                    "record_id string, full_name string, name_norm string, dob string, phone string, email_local string, city string")

    def score(x, y):
        d = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, d[0] = d[0], i
            for j, b in enumerate(y, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (a != b))
        return (0.40 * (1 - d[-1] / max(len(x), len(y))) + 0.20 + 0.15) / 0.75

    group = {i: i for i, _ in names}
    for n, (i, x) in enumerate(names):
        for j, y in names[:n]:
            if score(x, y) >= ER.LINK_AT:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    cluster = {r.record_id: r.cluster_id for r in ER.resolve(records).collect()}
    assert cluster == group
    assert cluster["b:1"] == cluster["n:1"] and cluster["c:1"] == cluster["z:1"] == cluster["z:2"] and cluster["x:1"] == cluster["a:0"]
    assert score("aaaa first", "aabb firstxyzw") < ER.LINK_AT and len(set(cluster.values())) > 60


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000), 5000: 5000}


def test_nine_dimensions_need_no_order(spark):
    df = spark.createDataFrame([tuple([str(i)] * 9 + [i > 0, 1.0]) for i in range(2)], [*(f"d{i}" for i in range(9)), "flag", "m"])
    found = key_drivers(df, "m", [f"d{i}" for i in range(9)], "flag", min_apriori_support=0.5)
    assert sorted(r.n_dimensions for r in found.collect()) == [0] + [1] * 18  # longer ones select the same rows


def test_equal_vectors_give_exactly_k_neighbours():
    rows = pd.DataFrame({"qid": range(50), "id": range(50), "vec": [np.array([1.0, 0.0], np.float32)] * 50})
    out = _topk_block(6, True, 2)(rows[["qid", "vec"]], rows[["id", "vec"]])
    assert len(out) == 300
    assert out[out.query_id == 3].neighbor_id.sort_values().tolist() == [0, 1, 2, 4, 5, 6]


def test_chunk_ids_that_do_not_fit_raise(spark):
    big = spark.createDataFrame([(10 ** 13, "a b c")], "id long, text string")
    with pytest.raises(Exception, match="chunk_id does not fit"):
        chunk(big, "text", id_col="id").collect()


def test_forecast_of_very_large_values_and_of_one_year(spark):
    rows = [(f"2000-{m:02d}-01", 2e12 + m * 1e9 + (-1) ** m * 5e8) for m in range(1, 13)] + [("2001-01-01", 2.013e12)]
    out = forecast(spark.createDataFrame(rows, "ts string, v double"), "v", "ts", horizon=3).collect()
    assert all(r.prediction_interval_lower_bound < r.forecast_value < r.prediction_interval_upper_bound for r in out)
    assert all(2e12 < r.forecast_value < 2.03e12 for r in out)


def test_household_filter_keeps_large_household_numbers(spark):
    ids = spark.createDataFrame([("HH0000000001",), ("HH1000000000",), ("HH_SOLO_5",)], "household_id string")
    assert ids.where(~F.col("household_id").startswith("HH_SOLO_")).count() == 2


def test_a_cluster_without_a_checkpoint_folder_is_refused():
    import __spark_entry__ as entry

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        entry._local_checkpoint_dir_if_unset(Session())


# --- many strangers under one key --------------------------------------------------------

PEOPLE = "record_id string, full_name string, name_norm string, dob string, phone string, email_local string, city string"


def people(n, seed, word):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = " ".join(sorted(word(rng) for _ in range(2)))
        city = f"city{rng.randint(0, 24)}" if rng.random() < 0.95 else None
        out.append((f"r:{i:06d}", name, name, "1900-01-01", "0000000000", name.replace(" ", ".") + str(rng.randint(0, 9)), city))
    return out


def syllables(rng):
    return "".join(rng.choice(["an", "be", "chi", "do", "el", "fa", "gu", "ha", "is", "jo", "ka", "lu", "mi"]) for _ in range(rng.randint(2, 4)))


def letters(rng):
    return "".join(chr(97 + rng.randint(0, 25)) for _ in range(rng.randint(5, 9)))


def plain_score(x, y):
    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, u in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, v in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (u != v))
        return d[-1]
    total = weight = 0.0
    for name, w in ER.LINK_WEIGHTS.items():
        a, b = x[name], y[name]
        if a and b:
            weight += w
            total += w * (float(a == b) if name in ("dob", "city") else 1 - edits(a, b) / max(len(a), len(b)))
    return total / weight if weight else 0.0


def test_no_link_under_a_hot_key_is_lost(spark, monkeypatch):
    monkeypatch.setattr(ER, "FEW", 2)
    rng, rows = random.Random(3), []
    base = people(50, 5, syllables) + [("", "x" * 70, "x" * 70, "1900-01-01", "0000000000", "y" * 60, None)] * 3
    for i in range(180):
        row = list(rng.choice(base))
        row[0] = f"r:{i:06d}"
        for k in (2, 5):  # a few edits in name and e-mail
            for _ in range(rng.randint(0, 5) if rng.random() < 0.7 else 0):
                p = rng.randint(0, len(row[k]) - 1)
                row[k] = row[k][:p] + rng.choice(["", "x", "qq", row[k][p] * 2]) + row[k][p + 1:] or "z"
        row[5] = rng.choice([None, "", row[5], row[5], row[5], row[5]])
        row[6] = rng.choice([None, "city1", row[6], row[6], row[6]])
        row[2] = rng.choice([None, ""] + [row[2]] * 30)
        rows.append(tuple(row))
    records = [dict(zip(["record_id", "full_name", "name_norm", "dob", "phone", "email_local", "city"], r)) for r in rows]
    features = {r["record_id"]: tuple(r[c] or None for c in ER.LINK_WEIGHTS) for r in records}
    first = {}  # records with equal features are one
    for r in records:
        first.setdefault(features[r["record_id"]], r["record_id"])
    alone = {r["record_id"] for r in records if plain_score(r, records[0]) < ER.LINK_AT}
    want = {tuple(sorted((first[features[x["record_id"]]], first[features[y["record_id"]]])))
            for n, x in enumerate(records) for y in records[:n] if plain_score(x, y) >= ER.LINK_AT - 1e-12 and (x["record_id"] in alone or y["record_id"] in alone)}
    found = {tuple(sorted((first[features[r.a]], first[features[r.b]]))) for r in ER.scored_links(spark.createDataFrame(rows, PEOPLE)).where(F.col("score") >= ER.LINK_AT).collect()}
    assert {p for p in want if p[0] != p[1]} <= found
    by_id = {r["record_id"]: r for r in records}
    assert all(a == b or plain_score(by_id[a], by_id[b]) >= ER.LINK_AT - 1e-9 for a, b in found)


def test_compared_pairs_of_a_hot_key_stay_few(spark):
    compared = {}
    for n in (1500, 3000):
        rows = spark.createDataFrame(people(n, 1, letters), PEOPLE)
        members = rows.select(F.struct(F.lit("k").alias("key"), F.col("record_id").alias("id")).alias("id"), F.lit("k").alias("key"), F.struct(*ER.LINK_WEIGHTS).alias("f"),
                              F.lit(True).alias("apart"), F.lit(1).alias("no_city"))
        compared[n] = ER.hot_candidates(members).count()
    assert all(pairs < 0.0005 * n * (n - 1) / 2 for n, pairs in compared.items())
