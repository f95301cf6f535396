import duckdb
from pyspark.sql import functions as F

from clientlens.functions import numeric as N
from clientlens.functions import text as T
from clientlens.functions import vectors as V


def test_rnd_half_up_and_binary_doubles(spark):
    df = spark.createDataFrame([(1.005,), (0.145,), (-2.5,), (2.675,)], "x double")
    got = [r[0] for r in df.select(N.rnd("x", 2)).collect()]
    assert got == [1.01, 0.15, -2.5, 2.68]
    assert df.select(N.rnd("x", 0)).collect()[2][0] == -3.0


def test_md5_bucket_matches_sql_engine(spark):
    ids = [f"CLI_{i:010d}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r[0]: r[1] for r in df.select("id", N.md5_bucket("id")).collect()}
    con = duckdb.connect()
    for i in ids[:50]:
        want = con.execute(f"select ('0x' || substr(md5('{i}'), 1, 8))::bigint % 10").fetchone()[0]
        assert got[i] == want
    share = sum(1 for v in got.values() if v < 8) / len(got)
    assert 0.7 < share < 0.9


def test_hash_uniform_range_and_determinism(spark):
    df = spark.range(1000).select(N.hash_uniform(F.col("id"), "s").alias("u"))
    a = [r.u for r in df.collect()]
    b = [r.u for r in df.repartition(7).orderBy("u").collect()]
    assert all(0 <= x < 1 for x in a)
    assert sorted(a) == [x for x in b]


def test_normal_cdf(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (-1.0,)], "z double")
    got = [r[0] for r in df.select(N.normal_cdf("z")).collect()]
    assert abs(got[0] - 0.5) < 1e-7 and abs(got[1] - 0.975) < 1e-6 and abs(got[2] - 0.158655) < 1e-6


def test_name_canonicalisation(spark):
    df = spark.createDataFrame([("Müller, Hans",), ("HANS MÜLLER",), ("H. Müller",), ("Alpine Hldg",)], "n string")
    got = [r[0] for r in df.select(T.canonical_name("n")).collect()]
    assert got == ["Hans Müller", "Hans Müller", "H. Müller", "Alpine Holdings"]
    last = [r[0] for r in df.select(T.last_name_token("n")).collect()]
    assert last[:3] == ["müller"] * 3


def test_email_country_currency(spark):
    df = spark.createDataFrame([("Anna.Meier42@bank.ch", "CH"), ("x@y.z", "Narnia")], "e string, c string")
    r = df.select(T.email_local("e"), T.canonical_country("c"), T.currency_for_domicile("c")).collect()
    assert tuple(r[0]) == ("anna.meier", "Switzerland", "CHF")
    assert tuple(r[1]) == ("x", "Narnia", "USD")


def test_kv_tokens_and_label(spark):
    df = spark.createDataFrame([(["region=APAC", "banking=Single-bank"],), (["all"],), (["odd"],)], "d array<string>")
    rows = df.select(T.kv_label(T.parse_kv_tokens("d")).alias("l")).collect()
    assert [r.l for r in rows] == ["APAC · Single-bank", "(overall)", "odd"]


def test_labels(spark):
    df = spark.createDataFrame([(2.5e9, "apex|summit", None), (3.25e6, "summit", False), (999.0, "apex", False)],
                               "x double, sb string, d boolean")
    r = df.select(T.money_label("x"), T.provenance_label("sb", "d"), T.title_words(F.lit("fixed_income"))).collect()
    assert [tuple(x) for x in r] == [("$2.5bn", "Apex + Summit", "Fixed Income"),
                                     ("$3.3m", "Summit Bank", "Fixed Income"), ("$999", "Apex Bank", "Fixed Income")]
    t = spark.createDataFrame([(0.7,), (0.5,), (0.1,)], "r double").select(T.flight_risk_tone("r")).collect()
    assert [x[0] for x in t] == ["red", "amber", "green"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]),
                                ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine_distance("a", "b")).collect()]
    assert abs(got[0] - 1) < 1e-12 and abs(got[1]) < 1e-12 and abs(got[2] - 2) < 1e-12 and got[3] is None
