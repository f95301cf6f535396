import pytest
from pyspark.sql import functions as F

from clientlens.operators.keydrivers import key_drivers

ROWS = [
    # tier, region, centre, metric, is_recent
    ("HNW", "APAC", "Hong Kong", 100.0, True), ("HNW", "APAC", "Hong Kong", 40.0, False),
    ("HNW", "EMEA", "London", 30.0, True), ("HNW", "EMEA", "London", 60.0, False),
    ("UHNW", "EMEA", "London", 50.0, True), ("UHNW", "EMEA", "Zurich", 20.0, False),
    ("UHNW", "APAC", "Singapore", 10.0, True), ("UHNW", "APAC", "Hong Kong", 5.0, False),
]
DIMS = ["tier", "region", "centre"]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "tier string, region string, centre string, m double, recent boolean")


def test_population_row_and_formulas(spark):
    kd = {tuple(r.drivers): r for r in key_drivers(frame(spark), "m", DIMS, "recent", enable_pruning=False).collect()}
    all_row = kd[("all",)]
    assert all_row.metric_interest == 190.0 and all_row.metric_reference == 125.0
    assert abs(all_row.unexpected_difference) < 1e-9
    hnw = kd[("tier=HNW",)]
    assert hnw.metric_interest == 130.0 and hnw.metric_reference == 100.0
    assert abs(hnw.relative_difference - 0.3) < 1e-12
    exp = 100.0 * 190.0 / 125.0
    assert abs(hnw.unexpected_difference - (130.0 - exp)) < 1e-9
    assert abs(hnw.apriori_support - max(130 / 190, 100 / 125)) < 1e-12
    leaf = [r for k, r in kd.items() if len(k) == 3]
    assert abs(sum(r.contribution for r in leaf) - 1.0) < 1e-9
    assert abs(sum(r.difference for r in leaf) - all_row.difference) < 1e-9
    # unexpected difference sums to zero over any complete single dimension
    assert abs(sum(r.unexpected_difference for k, r in kd.items() if len(k) == 1 and k[0].startswith("tier="))) < 1e-9


def test_pruning_drops_functionally_implied_segments(spark):
    kd = key_drivers(frame(spark), "m", DIMS, "recent", enable_pruning=True)
    keys = {tuple(r.drivers) for r in kd.collect()}
    # centre=London implies region=EMEA: the two-dimension segment selects the same rows
    assert ("centre=London",) in keys and ("region=EMEA", "centre=London") not in keys
    assert ("region=EMEA",) in keys
    full = key_drivers(frame(spark), "m", DIMS, "recent", enable_pruning=False)
    assert kd.count() < full.count()


def test_top_k_and_support(spark):
    kd = key_drivers(frame(spark), "m", DIMS, "recent", top_k=3).collect()
    assert len(kd) == 4 and sum(1 for r in kd if r.drivers == ["all"]) == 1
    kd2 = key_drivers(frame(spark), "m", DIMS, "recent", min_apriori_support=0.5).collect()
    assert all(r.apriori_support >= 0.5 for r in kd2 if r.drivers != ["all"])


def test_negative_metric_needs_zero_support(spark):
    df = frame(spark).withColumn("m", F.when(F.col("tier") == "HNW", -F.col("m")).otherwise(F.col("m")))
    assert key_drivers(df, "m", DIMS, "recent", min_apriori_support=0.0).count() > 0
    with pytest.raises(Exception):
        key_drivers(df, "m", DIMS, "recent", top_k=5).collect()


def test_segment_absent_in_one_period(spark):
    rows = ROWS + [("Family Office", "EMEA", "Geneva", 7.0, True)]
    kd = {tuple(r.drivers): r for r in key_drivers(frame(spark, rows), "m", DIMS, "recent").collect()}
    fo = kd[("tier=Family Office",)]
    assert fo.metric_reference == 0.0 and fo.relative_difference is None


# --- level-wise search ------------------------------------------------------------------

def keyed(kd):
    return {tuple(r.drivers) + (r.n_dimensions,): tuple(round(v, 9) if isinstance(v, float) else v for v in r[1:]) for r in kd.collect()}


def random_rows(seed, n, with_nulls=True, hot=0.0):
    import random
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = "hot" if rng.random() < hot else rng.choice(["HNW", "UHNW", None if with_nulls else "x"])
        b = rng.choice(["APAC", "EMEA", "AMER"])
        rows.append((a, b, {"APAC": "Tokyo", "EMEA": "Zurich", "AMER": rng.choice(["Miami", "Lima"])}[b], rng.randint(0, 2), rng.random() < 0.5, float(rng.randint(0, 40)), rng.random() < 0.5))
    return rows


WIDE = "tier string, region string, centre string, band int, flag boolean, m double, recent boolean"
WIDE_COLS = ["tier", "region", "centre", "band", "flag"]


@pytest.mark.parametrize(("support", "pruning"), [(None, True), (0.03, True), (0.2, False)])
def test_levels_equal_the_cube(spark, support, pruning):
    from clientlens.operators.driver_levels import key_drivers_by_levels
    df = spark.createDataFrame(random_rows(1, 300), WIDE)
    args = {"min_apriori_support": support, "enable_pruning": pruning}
    levels = key_drivers_by_levels(df, "m", WIDE_COLS, "recent", **args)
    cube = key_drivers(df, "m", WIDE_COLS, "recent", **args)
    assert levels.columns == cube.columns
    # tokens leave null values out, so two segments can share their drivers: compare as lists
    plain = lambda kd: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in kd.collect())
    assert plain(levels) == plain(cube)


def test_levels_top_k_order_and_baseline(spark):
    from clientlens.operators.driver_levels import key_drivers_by_levels
    df = spark.createDataFrame(random_rows(2, 200, with_nulls=False), WIDE)
    for args in ({"top_k": 7, "max_order": 2}, {"baseline": "complement", "min_apriori_support": 0.1}):
        assert keyed(key_drivers_by_levels(df, "m", WIDE_COLS, "recent", **args)) == keyed(key_drivers(df, "m", WIDE_COLS, "recent", **args))


def test_levels_of_no_rows_and_negative_values(spark):
    from clientlens.operators.driver_levels import key_drivers_by_levels
    empty = spark.createDataFrame([], WIDE)
    assert [r.drivers for r in key_drivers_by_levels(empty, "m", WIDE_COLS, "recent", min_apriori_support=0.1).collect()] == [["all"]]
    df = spark.createDataFrame(random_rows(3, 60, with_nulls=False), WIDE).withColumn("m", F.col("m") - 10)
    with pytest.raises(ValueError, match="negative"):
        key_drivers_by_levels(df, "m", WIDE_COLS, "recent", min_apriori_support=0.1)
    assert keyed(key_drivers_by_levels(df, "m", WIDE_COLS, "recent", min_apriori_support=0.0)) == keyed(key_drivers(df, "m", WIDE_COLS, "recent", min_apriori_support=0.0))


def test_twelve_dimensions_with_a_hot_value(spark):
    import random
    rng = random.Random(5)
    dims = [f"d{j}" for j in range(12)]
    rows = [tuple("hot" if rng.random() < 0.4 else f"v{rng.randint(0, 9)}" for _ in dims) + (float(rng.randint(1, 9)), rng.random() < 0.5) for _ in range(2000)]
    df = spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", m double, recent boolean")
    found = {tuple(r.drivers): r.apriori_support for r in key_drivers(df, "m", dims, "recent", min_apriori_support=0.05).collect()}
    # brute force over the item sets that can have the support
    total = {t: sum(r[12] for r in rows if r[13] is t) for t in (True, False)}
    level, want = [()], {}
    while level:
        grown = []
        for seg in level:
            for j in range(seg[-1][0] + 1 if seg else 0, 12):
                for v in {r[j] for r in rows}:
                    new = (*seg, (j, v))
                    own = [r for r in rows if all(r[i] == x for i, x in new)]
                    support = max(sum(r[12] for r in own if r[13] is t) / total[t] for t in (True, False))
                    if support >= 0.05:
                        grown.append(new)
                        want[tuple(f"d{i}={x}" for i, x in new)] = support
        level = grown
    assert set(found) - {("all",)} == set(want) and all(abs(found[k] - s) < 1e-9 for k, s in want.items())


def test_levels_work_shrinks_with_support(spark):
    from clientlens.operators import driver_levels as dl
    df = spark.createDataFrame(random_rows(4, 400, with_nulls=False), WIDE)
    n = [dl.key_drivers_by_levels(df, "m", WIDE_COLS, "recent", min_apriori_support=s, enable_pruning=False).count() for s in (0.02, 0.1)]
    assert n[0] > n[1]
    joined = dl.BROADCAST_ROWS
    try:  # the same rows where survivors are joined instead of broadcast
        dl.BROADCAST_ROWS = 0
        assert dl.key_drivers_by_levels(df, "m", WIDE_COLS, "recent", min_apriori_support=0.1, enable_pruning=False).count() == n[1]
    finally:
        dl.BROADCAST_ROWS = joined
