import datetime
import random

from clientlens.operators.flow_paths import circular_flows


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def brute(rows, hops, months):
    def limit(d):
        m = d.month - 1 + months
        return datetime.date(d.year + m // 12, m % 12 + 1, 1)
    best = {}
    for s, d, t, _ in rows:
        stack = [(d, t, 1)]
        key, end = (s, t.replace(day=1)), limit(t)
        while stack:
            place, since, hop = stack.pop()
            if place == s:
                best[key] = min(best.get(key, (99, None)), (hop, since), key=lambda x: (x[0], x[1] or day(0)))
            elif hop < hops:
                stack += [(d2, t2, hop + 1) for s2, d2, t2, _ in rows if s2 == place and since <= t2 < end]
    return best


def test_circles_equal_brute_force(spark):
    rng = random.Random(3)
    rows = list({(s, d, day(t)): (s, d, day(t), 10.0) for s, d, t in ((rng.randint(1, 14), rng.randint(1, 14), rng.randint(0, 200)) for _ in range(150))}.values())
    df = spark.createDataFrame([*((*r, "x") for r in rows), (None, 1, day(3), 1.0, "x"), (1, None, day(3), 1.0, "x"), (1, 2, None, 1.0, "x")], "src long, dst long, day date, amount_usd double, n_hops string")
    for hops, months in ((4, 2), (2, 1)):
        found = {(r.client_key, r.month): (r.n_hops, r.returned_on) for r in circular_flows(df, hops, months).collect()}
        assert found == brute(rows, hops, months)
    out = {(r.client_key, r.month): r.outflow_usd for r in circular_flows(df, 2, 1).collect()}
    assert all(v == sum(10.0 for s, _, t, _ in rows if s == c and t.replace(day=1) == m) for (c, m), v in out.items())


def test_a_hot_place_is_one_row_for_each_start(spark):
    # everyone pays the hub, and the hub pays everyone: no row for each pair of a payer and a payee's payer
    rows = [(c, 0, day(1), 1.0) for c in range(1, 400)] + [(0, c, day(2 + c % 20), 1.0) for c in range(1, 400)]
    found = circular_flows(spark.createDataFrame(rows, "src long, dst long, day date, amount_usd double"), 4, 2)
    got = {r.client_key: (r.n_hops, r.returned_on) for r in found.collect()}
    assert len(got) == 399 and all(got[c] == (2, day(2 + c % 20)) for c in range(1, 400))


def test_no_payments_no_circles(spark):
    assert circular_flows(spark.createDataFrame([], "src long, dst long, day date, amount_usd double")).collect() == []
