"""Long lists of the near-duplicate search: strangers leave them, families are held against themselves once."""

import random

import pytest

from clientlens.llm import near_dup
from test_operators import brute_components, rows_of


def family_and_strangers():
    """A family at the edge of the threshold, and texts of rare words around one hot pair of words."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(2, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 400):
        own = [f"s{rng.randrange(60)}" for _ in range(40)]
        rows.append((i, " ".join([*own[:20], "hot", "pair", *own[20:]])))
    return rows


@pytest.mark.parametrize(("short", "full", "block"), [(64, 16, 768), (6, 2, 32)])
def test_long_lists_equal_brute_force_and_send_few_rows(spark, monkeypatch, short, full, block):
    sent = []
    within = near_dup._within

    def counted(rows, *more):
        sent.append(rows.select("node").distinct().count())
        return within(rows, *more)

    monkeypatch.setattr(near_dup, "LIST", short)
    monkeypatch.setattr(near_dup, "FULL_LIST", full)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "_within", counted)
    rows = family_and_strangers()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(near_dup.near_duplicates(table, 2)) == sorted(brute_components(rows, 2), key=str)
    assert sent[0] <= 150  # no stranger is held against the others


def test_strangers_of_a_hot_pair_do_not_stay_in_its_list(spark):
    lists = spark.createDataFrame([(i, [1, 2, 100 + i, 200 + i, 300 + i]) for i in range(90)] + [(i, [1, 2, 3, 4, 5]) for i in range(90, 93)], "node long, vs array<long>")
    rows = lists.selectExpr("1L as v", "node", "node as component", "3 as least", "0 as place")
    assert sorted(r.node for r in near_dup._stay(rows, lists).collect()) == [90, 91, 92]


def test_members_of_long_lists_are_one_row_each(spark, monkeypatch):
    made = []
    durable = near_dup.durable

    def counted(df):
        out = durable(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "durable", counted)
    values = list(range(2, 30))
    lists = spark.createDataFrame([(i, [1, *values]) for i in range(80)] + [(90, [1])], "node long, vs array<long>")
    rows = lists.selectExpr("1L as v", "node", "node as component", "if(node = 90, 1, 12) as least", "0 as place")
    assert near_dup._stay(rows, lists).count() == 81
    assert max(made) <= 81  # not one for each later value
