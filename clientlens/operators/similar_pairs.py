"""Pairs of similar strings inside blocks, without comparing all pairs.

Two strings whose Levenshtein similarity is at least ``t`` have, of their
padded and numbered bigrams, at least ``1 + (2t - 1) L`` in common, ``L`` being
the longer one's length (an edit spoils two bigrams). So of each string's
bigrams, rarest first, a prefix can be taken that must hold the first two (for
long strings: the first) of those in common; each string goes to the groups
named by two bigrams of its prefix, and only strings that meet in a group can
be similar. Their bigrams also set bits in 128 places: of the bigrams of two
strings at ``k`` edits at most ``4k - |difference of lengths|`` are in one of
them only, which gives a lower bound of the edits from two whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Length up to which strings meet by two bigrams, beyond by one.
LONG = 48


def bigrams(text: str) -> str:
    """SQL for the bigrams of a padded string, equal ones numbered."""
    padded = f"concat('\\u0002', {text}, '\\u0003')"
    raw = f"transform(sequence(1, length({text}) + 1), i -> substring({padded}, i, 2))"
    return f"transform({raw}, (g, i) -> concat(g, size(filter(slice({raw}, 1, i), y -> y = g))))"


def signature(text: str) -> str:
    """SQL for a string's length and the 128 places that its bigrams set."""
    def half(k: int) -> str:
        return f"aggregate(filter({bigrams(text)}, g -> pmod(xxhash64(g), 128) div 64 = {k}), 0L, (b, g) -> b | shiftleft(1L, cast(pmod(xxhash64(g), 64) as int)))"
    return f"CASE WHEN {text} IS NOT NULL THEN named_struct('n', length({text}), 'low', {half(0)}, 'high', {half(1)}) END"


def fewest_edits(x: str, y: str) -> str:
    """SQL: no fewer edits lie between two strings than this, by their signatures."""
    apart = f"abs({x}.n - {y}.n)"
    return f"greatest({apart}, ceil((bit_count({x}.low ^ {y}.low) + bit_count({x}.high ^ {y}.high) + {apart}) / 4))"


def meeting_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows(block, id, text, ...)`` -> one row for each group of two (or one)
    rare bigrams in which a string must meet all that are similar to it. The
    text must have at least one character and the similarity be over 0.5."""
    least = f"cast(ceil(1 + {2 * similarity - 1!r} * n - 1e-9) as int)"
    held = written(rows.withColumn("grams", F.expr(bigrams("text"))).withColumn("n", F.length("text")))
    counts = held.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    ranked = (held.select("block", "id", F.explode("grams").alias("gram")).join(counts, "gram")
              .groupBy("block", "id").agg(F.expr("transform(array_sort(collect_list(struct(count, gram))), x -> x.gram)").alias("ranked")))
    own = held.drop("grams", "text").join(ranked, ["block", "id"])
    outs = []
    for ell, which in ((2, f"n <= {LONG}"), (1, f"n >= {LONG * similarity!r}")):
        names = "flatten(transform(sequence(1, size(p) - 1), i -> transform(slice(p, i + 1, size(p)), y -> concat(element_at(p, i), '\\u0001', y))))" if ell == 2 else "p"
        prefix = own.where(which).withColumn("p", F.expr(f"slice(ranked, 1, n + 1 - {least} + {ell})")).where(f"size(p) >= {ell}")
        outs.append(prefix.withColumn("meet", F.explode(F.expr(names))).drop("p", "ranked"))
    return outs[0].unionByName(outs[1])


def candidate_pairs(rows: DataFrame, similarity: float, both: str = "true") -> DataFrame:
    """Distinct ``(block, a, b)`` with ``a < b`` among the rows of a block that
    may be similar; ``both`` is a condition over the rows ``x`` and ``y``."""
    met = written(meeting_groups(rows, similarity))
    x, y = met.alias("x"), met.alias("y")
    alike = F.expr(f"x.id < y.id and least(x.n, y.n) >= {similarity - 1e-9!r} * greatest(x.n, y.n) and ({both})")
    return (x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.meet") == F.col("y.meet")) & alike)
            .select(F.col("x.block").alias("block"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
