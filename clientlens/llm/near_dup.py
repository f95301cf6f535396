"""Near-duplicate groups by bottom-k sketches of one hash function.

Texts with the same shingle set are one class. A class keeps the k smallest
hashes of its set (bottom-k sketch). Two sets with a similarity of 0.8 or more
share ``0.4 k`` of their retained values or more but for a chance of 2.6e-8 at
k = 32 (sets of up to k shingles: always); the filter on the union's sketch
loses another 3.3e-9 at most. So with the retained values
of each class in order of rarity they meet in the inverted list of one of the
``k - 0.4 k + 1`` rarest. Lists of frequent values are met only by classes
whose other retained values are as frequent.

Within a list, classes are compared with one member of it, the hub, first:
copies that are near each other are then linked by as many links as there are
copies. After that only members of different components have to meet. In short
lists they do pair by pair, if the bits that their retained values set leave
room for the similarity. Pairs of a long list never become rows: a member
stays only if enough of its later values are also those of a member of another
component, and those that stay (families whose sketches are alike, and few
strangers) are joined by a prefix of their full sets, rarest shingles first,
with the positions in both sets as a bound. What is then left in long lists
are families at the edge of the threshold; each is held against itself once,
in blocks. All candidates pass the exact similarity of the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import written
from .common import durable, likely, prepare, slices, texts_of
from .words import SLICE_BYTES, scramble, shingle_sets

K = 32
#: Share of the retained values that similar sets have in common at least.
SHARED = 0.4
#: Share of the union's own bottom-k that similar sets have in common at least.
ESTIMATE = 0.36
#: Members up to which a list is compared pair by pair: of retained values,
#: and of the shingles of full sets. Longer ones of the latter are compared in
#: blocks of about so many members.
LIST, FULL_LIST, BLOCK = 64, 16, 768
#: In a block: sets up to which a value's pairs are counted one by one, and
#: columns of the incidence matrix multiplied at once.
RARE, COLUMNS = 6, 4096
#: Bits of the bitmap of values that members of long lists share: 128 KB to 32 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Long numbers whose bits the retained values of a class set.
PLACES = [f"bits{i}" for i in range(4)]

FEATURES = "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>"


def features(docs: DataFrame, shingle: int, k: int = K) -> DataFrame:
    """Set size, 128-bit set fingerprint and bottom-k sketch of every text."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in texts_of(batch.column(1))]
            for a, b in slices(map(len, texts), SLICE_BYTES):
                sets = shingle_sets(texts[a:b], shingle)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([int(scramble(s, salt).sum().astype(np.int64)) for s in sets], pa.int64()) for salt in (1, 2)),
                    pa.array([s[:k].astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(build, FEATURES)


def _alike(n_a: Column, n_b: Column, threshold: tuple[int, int]) -> Column:
    """Whether set sizes leave room for the similarity."""
    num, den = threshold
    return den * F.least(n_a, n_b) >= num * F.greatest(n_a, n_b)


def estimate(a: Column, b: Column, k: int, threshold: tuple[int, int]) -> Column:
    """Whether the union's own bottom-k, as both sketches give it, allows the
    similarity. Unions of fewer than k values are whole, so held exactly."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    num, den = threshold
    return F.when(F.size(union) < k, den * both >= num * F.size(union)).otherwise(both >= int(ESTIMATE * k))


def _bits(i: int) -> Column:
    """The bits that a sketch sets in the ``i``-th of ``PLACES``."""
    return F.expr(f"aggregate(sketch, 0L, (b, x) -> b | if(((x >> 6) & {len(PLACES) - 1}) = {i}, shiftleft(1L, cast(x & 63 as int)), 0L))").alias(PLACES[i])


def _may_share(x: str, y: str) -> Column:
    """Whether the rows ``x`` and ``y`` may have enough retained values in
    common: a bit that only one of them has stands for a value of its own."""
    def common(a: str, b: str) -> Column:
        return F.expr(f"{a}.m - ({' + '.join(f'bit_count({a}.{p} & ~{b}.{p})' for p in PLACES)})")
    return F.least(common(x, y), common(y, x)) >= F.least(f"{x}.least", f"{y}.least")


def _prefix_lists(reps: DataFrame, k: int) -> DataFrame:
    """(node, n, m, least, bits, weight, vs, take): the retained values of every class
    that another one has, too, rarest first. The first ``take`` open lists: any
    similar class must share one of them. ``least`` of the ``m`` retained values
    are those of a similar class as well. ``weight`` adds up how many classes
    have each of a class's values: in a group of copies it is largest for the
    one that the others resemble most."""
    values = reps.select("node", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    sizes = (reps.select("node", "n", F.size("sketch").alias("m"), *(_bits(i) for i in range(len(PLACES))))
             .withColumn("least", F.greatest(F.lit(1), F.floor(SHARED * F.col("m"))).cast("int")))
    return (values.join(often, "v").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "v"))).alias("vs")).join(sizes, "node")
            .withColumn("take", (F.size("vs") - F.col("least") + 1).cast("int"))
            .where("take > 0")
            .select("node", "n", "m", "least", *PLACES, F.aggregate("vs", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("weight"),
                    F.transform("vs", lambda x: x["v"]).alias("vs"), "take"))


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    num, den = threshold
    met = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = written(likely(docs.select(F.col("doc_id").alias("id"), "text").where("text is not null"), "id", met))
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([t.encode() for t in texts_of(batch.column(c))] for c in (2, 3))
            keep = []
            for i, j in slices((len(x) + len(y) for x, y in zip(left, right, strict=True)), SLICE_BYTES):
                sets = shingle_sets(left[i:j] + right[i:j], shingle)
                for x, y in zip(sets[:j - i], sets[j - i:], strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _candidates(pairs: DataFrame, reps: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b), those whose sketches allow the similarity."""
    def side(x: str) -> DataFrame:
        return reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return (pairs.join(side("a"), "a").where("a <> b").join(side("b"), "b")
            .where(_alike(F.col("n_a"), F.col("n_b"), threshold))
            .where(estimate(F.col("sketch_a"), F.col("sketch_b"), k, threshold)).select("a", "b"))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _to_hubs(rows: DataFrame) -> DataFrame:
    """(node, hub): every member of a list with two other members of about the
    same set size, or of the next size: the one most like the others, and one
    by an order that all lists share, so that lists with the same members have
    the same hubs."""
    own = F.struct("node", "m", "least", *PLACES)
    hubs = durable(rows.groupBy("v", "band").agg(F.min_by(own, -F.col("weight")).alias("first"), F.min_by(own, F.xxhash64("node")).alias("second")))
    members = rows.select("v", "band", own.alias("x"))
    meets = members.union(members.withColumn("band", F.col("band") + 1))
    return (meets.join(hubs, ["v", "band"]).select("x", F.explode(F.array_distinct(F.array("first", "second"))).alias("y"))
            .where("x.node <> y.node").where(_may_share("x", "y")).select(F.col("x.node").alias("node"), F.col("y.node").alias("hub")))


def similar_links(reps: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int] = (4, 5), k: int = K) -> DataFrame:
    """``reps(node, n, sketch)`` -> ``node, component``: the components of the
    classes under the similarity, for classes with a link."""
    num, den = threshold
    lists = written(_prefix_lists(reps, k))
    reps = durable(reps.join(lists.select("node"), "node", "left_semi"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
    rows = lists.select("node", band.alias("band"), "n", "m", "least", "weight", *PLACES, F.posexplode(F.expr("slice(vs, 1, take)")).alias("place", "v"))
    rows = written(rows)
    pairs = durable(_ordered(_to_hubs(rows), "node", "hub"))
    links = durable(verify(durable(_candidates(pairs, reps, k, threshold)), docs, shingle, threshold))
    member = connected_components(links)

    left = rows.drop("band", "weight").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = durable(left.groupBy("v").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("v", "c"))
    near = _ordered(_across(left.join(mixed.where(F.col("c") <= LIST).select("v"), "v"), threshold), "a", "b").join(pairs, ["a", "b"], "left_anti")
    more = durable(verify(durable(_candidates(durable(near), reps, k, threshold)), docs, shingle, threshold))
    stay = _stay(left.join(mixed.where(F.col("c") > LIST).select("v"), "v").select("v", "node", "component", "least", "place"), lists)
    rows, full = _by_full_sets(stay, docs, shingle, threshold)
    full = durable(_ordered(full, "a", "b").join(pairs, ["a", "b"], "left_anti"))
    links = links.union(more).union(durable(verify(full, docs, shingle, threshold)))
    return connected_components(links.union(durable(_within(rows, docs, shingle, threshold))))


def _across(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of members of different components in the short lists."""
    x, y = rows.alias("x"), rows.alias("y")
    return (x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
                   & _alike(F.col("x.n"), F.col("y.n"), threshold) & _may_share("x", "y"))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The long numbers in ``keys`` as bits: at the place that the low bits of
    each give. 16 places for a key and more, from ``LEAST_BITS`` to ``MOST_BITS``."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.col("key"), F.lit(bits))
    words = (keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _stay(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, component) of the members of long lists that can have a similar
    one there, and a few more. Two similar classes meet in the first value that
    they share; of the values after it they share all but one of those that
    they must, so each of these is met in the list by classes of two
    components. Which are so met is a bitmap of bounded size; a member with its
    later values is one row that is held against it."""
    later = durable(rows.join(lists.select("node", "vs"), "node").select("node", "component", "least", F.expr("transform(slice(vs, place + 2, size(vs)), u -> xxhash64(v, u))").alias("keys")))
    met = durable(later.select("component", F.explode("keys").alias("key")).groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(met))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bits = batch.column(3), shared.value
            slot = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(64 * len(bits) - 1)
            hit = bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)
            held = np.diff(np.concatenate(([0], np.cumsum(hit.astype(np.int64))))[keys.offsets.to_numpy() - keys.offsets[0].as_py()])
            yield batch.select([0, 1]).filter(pa.array(held >= batch.column(2).to_numpy() - 1))

    kept = durable(later.mapInArrow(hold, "node long, component long").distinct())
    shared.destroy()
    return kept


def _by_full_sets(classes: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``classes(node, component)`` -> the members (v, node, component) of long
    lists, and pairs (a, b) of different components from the short ones. All
    that are similar meet in one. With a set's shingles by rarity, two similar
    sets share one of the first ones of both: of the larger set's ``n`` they
    have ``t n`` in common, of the smaller one's ``2 t n / (1 + t)``. Shingles
    of one component only come first and meet nothing. At the first shingle
    that is shared, what follows in both must hold the rest."""
    num, den = threshold
    texts = likely(docs.where("text is not null").select(F.col("doc_id").alias("node"), "text"), "node", classes.select("node")).join(classes, "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in texts_of(batch.column(2))]
            for i, j in slices(map(len, raw), SLICE_BYTES):
                sets = [s.astype(np.int64) for s in shingle_sets(raw[i:j], shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], ["node", "component", "s"])

    sets = written(texts.select("node", "component", "text").mapInArrow(build, "node long, component long, s array<long>").withColumn("key", F.xxhash64("s")).dropDuplicates(["node", "key"]))
    each = sets.select("node", "key", "component", F.size("s").alias("n"), F.explode("s").alias("s"))
    live = each.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("s", "df")
    ranked = each.join(live, "s").groupBy("node", "key", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ss"))

    def first(share: str) -> Column:  # shingles of a prefix that are left beside those of one component
        return F.expr(f"n - cast(ceil({share}) as int) + 1 - (n - size(ss))")
    probe, index = first(f"n * {num} / {den}"), first(f"n * {2 * num} / {num + den}")
    rows = written(ranked.withColumn("index", index).withColumn("gone", F.col("n") - F.size("ss")).withColumn("ss", F.slice("ss", 1, F.greatest(probe, F.lit(0))))
                   .select("node", "component", "n", "index", "gone", F.posexplode("ss").alias("at", "s"))
                   .select("node", "component", "n", F.col("s.s").alias("s"), (F.col("n") - F.col("gone") - F.col("at")).alias("rest"), (F.col("at") < F.col("index")).alias("index")))
    sizes = durable(rows.groupBy("s").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("index").alias("met")).where("lo < hi and met").select("s", "c"))
    long = durable(rows.join(sizes.where(F.col("c") > FULL_LIST), "s").select(F.col("s").alias("v"), "node", "component"))
    short = rows.join(sizes.where(F.col("c") <= FULL_LIST).select("s"), "s")
    x, y = short.alias("x"), short.where("index").alias("y")
    return long, (x.join(y, F.expr(f"""x.s = y.s and x.component <> y.component and y.n <= x.n and {den} * y.n >= {num} * x.n
                                 and {num + den} * least(x.rest, y.rest) >= {num} * (x.n + y.n)"""))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families in blocks of about ``BLOCK`` members: (the members with their
    block, the pairs of blocks that meet). A component with many members in a
    family has blocks of its own, which are not held against each other."""
    sizes = durable(rows.groupBy("v", "component").agg(F.count("*").alias("m")))
    large = F.col("m") > BLOCK // 4
    totals = durable(sizes.groupBy("v").agg(F.sum(F.when(large, 0).otherwise(F.col("m"))).alias("others")))
    placed = durable(rows.join(sizes, ["v", "component"]).join(totals, "v").select(
        "v", "node", "component", F.when(large, F.col("component")).otherwise(F.lit(-1)).alias("own"),
        F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("others") / BLOCK))).alias("part")))
    blocks = durable(placed.select("v", "own", "part").distinct())
    x, y = (blocks.select("v", F.struct("own", "part").alias(c)) for c in ("x", "y"))
    meets = x.join(y, "v").where("x <= y and not (x.own >= 0 and x.own = y.own)").withColumn("meet", F.xxhash64("v", "x", "y"))
    return placed, durable(meets.select("meet", "v", F.explode(F.array_distinct(F.array("x", "y"))).alias("at")).select("meet", "v", "at.own", "at.part"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, np.int64)
    often = np.diff(np.append(first, len(value)))
    total = np.zeros((n, n), np.float32)
    rank = np.repeat(np.arange(len(first)), often)
    for run in range(2, RARE + 1):  # values of few sets: count their pairs
        at = first[often == run]
        for i in range(run):
            for j in range(i + 1, run):
                np.add.at(total, (owner[at + i], owner[at + j]), 1)
    total += total.T
    common = np.flatnonzero(often > RARE)
    for a in range(0, len(common), COLUMNS):  # the others: products of slices of the incidence matrix
        part = common[a:a + COLUMNS]
        lo, hi = first[part[0]], first[part[-1]] + often[part[-1]]
        inside = often[rank[lo:hi]] > RARE
        matrix = np.zeros((n, len(part)), np.float32)
        matrix[owner[lo:hi][inside], np.searchsorted(part, rank[lo:hi][inside])] = 1
        total += matrix @ matrix.T
    return total


def _within(rows: DataFrame, docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between members of different components in the long lists of full
    sets. Lists that share members are one family, so a text is sent for its
    family and not for each of its lists; only links leave a block, never the
    pairs looked at."""
    num, den = threshold
    lists = rows.select(F.col("node").alias("a"), (-1 - F.abs(F.xxhash64("v") % (1 << 62))).alias("b"))  # lists as negative nodes
    family = connected_components(lists).withColumnRenamed("component", "v")
    members = durable(rows.select("node", "component").distinct().join(family, "node"))
    placed, meets = _blocks(members)
    placed = durable(placed.join(meets, ["v", "own", "part"]).select("meet", "node", "component"))
    texts = likely(docs.where("text is not null").select(F.col("doc_id").alias("node"), "text"), "node", members.select("node"))
    texts = placed.join(texts, "node").select("meet", "node", "component", "text")

    def look(block: pd.DataFrame) -> pd.DataFrame:
        raw = [t.encode() for t in block["text"]]
        sets = [s for a, b in slices(map(len, raw), SLICE_BYTES) for s in shingle_sets(raw[a:b], shingle)]
        n = np.array([len(s) for s in sets])
        shared = _overlaps(sets)
        component = block["component"].to_numpy()
        alike = (den * shared >= num * (n[:, None] + n[None, :] - shared)) & (component[:, None] < component[None, :])
        i, j = np.nonzero(alike)
        found = pd.DataFrame({"p": component[i], "q": component[j], "a": block["node"].to_numpy()[i], "b": block["node"].to_numpy()[j]})
        return found.drop_duplicates(["p", "q"])[["a", "b"]]  # one link joins two components

    return texts.groupBy("meet").applyInPandas(look, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (4, 5), k: int = K) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where their sets of distinct ``shingle``-word
    shingles (A-Z lower-cased; the whole sequence where there are fewer words)
    have a Jaccard similarity of ``threshold`` or more; ``component_id`` is the
    smallest doc_id of the component, ``kept`` whether it is the row's own.
    Null, empty and blank texts have an empty set and no link. One row per
    input row; rows that repeat a doc_id are the same document; a null doc_id
    takes part through its text but is never a component's id if another row
    has the same words. Other columns are not read."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = durable(features(docs, shingle, k))
    classes = durable(found.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node")))
    chosen = classes.where("node is not null").withColumnRenamed("node", "doc_id")
    reps = durable(found.join(chosen, ["doc_id", "fp1", "fp2"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"]))
    member = similar_links(reps, docs, shingle, threshold, k)
    of = durable(classes.join(member, "node", "left").select("fp1", "fp2", F.coalesce("component", "node").alias("component_id")))
    return (found.join(of, ["fp1", "fp2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
