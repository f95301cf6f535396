"""Product codes of vectors: the codebook of each part by ball k-means.

A vector of whole numbers is cut into equal parts. The parts that an entry of
the codebook holds are its ball, whose radius bounds their distances to the
entry. After entries have moved, only a part outside its ball's stable core
(half the distance to the nearest other entry) can change its entry, and only
to an entry that lies within twice the part's distance: entries ordered by
distance divide a ball into rings, and the parts of the k-th ring have the k
nearest entries for candidates. A ball whose entry and neighbours (entries
within twice its radius) did not move keeps all its parts untouched. All
distances are whole numbers, so codes are those of an exhaustive search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, durable, prepare, table_of
from .vectors import finite, floors, gathered, packed, unpacked

#: Candidates of a ring that are compared in one matrix product.
RING = 64
#: Labels whose sums are broadcast; beyond, they are joined.
BROADCAST_LABELS = 100_000
#: Whole numbers up to this size are exact in double precision.
EXACT = 2.0 ** 53


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts and entries, exact; parts x entries. Sizes
    that doubles cannot hold are computed in Python's whole numbers."""
    most = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * max(1, x.shape[1]) * most * most < EXACT else object
    a, b = x.astype(kind), entries.astype(kind)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _own(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each part to the entry in its row."""
    most = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * max(1, x.shape[1]) * most * most < EXACT else object
    gap = x.astype(kind) - entries.astype(kind)
    return (gap * gap).sum(axis=1)


def first_nearest(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of the smallest value of each row, the smallest column first; value)."""
    at = distance.argmin(axis=1)
    return at, distance[np.arange(len(at)), at]


@dataclass
class Book:
    """Codebook of one part, with what ball k-means knows of it: ``order`` has
    the other entries of each by distance, ``gaps`` their squared distances,
    ``still`` the balls that no neighbour can take a part from."""

    entries: np.ndarray
    radius: np.ndarray | None = None
    moved: np.ndarray | None = None
    order: np.ndarray = field(init=False)
    gaps: np.ndarray = field(init=False)
    still: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.entries)
        between = squared(self.entries, self.entries)
        others = np.argsort(between.astype(np.float64), axis=1, kind="stable")
        own = others == np.arange(n)[:, None]
        self.order = others[~own].reshape(n, n - 1)
        self.gaps = np.take_along_axis(between, self.order, axis=1)
        self.still = np.zeros(n, bool)
        if self.radius is not None:
            near = self.gaps.astype(np.float64) <= (4 * self.radius ** 2)[:, None]
            self.still = ~self.moved & ~(near & self.moved[self.order]).any(axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry of each part, squared distance); ``before`` has the
        entries that the parts had before the entries moved."""
        if before is None or len(self.entries) == 1:
            return first_nearest(squared(x, self.entries))
        code, best = before.copy(), _own(x, self.entries[before])
        reach = 4 * best
        loose = np.flatnonzero(~self.still[before] & (reach >= self.gaps[before, 0]))
        loose = loose[np.argsort(before[loose], kind="stable")]
        cuts = np.flatnonzero(np.diff(before[loose], prepend=-1))
        for rows in np.split(loose, cuts[1:]) if len(loose) else []:
            ball = before[rows[0]]
            ring = np.searchsorted(self.gaps[ball], reach[rows], side="right")
            for a in range(0, int(ring.max()), RING):
                inside = ring > a
                own, names = rows[inside], self.order[ball, a:a + RING]
                names = np.sort(names[:int(ring.max()) - a])
                at, least = first_nearest(squared(x[own], self.entries[names]))
                name = names[at]
                better = (least < best[own]) | ((least == best[own]) & (name < code[own]))
                code[own[better]], best[own[better]] = name[better], least[better]
        return code, best


def _pieces(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    width = rows.shape[1] // parts
    return [rows[:, p * width:(p + 1) * width] for p in range(parts)]


def _assigned(rows: np.ndarray, codes: np.ndarray | None, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    found = [book.assign(x, None if codes is None else codes[:, p].astype(np.int64)) for p, (book, x) in enumerate(zip(books, _pieces(rows, len(books)), strict=True))]
    return np.stack([c for c, _ in found], axis=1), np.stack([d if d.dtype == object else d.astype(np.int64) for _, d in found], axis=1)


def _bytes(codes: np.ndarray) -> pa.Array:
    raw, width = codes.astype(np.uint8).tobytes(), codes.shape[1]
    return pa.array([raw[i * width:(i + 1) * width] for i in range(len(codes))], pa.binary())


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _round(state: DataFrame, books: list[Book], dim: int, names: list[str]) -> DataFrame:
    """``state`` with the entries that are nearest now. The first round reads
    the vectors themselves, later ones whole numbers and codes."""
    parts, shared = len(books), state.sparkSession.sparkContext.broadcast(books)
    schema = ", ".join([*(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")), "x binary, code binary, error long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            if names[-1] == "embedding":
                at, matrix = finite(batch.column(2))
                if not len(at):
                    continue
                if matrix.shape[1] != dim:
                    raise ValueError("vectors of different lengths")
                rows, codes = floors(matrix, 1024), None
                batch = batch.take(pa.array(at))
                x = packed(rows)
            else:
                x = batch.column(2)
                rows, codes = unpacked(x, dim), _codes(batch.column(3), parts)
            codes, distance = _assigned(rows, codes, shared.value)
            error = distance.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x, _bytes(codes), pa.array(error, pa.int64())], ["vec_id", "label", "x", "code", "error"])

    return state.select(*names).mapInArrow(run, schema)


def _sums(state: DataFrame, books: list[Book], dim: int) -> dict[tuple[int, int], tuple[int, list[int], float]]:
    """(part, entry) -> parts held, their sums, largest squared distance. A
    task adds up its rows first; one row an entry comes to the driver."""
    parts, width, shared = len(books), dim // len(books), state.sparkSession.sparkContext.broadcast([b.entries for b in books])
    fields = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_ = shared.value
        n = np.zeros((parts, len(books_[0])), np.int64)
        total, far = np.zeros((parts, len(books_[0]), width), np.int64), np.zeros((parts, len(books_[0])))
        for batch in gathered(batches):
            codes = _codes(batch.column(1), parts).astype(np.int64)
            for p, x in enumerate(_pieces(unpacked(batch.column(0), dim), parts)):
                if float(np.abs(x).max(initial=0)) * len(x) + float(np.abs(total).max(initial=0)) >= 2.0 ** 62:
                    raise OverflowError("a sum is beyond 64-bit whole numbers")
                n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
                np.add.at(total[p], codes[:, p], x)
                np.maximum.at(far[p], codes[:, p], _own(x, books_[p][codes[:, p]]).astype(np.float64))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(far[part, entry]),
                                          *(pa.array(total[part, entry, k]) for k in range(width))], ["part", "entry", "n", "far", *fields])

    rows = (state.select("x", "code").mapInArrow(run, ", ".join(["part int, entry int, n long, far double", *(f"{f} long" for f in fields)]))
            .groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *(F.sum(f).alias(f) for f in fields)).collect())
    return {(r.part, r.entry): (r.n, [r[f] for f in fields], r.far) for r in rows}


def _moved(books: list[Book], sums: dict[tuple[int, int], tuple[int, list[int], float]]) -> list[Book]:
    """Every entry at the floor of its parts' mean; unused ones stay. A ball's
    radius grows at most by its entry's way."""
    out = []
    for p, book in enumerate(books):
        entries, radius = book.entries.copy(), np.zeros(len(book.entries))
        for e in range(len(entries)):
            if (p, e) in sums:
                n, total, far = sums[p, e]
                entries[e] = [s // n for s in total]
                radius[e] = far ** 0.5
        way = np.sqrt(_own(entries, book.entries).astype(np.float64))
        out.append(Book(entries, (radius + way) * (1 + 1e-9) + 1e-6, way > 0))
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> ``vec_id, code, error,
    label_error, codebooks_sha256``.

    Rows whose vector is null or holds a null or non-finite component are
    dropped. Components become ``floor(1024 * x)``. The codebooks start as the
    parts of the ``size`` (256 at most) smallest vec_ids, null ids last, rows
    with equal ids in the order of their vectors; with fewer rows they are
    smaller. Every row keeps its own result, also where ids repeat. Labels of
    any type are summed, nulls together. No kept row gives no rows. Other
    columns are not read. Vectors of different lengths, a length that ``parts``
    does not divide, and numbers beyond 64 bits raise."""
    spark = vectors.sparkSession
    prepare(spark)
    names = ["vec_id", "label", "embedding"]
    source = vectors.select(*names)
    whole = "embedding is not null and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    head = source.where(whole).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(size).collect()
    result = f"vec_id {source.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if not head:
        return spark.createDataFrame([], result)
    if not 1 <= size <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    if len({len(r.embedding) for r in head}) > 1:
        raise ValueError("vectors of different lengths")
    first = floors(np.array([r.embedding for r in head], np.float64), 1024)
    dim = first.shape[1]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components do not have {parts} equal parts")
    books = [Book(x) for x in _pieces(first, parts)]
    state, path = source, None
    for _ in range(rounds):
        state, last = table_of(_round(state, books, dim, names)), path
        path = state.path
        state, names = state.rows, ["vec_id", "label", "x", "code"]
        if last:
            drop_table(spark, last)
        books = _moved(books, _sums(state, books, dim))
    coded = table_of(_round(state, books, dim, names).select("vec_id", "label", "code", "error"))
    if path:
        drop_table(spark, path)
    sums = durable(coded.rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    joined = coded.rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest([b.entries for b in books])).alias("codebooks_sha256"))


def _sql(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    """The same by exhaustive search, every step over all parts and entries."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT id, p, CAST(min(d * {size} + e) // {size} AS BIGINT) AS d, CAST(min(d * {size} + e) % {size} AS BIGINT) AS e
  FROM (SELECT x.id, x.p, b.e, x.q + b.q - 2 * CAST(list_inner_product(x.x, b.x) AS BIGINT) AS d FROM piece x JOIN book{r} b ON x.p = b.p)
  GROUP BY id, p)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT n.p, n.e, c.i, CAST(floor(CAST(sum(CAST(c.v AS BIGINT)) AS DECIMAL(38, 0)) / count(*)) AS DOUBLE) AS m
    FROM near{r} n JOIN cell c ON n.id = c.id AND n.p = c.p GROUP BY n.p, n.e, c.i) GROUP BY p, e),
book{r + 1} AS (
  SELECT p, e, x, CAST(list_inner_product(x, x) AS BIGINT) AS q FROM (
    SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS (
  SELECT id, p, x, CAST(list_inner_product(x, x) AS BIGINT) AS q FROM (
    SELECT id, p, v[CAST(p * len(v) // {parts} + 1 AS BIGINT):CAST((p + 1) * len(v) // {parts} AS BIGINT)] AS x FROM kept, range({parts}) t(p))),
cell AS (SELECT id, p, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM piece),
book0 AS (SELECT p, id AS e, x, q FROM piece WHERE id < {size}),{','.join(steps)},
found AS (
  SELECT k.vec_id, k.label, string_agg(lower(printf('%02x', n.e)), '' ORDER BY n.p) AS code, CAST(sum(n.d) AS BIGINT) AS error
  FROM kept k JOIN near{rounds} n ON k.id = n.id GROUP BY k.id, k.vec_id, k.label),
summed AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM found GROUP BY label)
SELECT f.vec_id, f.code, f.error, s.label_error,
       (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
        FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM book{rounds})) AS codebooks_sha256
FROM found f JOIN summed s ON f.label IS NOT DISTINCT FROM s.label"""


SQL = _sql()
