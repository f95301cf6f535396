"""TVF-04: approximate cosine search over product-quantised codes.

The index holds, for each vector, the nearest of some coarse cells and a code:
the unit vector is cut into parts, and each part is named by the nearest entry
of its codebook (one byte). Cells and codebooks are fitted to a bounded hashed
sample; every row is indexed. A search

1. sends each query to the groups of cells that it probes. A group is a run of
   neighbouring cells with about ``GROUP_ROWS`` members, so a query has one row
   a group and not one a cell, and members travel as codes of a few bytes;
2. inside a group compares queries with the decoded members of the cells they
   probe, and keeps the best ``rerank`` for each query;
3. joins the best ``rerank`` over all groups with the vectors themselves and
   orders them by exact distance.

The numbers of probes and of candidates are found once, when the index is made:
a hashed sample of the rows is searched exactly, and as many cells are probed,
and candidates ranked again, as hold the asked share of the true neighbours.
They are kept with the index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import rnd
from ..session import drop_table, spread, write_table
from .vector import DIST_DP, _centroid_dist, _stack, _unit

#: Rows that cells and codebooks are fitted to, and queries that the number of
#: probes is found by.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 256
#: Members of a group of cells and queries of a part of them, about.
GROUP_ROWS, QUERY_ROWS = 1 << 17, 4096
#: Scores of queries with a cell, and candidates beyond the best, that are held
#: at once; rows that are compared with all cells at once.
SCORES, CANDIDATES, CELL_ROWS = 1 << 22, 1 << 21, 1024
#: Share of the true neighbours in probed cells that the codes may not lose.
CODE_SHARE = 0.985
#: Added to the recall asked for, as that of a sample differs.
MARGIN = 0.02


def _lloyd(rows: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    _, first = np.unique(rows, axis=0, return_index=True)
    entries = rows[np.sort(first)[:k]]  # distinct rows: copies would be entries that nothing gets
    for _ in range(steps):
        near = _centroid_dist(rows, entries).argmin(axis=1)
        n = np.bincount(near, minlength=len(entries))
        sums = np.stack([np.bincount(near, weights=rows[:, d], minlength=len(entries)) for d in range(rows.shape[1])], axis=1)
        entries = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], entries)
    return entries


def _codes_of(units: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    width = units.shape[1] // len(books)
    return np.stack([_centroid_dist(units[:, p * width:(p + 1) * width], b).argmin(axis=1) for p, b in enumerate(books)], axis=1).astype(np.uint8)


def _decoded(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1)


def _cut(frames):
    """The rows of ``frames`` as frames of at most ``CELL_ROWS`` rows."""
    for frame in frames:
        for a in range(0, len(frame), CELL_ROWS):
            yield frame.iloc[a:a + CELL_ROWS]


def _best(parts: list[tuple], ids: np.ndarray, keep: int) -> tuple:
    """Of candidates (query, member, distance), the nearest ``keep`` of each query."""
    row, member, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids[member], far, row))
    row, member, far = row[order], member[order], far[order]
    best = (np.arange(len(row)) - np.searchsorted(row, row) < keep) & (far < 9)
    return row[best], member[best], far[best]


@dataclass
class PQIndex:
    """``codes(id, cell, code)`` and ``vectors(id, vec)`` are tables; cells,
    codebooks, the cells' groups, the probes and the number of candidates that
    are ranked again stay with the driver."""

    codes: DataFrame
    vectors: DataFrame
    cells: np.ndarray
    books: list[np.ndarray]
    first_group: np.ndarray
    groups_of: np.ndarray
    sizes: np.ndarray
    n_rows: int
    n_probe: int
    rerank: int
    paths: list[str]

    def release(self) -> None:
        for path in self.paths:
            drop_table(self.codes.sparkSession, path)


def _order(cells: np.ndarray) -> np.ndarray:
    """Cells along the direction in which they differ most, so that a group's
    cells are near each other."""
    gap = cells - cells.mean(axis=0)
    return cells[np.argsort(gap @ np.linalg.svd(gap, full_matrices=False)[2][0], kind="stable")] if len(cells) > 1 else cells


def build_index(base: DataFrame, id_col: str, vec_col: str, top_k: int = 6, recall: float = 0.9, parts: int = 32) -> PQIndex | None:
    """Index of the rows with an id and a vector; none if there are no such
    rows. ``parts`` is lowered to a divisor of the vectors' length."""
    spark = base.sparkSession
    rows = base.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    seen = Observation()
    vectors, vector_path = write_table(spread(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))).observe(seen, F.count(F.lit(1)).alias("n")))
    if not (n := seen.get["n"]):
        return None
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    units = _unit(_stack(sample["vec"], len(sample["vec"].iloc[0])))
    dim = units.shape[1]
    while dim % parts:
        parts -= 1
    width = dim // parts
    cells = _order(_lloyd(units, int(min(max(1, n ** 0.5), max(1, len(units) // 8)))))
    books = [_lloyd(units[:, p * width:(p + 1) * width], 256) for p in range(parts)]
    shared = spark.sparkContext.broadcast((cells, books))

    def encode(frames):
        cells_, books_ = shared.value
        for frame in _cut(frames):
            u = _unit(_stack(frame["vec"], dim))
            code = _codes_of(u, books_)
            raw = code.tobytes()
            yield pd.DataFrame({"id": frame["id"], "cell": _centroid_dist(u, cells_).argmin(axis=1).astype("int32"), "code": [raw[i * parts:(i + 1) * parts] for i in range(len(code))]})

    codes, code_path = write_table(vectors.mapInPandas(encode, "id long, cell int, code binary"))
    sizes = np.zeros(len(cells), np.int64)
    for r in codes.groupBy("cell").count().collect():  # one row a cell
        sizes[r["cell"]] = r["count"]
    # runs of cells up to GROUP_ROWS members; a larger cell is several groups
    first, many, group, held = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64), 0, 0
    for c, size in enumerate(sizes.tolist()):
        if held and held + size > GROUP_ROWS:
            group, held = group + 1, 0
        first[c] = group
        held += size
        if size > GROUP_ROWS:
            many[c] = -(-size // GROUP_ROWS)
            group, held = group + int(many[c]), 0
    index = PQIndex(codes, vectors, cells, books, first, many, sizes, n, 1, top_k, [vector_path, code_path])
    index.n_probe, index.rerank = _tuned(index, sample.head(SAMPLE_QUERIES), top_k, min(1.0, recall + MARGIN))
    return index


def _share(places: np.ndarray, share: float) -> int:
    """How many first places hold the share of ``places``."""
    return int(np.sort(places)[min(len(places), max(1, int(np.ceil(share * len(places))))) - 1]) + 1


def _tuned(index: PQIndex, sample: pd.DataFrame, k: int, recall: float) -> tuple[int, int]:
    """(cells to probe, candidates to rank again) that find the share
    ``recall`` of the sample's exact neighbours. All rows are compared with the
    sample twice; a task passes on its best for each query, then how many of
    its rows come before each true neighbour by their codes."""
    q, ids = _unit(_stack(sample["vec"], index.cells.shape[1])), sample["id"].to_numpy()
    shared = index.codes.sparkSession.sparkContext.broadcast((q, ids, index.cells, index.books))

    def blocks(frames):
        q_, ids_, _, books_ = shared.value
        for frame in _cut(frames):
            u = _unit(_stack(frame["vec"], q_.shape[1]))
            same = ids_[:, None] == frame["id"].to_numpy()[None, :]
            yield u, np.where(same, 9.0, 1 - q_ @ u.T), np.where(same, 9.0, 1 - q_ @ _decoded(_codes_of(u, books_), books_).T)

    def best(frames):
        top = None
        for u, far, about in blocks(frames):
            cell = np.broadcast_to(_centroid_dist(u, shared.value[2]).argmin(axis=1), far.shape)
            held = [far, about, cell] if top is None else [np.hstack(x) for x in zip(top, (far, about, cell), strict=True)]
            at = np.argsort(held[0], axis=1, kind="stable")[:, :k]
            top = [np.take_along_axis(x, at, axis=1) for x in held]
        if top is not None:
            n, m = top[0].shape
            yield pd.DataFrame({"q": np.repeat(np.arange(n), m), "far": top[0].ravel(), "about": top[1].ravel(), "cell": top[2].ravel().astype("int32")})

    order = Window.partitionBy("q").orderBy("far")
    found = (index.vectors.mapInPandas(best, "q int, far double, about double, cell int").withColumn("r", F.row_number().over(order))
             .where((F.col("r") <= k) & (F.col("far") < 9)).select("q", "about", "cell").toPandas())  # k rows for each query of the sample
    if found.empty:
        return 1, k
    true = index.codes.sparkSession.sparkContext.broadcast((found["q"].to_numpy(), found["about"].to_numpy()))

    def before(frames):
        at, about_ = true.value
        n = np.zeros(len(at), np.int64)
        for _, _, about in blocks(frames):
            n += (about[at] < about_[:, None] - 1e-12).sum(axis=1)
        yield pd.DataFrame({"i": np.arange(len(at)), "n": n})

    places = index.vectors.mapInPandas(before, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    rank = np.argsort(np.argsort(_centroid_dist(q, index.cells), axis=1, kind="stable"), axis=1, kind="stable")
    probed = _share(rank[found["q"].to_numpy(), found["cell"].to_numpy()], min(1.0, recall / CODE_SHARE))
    return probed, max(k, _share(places["n"].to_numpy(), CODE_SHARE))


def index_search(index: PQIndex | None, queries: DataFrame, id_col: str, vec_col: str, top_k: int = 6, exclude_self: bool = False) -> DataFrame:
    """``query_id, rank, neighbor_id, distance`` (cosine, 6 decimals, ties to
    the smaller id) by :class:`PQIndex`. Queries without an id or a vector, and
    an empty index, give no rows."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance double")
    rerank, dim = index.rerank, index.cells.shape[1]
    if queries is index.vectors:
        asked, n_queries, asked_path = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), index.n_rows, None
    else:
        seen = Observation()
        own = queries.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).cast("array<float>").alias("qvec"))
        asked, asked_path = write_table(spread(own).observe(seen, F.count(F.lit(1)).alias("n")))
        n_queries = seen.get["n"]
    query_parts = max(1, -(-n_queries // QUERY_ROWS))
    shared = spark.sparkContext.broadcast((index.cells, index.books, index.first_group, index.groups_of, index.sizes, index.n_probe))

    def route(frames):
        cells, _, first, many, sizes, n_probe = shared.value
        for frame in _cut(frames):
            near = np.argsort(_centroid_dist(_unit(_stack(frame["qvec"], dim)), cells), axis=1, kind="stable")
            # as many cells as hold k others, where the usual number does not
            enough = np.maximum(n_probe, (sizes[near].cumsum(axis=1) <= top_k).sum(axis=1) + 1)
            out: dict[str, list] = {"grp": [], "qid": [], "qvec": [], "probed": []}
            for qid, vec, own, n in zip(frame["qid"], frame["qvec"], near, enough.tolist(), strict=True):
                by_group: dict[int, list[int]] = {}
                for c in own[:n].tolist():
                    for g in range(int(first[c]), int(first[c] + many[c])):
                        by_group.setdefault(g, []).append(c)
                for g, cs in by_group.items():
                    out["grp"].append(g)
                    out["qid"].append(qid)
                    out["qvec"].append(np.asarray(vec, np.float32).tobytes())
                    out["probed"].append(np.array(cs, np.int32).tobytes())
            yield pd.DataFrame(out)

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        books = shared.value[1]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "about": []})
        q = _unit(np.frombuffer(b"".join(left["qvec"]), np.float32).reshape(len(left), dim).astype(np.float64)).astype(np.float32)
        code = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), len(books))
        ids, cell, qid = right["id"].to_numpy(), right["cell"].to_numpy(), left["qid"].to_numpy()
        probed = [np.frombuffer(x, np.int32) for x in left["probed"]]
        owner, asked_cell = np.repeat(np.arange(len(left)), [len(x) for x in probed]), np.concatenate(probed)
        outs, held, best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))], 0, 0
        for c in np.unique(cell):
            members, who = np.flatnonzero(cell == c), owner[asked_cell == c]
            about = _decoded(code[members], books).astype(np.float32)
            step = max(1, SCORES // len(members))
            for a in range(0, len(who), step):
                rows = who[a:a + step]
                far = 1 - q[rows] @ about.T
                if exclude_self:
                    far[qid[rows][:, None] == ids[members][None, :]] = 9.0
                kk = min(rerank, len(members))
                at = np.argpartition(far, kk - 1, axis=1)[:, :kk]
                outs.append((np.repeat(rows, kk), members[at.ravel()], np.take_along_axis(far, at, axis=1).ravel()))
                held += at.size
                if held > best + CANDIDATES:  # only the best so far are kept
                    outs = [_best(outs, ids, rerank)]
                    held = best = len(outs[0][0])
        row, member, far = _best(outs, ids, rerank)
        return pd.DataFrame({"query_id": qid[row], "neighbor_id": ids[member], "about": far.astype(np.float64)})

    def literal(values: np.ndarray) -> F.Column:
        return F.array(*[F.lit(int(v)) for v in values])
    routed = (asked.mapInPandas(route, "grp int, qid long, qvec binary, probed binary").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(query_parts)).cast("int")))
    members = (index.codes.withColumn("grp", (F.element_at(literal(index.first_group), F.col("cell") + 1) + F.pmod(F.xxhash64("id"), F.element_at(literal(index.groups_of), F.col("cell") + 1))).cast("int"))
               .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))))
    near = routed.groupBy("grp", "part").cogroup(members.groupBy("grp", "part")).applyInPandas(compare, "query_id long, neighbor_id long, about double")
    order = Window.partitionBy("query_id").orderBy("about", "neighbor_id")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rerank).select("query_id", "neighbor_id")

    def exact(frames):
        for frame in frames:
            if len(frame):
                a, b = _unit(_stack(frame["qvec"], dim)), _unit(_stack(frame["vec"], dim))
                yield pd.DataFrame({"query_id": frame["query_id"], "neighbor_id": frame["neighbor_id"], "distance": np.round(1 - (a * b).sum(axis=1), DIST_DP)})

    both = best.join(index.vectors.select(F.col("id").alias("neighbor_id"), "vec"), "neighbor_id").join(asked.select(F.col("qid").alias("query_id"), "qvec"), "query_id")
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out, _ = write_table(both.mapInPandas(exact, "query_id long, neighbor_id long, distance double").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_k))
    if asked_path:
        drop_table(spark, asked_path)
    return out.select("query_id", "rank", "neighbor_id", rnd(F.col("distance"), DIST_DP).alias("distance"))


def approximate_top_k(base: DataFrame, id_col: str, vec_col: str, top_k: int = 6, recall: float = 0.9, exclude_self: bool = False) -> DataFrame:
    """Every row's ``top_k`` by an index of all rows, which is dropped after."""
    index = build_index(base, id_col, vec_col, top_k, recall)
    if index is None:
        return index_search(None, base, id_col, vec_col)
    found = index_search(index, index.vectors, "id", "vec", top_k, exclude_self)
    index.release()
    return found
