"""Exact top-k inner products by a Voronoi kNN join.

Pivots, a bounded sample, split the rows into Voronoi cells. A cell's summary is the count of its
rows, their largest distance and angle from the pivot and their largest norm. Queries are first
solved in the cell that they lie in; that and the summaries' lower bounds give each a score that its
k-th best reaches (a candidate counts once in it, however often its row is repeated). A query then goes to just those other cells whose summary lets a row reach that
score; it is the queries that are replicated, being the fewer. Cells are cut into units of bounded
size, so that a cell of a third of all rows is many tasks' work, and a unit is solved by one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm import _spark

SCALE, K = 256, 5
#: Pivots to the square root of the rows (so that what is sent to every task, and the work of dealing rows to cells, grow
#: much slower than the rows), rows to a unit.
PIVOTS, UNIT_ROWS = 1.0, 8192
#: Whole numbers from here on are not exact in doubles; vectors that hold one take no part.
EXACT = float(1 << 53)


def finite(column: str) -> F.Column:
    """Whether a vector is there, not empty, and holds finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>, dim): whole numbers floor(scale * x) of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    out = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: F.abs(x) >= EXACT))
    return out.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angles between the rows of x and of p; zero vectors have angle 0 with all (their products are 0)."""
    nx, np_ = np.linalg.norm(x, axis=1), np.linalg.norm(p, axis=1)
    scale = nx[:, None] * np_[None, :]
    return np.where(scale > 0, np.arccos(np.clip((x @ p.T) / np.where(scale > 0, scale, 1), -1, 1)), 0.0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole numbers in doubles."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= EXACT:
        return np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q], object)
    return q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
    """The k best of at least a score, ties to the smaller id, without the query itself; an id counts once, with its best score."""
    ok = (ids != own) & (scores >= least)
    scores, ids = scores[ok], ids[ok]
    if len(ids) > 1 and (np.diff(ids) <= 0).any():
        order = np.lexsort((-scores, ids)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (ids[i], -scores[i])))
        order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]
        scores, ids = scores[order], ids[order]
    if len(ids) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    return sorted(((int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]


RESULT = "query_id long, vec_id long, score long"


def _solved(units: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each unit for each query sent to it (query_id, q, least, unit)."""

    def solve(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        out: list[tuple[int, int, int]] = []
        if rows.num_rows and queries.num_rows:
            dim = len(rows.column("v")[0])
            rows = rows.sort_by("vec_id")
            x, ids = matrix(rows.column("v").combine_chunks(), dim), np.asarray(rows.column("vec_id"))
            least = np.asarray(queries.column("least"))
            own = np.asarray(queries.column("query_id"))
            for a in range(0, len(own), 256):
                q = matrix(queries.column("q").combine_chunks().slice(a, 256), dim)
                scores = products(q, x)
                for j in range(len(q)):
                    out += [(int(own[a + j]), i, s) for s, i in best(scores[j], ids, own[a + j], k, least[a + j])]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

    return asked.groupBy("unit").cogroup(units.groupBy("unit")).applyInArrow(lambda a, b: solve(b, a), RESULT)


def _single(found: DataFrame) -> DataFrame:
    """A row for each query and candidate: an id counts once towards the k best."""
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) for each query.

    vectors: vec_id, embedding; is_query: a condition on vec_id. Candidates are all rows but those
    of the query's own id; ties go to the smaller vec_id; fewer than k if there are no more. Vectors
    that are null or empty, hold null or non-finite components or whole numbers of 2**53 and more, or
    have no id take no part; those of another length than the query's are no candidates of it. Equal
    vectors are ties; a table without queries or rows gives an empty result.
    """
    spark = vectors.sparkSession
    _spark.arrow_limits(spark)
    rows = scaled(vectors, scale)
    sizes = {r[0]: r[1:] for r in rows.groupBy("dim").agg(F.count("*"), F.count_distinct("vec_id")).collect()}
    n, shared = {d: x[0] for d, x in sizes.items()}, {d: x[0] - x[1] for d, x in sizes.items()}  # rows, and rows more than ids
    chosen: dict[int, np.ndarray] = {}
    for dim, count in n.items():
        p = max(8, int(PIVOTS * count**0.5))
        got = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(p).select("v").collect()
        chosen[dim] = np.unique(np.array([r[0] for r in got]), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x, p = matrix(part.column("v"), dim), chosen[int(dim)]
                d = np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * (x @ p.T), 0)
                cell = d.argmin(1)
                pick = np.arange(len(x)), cell
                yield pa.record_batch(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[pick])), pa.array(_angles(x, p)[pick]), pa.array(np.linalg.norm(x, axis=1))],
                    names=[*part.schema.names, "cell", "far", "angle", "norm"],
                )

    schema = "vec_id long, v array<double>, dim int, cell int, far double, angle double, norm double"
    placed = _spark.stored(_spark.arrow_map(rows, assign, schema), "cells")
    summary = placed.groupBy("dim", "cell").agg(F.count("*"), F.max("far"), F.max("angle"), F.max("norm")).collect()
    cells = {dim: sorted((c, cnt, far, ang, norm) for d, c, cnt, far, ang, norm in summary if d == dim) for dim in n}
    chunks = {(dim, c): -(-cnt // UNIT_ROWS) for dim in n for c, cnt, *_ in cells[dim]}
    first = dict(zip(chunks, np.concatenate(([0], np.cumsum(list(chunks.values()))))[:-1].tolist() if chunks else [], strict=True))
    shape = spark.createDataFrame([(d, c, first[d, c], m) for (d, c), m in chunks.items()], "dim int, cell int, first int, chunks int")
    placed = placed.join(F.broadcast(shape), ["dim", "cell"])  # a row for each pivot
    units = placed.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "chunks")).cast("int").alias("unit"), "vec_id", "v")
    queries = placed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", "cell", "first", "chunks").dropDuplicates(["query_id", "q"])
    own = queries.select("query_id", "q", F.lit(float("-inf")).alias("least"), F.explode(F.sequence("first", F.col("first") + F.col("chunks") - 1)).alias("unit"))
    near = _spark.stored(_single(_solved(units, own, k)), "near")
    reached = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("least"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                about = np.array(cells[int(dim)], np.float64)
                index, count, far, angle, norm = about.T
                p, q = chosen[int(dim)][index.astype(int)], matrix(part.column("q"), dim)
                nq = np.linalg.norm(q, axis=1)[:, None]
                dot, slack = q @ p.T, 1e-9 * (1 + nq * norm[None, :] + nq * np.linalg.norm(p, axis=1)[None, :])
                low = dot - nq * far[None, :] - slack
                order = np.argsort(-low, axis=1)
                most = k + shared[int(dim)]  # so many rows have k ids at least, and perhaps the query itself
                enough = (np.cumsum(count[order], axis=1) > most).argmax(1)
                floor = np.where(count.sum() > most, low[np.arange(len(q)), order[np.arange(len(q)), enough]], -np.inf)
                least = np.maximum(np.asarray(part.column("least").fill_null(-np.inf)), floor)
                turn = np.cos(np.maximum(_angles(q, p) - angle[None, :] - 1e-7, 0))
                high = np.minimum(dot + nq * far[None, :], np.where(turn > 0, nq * norm[None, :] * turn, 0)) + slack
                need = (high >= least[:, None]) & (index[None, :] != np.asarray(part.column("cell"))[:, None])
                which, of = np.nonzero(need)
                number = np.array([chunks[int(dim), int(c)] for c in index])
                begin = np.array([first[int(dim), int(c)] for c in index])
                times = number[of]
                at = np.repeat(np.arange(len(of)), times)
                unit = begin[of][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(at), 4096):
                    take = pa.array(which[at[a : a + 4096]])
                    yield pa.record_batch([part.column("query_id").take(take), part.column("q").take(take), pa.array(least[which[at[a : a + 4096]]]), pa.array(unit[a : a + 4096].astype(np.int32))], names=["query_id", "q", "least", "unit"])

    asked = queries.join(reached, "query_id", "left").select("query_id", "q", "dim", "cell", "least")
    others = _solved(units, _spark.arrow_map(asked, ask, "query_id long, q array<double>, least double, unit int"), k)
    ranked = _single(near.unionByName(others)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
