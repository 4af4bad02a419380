"""The index of `nndescent.nearest`: regions of near vectors, each with an NN-descent graph of its own that queries walk.

Every vector is in the region of its nearest centre. Queries, being the fewer, are what is replicated: they
walk the graphs of so many of their nearest regions as hold COVER of the true neighbours of some queries,
which are compared with all vectors for that. In each region the beam is widened until the walks of some
of its queries find what an exact comparison finds. So a region's links, its walks and its vectors stay in
one task's memory, and nothing but vectors and results is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm import _blobs, _rows, _spark, descent
from tabulith.llm._words import mixed
from tabulith.llm.voronoi import matrix

#: Rows of a region, and up to which one is not dealt to parts (queries ask all of these); of fewer rows, the rows of a region and the regions.
REGION_ROWS, LARGEST, LEAST_ROWS, FEW = 65_536, 131_072, 8192, 6
#: About how many vectors the centres are fitted on, rounds of that, most centres. All rows are indexed.
FITTED, FIT_ROUNDS, MOST_REGIONS = 16_384, 8, 1024
#: Queries that are compared with all vectors, and the share of their neighbours that the regions asked must hold.
PROBED, COVER = 128, 0.97
#: Queries of a region that walk at one; rows at one past a pass over all vectors; results in a bucket.
ASKED, PASS_ROWS, BUCKET = 4096, 4096, 500_000


def _centres(x: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of lifted vectors, the same for the same rows."""
    rng = np.random.default_rng(count)
    c = x[rng.permutation(len(x))[:count]]
    for _ in range(FIT_ROUNDS):
        near = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-30)[:, None], c)
    return c


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together: products of few rows cost as much as those of many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PASS_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


@dataclass
class Space:
    """Vectors of one length with norms up to most; even: all have that norm."""

    dim: int
    most: float
    even: bool
    k: int

    def lifted(self, v: np.ndarray) -> np.ndarray:
        x = v / self.most if self.even else descent.lifted(v, self.most)
        return x.astype(np.float32)

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Directions whose products with lifted vectors are in the order of the inner products."""
        v = v / np.abs(v).max(1, keepdims=True)
        v = v / np.linalg.norm(v, axis=1)[:, None]
        return (v if self.even else np.column_stack((v, np.zeros(len(v))))).astype(np.float32)


@dataclass
class Regions:
    """Centres, the parts that the region of each is dealt to, the regions that a query asks, the neighbours that one of these has."""

    centres: np.ndarray
    parts: np.ndarray
    asked: int
    deep: int


def fitted(index: DataFrame, asks: DataFrame, space: Space, n: int) -> Regions:
    count = min(MOST_REGIONS, max(-(-n // REGION_ROWS), min(FEW, n // LEAST_ROWS), 1))
    if count == 1:
        width = space.dim + (not space.even)
        return Regions(np.zeros((1, width), np.float32), np.ones(1, np.int64), 1, space.k + 1)
    some = index.where(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(max(1, n // FITTED))) == 0).orderBy("h", "v").select("v").toArrow()
    centres = _centres(space.lifted(matrix(_column(some, "v"), space.dim)), count)
    count = len(centres)
    probes = asks.orderBy(F.xxhash64("h", F.lit(11)), "rep").limit(PROBED).select("h", "v").toArrow()
    h, q = np.asarray(_column(probes, "h")), space.queries(matrix(_column(probes, "v"), space.dim))
    k = space.k

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(count, np.int64)
        top, where = np.full((len(q), k), -np.inf, np.float32), np.full((len(q), k), -1, np.int64)
        for table in _pieces(batches):
            x = space.lifted(matrix(_column(table, "v"), space.dim))
            cell = np.argmax(x @ centres.T, 1)
            rows += np.bincount(cell, minlength=count)
            s = q @ x.T
            s[h[:, None] == np.asarray(_column(table, "h"))[None, :]] = -np.inf
            s, cell = np.concatenate((top, s), 1), np.concatenate((where, np.broadcast_to(cell, s.shape)), 1)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            top, where = np.take_along_axis(s, at, 1), np.take_along_axis(cell, at, 1)
        own, place = np.nonzero(top > -np.inf)
        columns = np.concatenate((np.full(count, -1), own)), np.concatenate((np.arange(count), where[own, place])), np.concatenate((rows, top[own, place]))
        yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.float64), strict=True)], names=["probe", "cell", "x"])

    def merge(group: pa.Table) -> pa.Table:
        probe, cell, x = group.column("probe")[0].as_py(), np.asarray(_column(group, "cell")), np.asarray(_column(group, "x"))
        if probe < 0:  # rows of each region
            cell, x = np.arange(count, dtype=np.int32), np.bincount(cell, x, count)
        at = np.argsort(-x, kind="stable")[: k if probe >= 0 else count]
        return pa.table([pa.array(np.full(len(at), probe, np.int32)), pa.array(cell[at]), pa.array(x[at])], names=["probe", "cell", "x"])

    kind = "probe int, cell int, x double"
    found = _spark.arrow_map(index.select("h", "v"), compare, kind).groupBy("probe").applyInArrow(merge, kind).toArrow()
    probe, cell, x = (np.asarray(_column(found, name)) for name in ("probe", "cell", "x"))
    rows = np.zeros(count, np.int64)
    rows[cell[probe < 0]] = x[probe < 0].astype(np.int64)
    out = Regions(centres, np.where(rows > LARGEST, -(-rows // REGION_ROWS), 1), 1, k + 1)
    probe, cell = probe[probe >= 0], cell[probe >= 0]
    if len(probe):
        near = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
        out.asked = int(np.quantile(near[probe, cell], COVER, method="inverted_cdf")) + 1
        together = np.unique(np.stack((probe, cell)), axis=1, return_counts=True)[1]
        out.deep = min(k, int(np.ceil((together**2).sum() / together.sum()))) + 1  # with the query's own vector
    return out


def _dealt(index: DataFrame, asks: DataFrame, space: Space, regions: Regions) -> DataFrame:
    """(region, kind, h, ids, v): vectors (kind 0), each in one region, then queries (1) in all that they ask, with rep as their id."""
    centres, parts, asked = regions.centres, regions.parts, regions.asked
    first = np.cumsum(parts) - parts

    def dealt(t: pa.Table, row: np.ndarray, region: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        t = t.take(pa.array(row))
        columns = [pa.array(region.astype(np.int32)), pa.array(np.full(len(row), kind, np.int32)), *(_column(t, c) for c in ("h", "ids", "v"))]
        yield from pa.table(columns, names=["region", "kind", "h", "ids", "v"]).to_batches(_spark.ARROW_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            cell = np.argmax(space.lifted(matrix(_column(t, "v"), space.dim)) @ centres.T, 1)
            part = mixed(np.asarray(_column(t, "h")).view(np.uint64)) % parts[cell].astype(np.uint64)
            yield from dealt(t, np.arange(t.num_rows), first[cell] + part.astype(np.int64), 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            s = space.queries(matrix(_column(t, "v"), space.dim)) @ centres.T
            cell = np.argsort(-s, axis=1, kind="stable")[:, :asked]
            row, cell = np.repeat(np.arange(len(cell)), cell.shape[1]), cell.ravel()
            copies = parts[cell]
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            yield from dealt(t, np.repeat(row, copies), np.repeat(first[cell], copies) + part, 1)

    schema = f"region int, kind int, h long, ids array<long>, v {index.schema['v'].dataType.simpleString()}"
    rows = _spark.arrow_map(index.select("h", "ids", "v"), place, schema)
    both = rows.unionByName(_spark.arrow_map(asks.select("h", F.array("rep").alias("ids"), "v"), ask, schema))
    return both.repartitionById(int(parts.sum()), F.col("region")).sortWithinPartitions("region", "kind")


class _Region:
    """The vectors of a region, their graph and the beam that walks of it need."""

    def __init__(self, rows: pa.Table, space: Space, deep: int):
        order = np.argsort(np.asarray(_column(rows, "h")), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        self.space, self.deep, self.beam = space, deep, 0
        self.h = np.asarray(_column(rows, "h"))
        self.v = _column(rows, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, space.dim)
        ids = _column(rows, "ids")
        self.ids, self.edges = np.asarray(ids.flatten()), np.append(0, np.cumsum(np.asarray(ids.value_lengths()))).astype(np.int64)
        self.x = space.lifted(self.v.astype(np.float64))
        self.links = descent.graph(self.x)

    def answers(self, asks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rep, id, score): the k + 1 best ids that each query meets here, in doubles."""
        h, rep, k = np.asarray(_column(asks, "h")), np.asarray(_column(asks, "ids").flatten()), self.space.k + 1
        v = matrix(_column(asks, "v"), self.space.dim)
        q = self.space.queries(v)
        own = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        own[self.h[own] != h] = -1
        if not self.beam:
            self.beam = descent.fitting_beam(self.x, self.links, q, own, self.deep, max(descent.BEAM, 2 * k))
        row, node, score, same = [], [], [], np.diff(self.edges)
        for a in range(0, len(q), 512):
            met = descent.walk(self.x, self.links, q[a : a + 512], own[a : a + 512], self.beam)[:, : 2 * k]
            r, c = np.nonzero(met >= 0)
            to = met[r, c]
            s = np.einsum("ij,ij->i", self.v[to].astype(np.float64), v[a + r])
            n = same[to]  # equal vectors share an entry
            r, s = np.repeat(a + r, n), np.repeat(s, n)
            ids = self.ids[np.repeat(self.edges[to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            order = np.lexsort((ids, -s, r))
            order = order[descent.runs(r[order])[2] < k]
            row.append(r[order])
            node.append(ids[order])
            score.append(s[order])
        return rep[np.concatenate(row)], np.concatenate(node), np.concatenate(score)


def found(index: DataFrame, asks: DataFrame, space: Space, n: int) -> DataFrame:
    """(rep, ids, scores): of each query of asks (rep, h, v) the k + 1 best ids met, its own among them, best first.

    index: (h, v, ids), h a hash of v, ids the k + 1 smallest of the rows with that v.
    """
    regions = fitted(index, asks, space, n)
    k, deep = space.k + 1, regions.deep
    n_buckets = int(min(65_536, max(8, 2 * regions.parts.sum(), n // 20 * regions.asked * k // BUCKET)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets)
        at, rows, asked, size, region = None, [], [], 0, None

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal rows, asked, size, region
            if asked and rows:
                region, rows = _Region(pa.Table.from_batches(rows).combine_chunks(), space, deep), []
            if asked and region:
                rep, node, score = region.answers(pa.Table.from_batches(asked).combine_chunks())
                yield from gather.add(_rows.deal(rep, n_buckets), rep.view(np.uint64), node.view(np.uint64), score.view(np.uint64))
            asked, size = [], 0

        for batch in batches:
            where, kind = np.asarray(batch.column("region")), np.asarray(batch.column("kind"))
            edges = [0, *(np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(where)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and where[a] != at:
                    yield from answered()
                    at, rows, region = where[a], [], None
                if a < b:
                    (asked if kind[a] else rows).append(batch.slice(a, b - a))
                    size += (b - a) * int(kind[a])
                if size >= ASKED:
                    yield from answered()
        yield from answered()
        yield from gather.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, spool in _blobs.spools(batches):
            rep, node, score = (np.concatenate(c) for c in zip(*map(_blobs.unpacked, spool), strict=True))
            rep, node, score = rep.view(np.int64), node.view(np.int64), score.view(np.float64)
            order = np.lexsort((node, -score, rep))
            place = descent.runs(rep[order])[2]
            order, place = order[place < k], place[place < k]
            start = np.flatnonzero(place == 0)
            edges = pa.array(np.append(start, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(c[order])) for c in (node, score)]
            yield from pa.table([pa.array(rep[order][start]), *lists], names=["rep", "ids", "scores"]).to_batches(4096)

    met = _spark.arrow_map(_dealt(index, asks, space, regions), meet, _blobs.SCHEMA)
    return _spark.arrow_map(_blobs.exchanged(met), merge, "rep long, ids array<long>, scores array<double>")
