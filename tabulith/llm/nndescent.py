"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

`nearest` indexes all rows in regions that fit a task, each with a graph of its own (`regions`, `descent`).
`build` and `search` make and walk one graph over all tasks, for callers that need the graph itself: each of
their rounds moves every vector to its neighbours.

The graph of `build` has for each vector its K best partners found. It starts from exact partners within the
leaves of random-hyperplane trees, and is improved by joins of neighbours of neighbours: each vector
goes to its neighbours and to those that it is a neighbour of; there all that met, of which one is
new, are compared, and the better ones go back to their vectors. What has not changed is not
compared again. How many meet at a vector is bounded; a link stays new at either end until it was
among those that met there. Rounds end when few vectors find anything better.

A query walks the graph: the best vectors that it has met and not yet opened are opened, what they
point at is compared with it, until the best stay as they are. Compared are 8-bit codes while the
graph is built and the vectors themselves in the search, in doubles.

State is packed in a table of the shared folder, one row for a bucket of vectors, written anew each
round; vectors are dealt to buckets by a hash of their id, so no hub or cluster is one task's work.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm import _blobs, _rows, _spark, regions
from tabulith.llm._words import mixed
from tabulith.llm.descent import lifted as _lifted
from tabulith.llm.voronoi import finite, matrix

K = 32
TREES, LEAF = 4, 256
#: Levels that a stage of a tree adds, rows of a node that its cuts are taken from, rows up to which a node is split where it lies.
LEVELS, NODE_SAMPLE, LOCAL_ROWS = 7, 8192, 65_536
#: Bytes of a stage's cuts up to which they are broadcast; beyond, they are joined.
BROADCAST_BYTES = 16 << 20
#: Vectors asked for in one bucket of the graph in a step, beyond which the asks are dealt to copies of it.
HOT_ASKS = 200_000
#: Reverse neighbours that a vector meets in a round, by a hash of the pair; the graph is approximate anyhow.
REVERSE = 24
#: What a link has before it: to be met where it starts, where it ends. The two flags of a new link, and no flag of an old one.
NEAR, FAR = 1, 2
#: Rounds end when less than this share of neighbours changed, however many they are: scores only rise.
SETTLED = 0.005
#: Vectors that a query keeps and those that it opens in a step.
BEAM, OPENED = 224, 32
#: Vectors to a bucket. Blobs go from every task to every bucket, so there are no more buckets than these fill.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 512, 8, 65_536


def _save(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _load(blob: pa.Scalar | bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob))


def _codes(x: np.ndarray) -> np.ndarray:
    """Directions as 8-bit numbers on a common scale."""
    return np.clip(np.rint(x * 127), -127, 127).astype(np.int8)


def _best(owner: np.ndarray, node: np.ndarray, score: np.ndarray, k: int, tag: np.ndarray) -> np.ndarray:
    """Places of the k best distinct nodes of each owner; of equal pairs the one with the smallest tag."""
    order = np.lexsort((tag, node, owner))
    o, n = owner[order], node[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (n[1:] != n[:-1])
    order = order[new]
    order = order[np.lexsort((node[order], -score[order], owner[order]))]
    o = owner[order]
    start = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1]))) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    return order[rank < k]


def _wide(x: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of 64-bit numbers."""
    pad = -x.shape[1] % 8
    x = np.ascontiguousarray(np.pad(x, ((0, 0), (0, pad))))
    return list(x.view(np.uint64).T)


def _narrow(columns: list[np.ndarray], dim: int) -> np.ndarray:
    return np.ascontiguousarray(np.stack(columns, 1)).view(np.int8)[:, :dim]


def _floats(x: np.ndarray) -> list[np.ndarray]:
    return list(np.ascontiguousarray(x.astype(np.float64)).view(np.uint64).T)


def _gathered(table: pa.Table) -> list[list[np.ndarray]]:
    return [_blobs.unpacked(b.as_buffer()) for b in table.column("blob")]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _deal(ids: np.ndarray, n: int) -> np.ndarray:
    return _rows.deal(ids.astype(np.int64), n)


def _rows_of(bucket: int, blob: bytes) -> pa.Table:
    return pa.table([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], schema=_blobs.ARROW)


def _out(gather: _blobs.Gather, out: list) -> pa.Table:
    return pa.Table.from_batches([*out, *gather.flush()], schema=_blobs.ARROW)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as they are if they are of floats, else as doubles."""
    rows = vectors.where(finite("embedding") & F.col("vec_id").isNotNull())
    v = F.col("embedding") if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _cuts(x: np.ndarray, planes: np.ndarray) -> list[np.ndarray]:
    """By level the medians, in each node, of the sides of a plane; 0 where a node has no row."""
    cuts: list[np.ndarray] = []
    leaf = np.zeros(len(x), np.int64)
    for d, plane in enumerate(planes):
        side = x @ plane
        order = np.lexsort((side, leaf))
        edge = np.searchsorted(leaf[order], np.arange((1 << d) + 1))
        size = np.diff(edge)
        middle = np.zeros(1 << d)
        full = size > 0
        low, high = edge[:-1][full] + (size[full] - 1) // 2, edge[:-1][full] + size[full] // 2
        middle[full] = (side[order][low] + side[order][high]) / 2
        cuts.append(middle)
        leaf = 2 * leaf + (side > middle[leaf])
    return cuts


def _below(x: np.ndarray, planes: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The node of each row below one that has these cuts."""
    leaf = np.zeros(len(x), np.int64)
    for plane, middle in zip(planes, cuts, strict=True):
        leaf = 2 * leaf + (x @ plane > middle[leaf])
    return leaf


def _leaves(rows: DataFrame, dim: int, n: int, tree: int, most: float) -> DataFrame:
    """(bucket, vec_id, v): the node of each vector in a tree of random hyperplanes, small enough to be split where it lies.

    A stage cuts every node by LEVELS planes, at the medians of NODE_SAMPLE of its rows. The first takes
    its sample to the driver, later ones take theirs node by node in Spark, so that what the driver holds
    does not grow with the rows.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    rng = np.random.default_rng(1000 + tree)
    levels = min(depth, LEVELS)
    planes = rng.normal(size=(levels, dim + 1))
    sample = rows.select("vec_id", "v").where(F.pmod(F.xxhash64("vec_id", F.lit(tree)), F.lit(max(1, n // NODE_SAMPLE))) == 0).select("v").toPandas()["v"]
    first = _cuts(_lifted(np.array(sample.tolist(), np.float64).reshape(-1, dim), most), planes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = _below(_lifted(matrix(batch.column("v"), dim), most), planes, first)
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), batch.column("vec_id"), batch.column("v")], names=["bucket", "vec_id", "v"])

    out, nodes, stage = _spark.arrow_map(rows.select("vec_id", "v"), place, "bucket int, vec_id long, v array<double>"), 1 << levels, 0
    while n / nodes > LOCAL_ROWS:
        stage += 1
        levels = min(LEVELS, int(np.ceil(np.log2(n / nodes / LEAF))))
        out = _refined(_spark.stored(out, "nodes"), dim, nodes, rng.normal(size=(levels, dim + 1)), most, stage)
        nodes <<= levels
    return out


def _refined(out: DataFrame, dim: int, nodes: int, planes: np.ndarray, most: float, stage: int) -> DataFrame:
    """Nodes cut by some more planes, each at the medians of a sample of its own."""
    by_luck = Window.partitionBy("bucket").orderBy(F.xxhash64("vec_id", F.lit(stage)), "vec_id")
    some = out.withColumn("r", F.row_number().over(by_luck)).where(F.col("r") <= NODE_SAMPLE).select("bucket", "v")

    def cut(node: pa.Table) -> pa.Table:
        x = _lifted(matrix(node.column("v").combine_chunks(), dim), most)
        blob = np.concatenate(_cuts(x, planes)).tobytes()
        return pa.table([node.column("bucket").combine_chunks().slice(0, 1), pa.array([blob], pa.binary())], names=["bucket", "cuts"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            x, leaf = _lifted(matrix(batch.column("v"), dim), most), np.zeros(batch.num_rows, np.int64)
            for b in np.unique(bucket):
                own = np.flatnonzero(bucket == b)
                flat = np.frombuffer(batch.column("cuts")[int(own[0])].as_py(), np.float64)
                leaf[own] = _below(x[own], planes, [flat[(1 << d) - 1 : (2 << d) - 1] for d in range(len(planes))])
            yield pa.record_batch([pa.array(((bucket.astype(np.int64) << len(planes)) + leaf).astype(np.int32)), batch.column("vec_id"), batch.column("v")], names=["bucket", "vec_id", "v"])

    cuts = some.groupBy("bucket").applyInArrow(cut, _blobs.SCHEMA.replace("blob", "cuts"))
    small = nodes * ((1 << len(planes)) - 1) * 8 <= BROADCAST_BYTES
    return _spark.arrow_map(out.join(F.broadcast(cuts) if small else cuts, "bucket"), place, "bucket int, vec_id long, v array<double>")


def _halves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Places of rows in leaves of at most LEAF, by halving along random planes; equal rows are halved as well."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            yield own
            continue
        side = x[own] @ rng.normal(size=x.shape[1])
        order = own[np.argsort(side, kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]


def _partners(leaves: DataFrame, dim: int, n_buckets: int, k: int, most: float) -> DataFrame:
    """Exact partners within each leaf, sent to the buckets of their vectors; a node too large to be held is split in parts."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets)

        def solve(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            for leaf in _halves(x, np.random.default_rng(len(ids))):
                own, y = ids[leaf], x[leaf]
                s = (y @ y.T).astype(np.float32)
                np.fill_diagonal(s, -np.inf)
                m = min(k, len(own) - 1)
                if m > 0:
                    at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    rows = np.repeat(np.arange(len(own)), m)
                    yield from gather.add(_deal(own[rows], n_buckets), own[rows].view(np.uint64), own[at.ravel()].view(np.uint64), s[rows, at.ravel()].view(np.uint32))

        held: list[pa.RecordBatch] = []
        key, size = None, 0
        for batch in batches:
            leaf = np.asarray(batch.column("bucket"))
            edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and (leaf[a] != key or size >= 2 * LOCAL_ROWS):
                    yield from solve(*_unit(held, dim, most))
                    held, size = [], 0
                key, size = leaf[a], size + b - a
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(*_unit(held, dim, most))
        yield from gather.flush()

    return _spark.arrow_map(leaves.repartition("bucket").sortWithinPartitions("bucket"), meet, _blobs.SCHEMA)


def _unit(batches: list[pa.RecordBatch], dim: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    v = matrix(table.column("v").combine_chunks(), dim)
    return np.asarray(table.column("vec_id")), _lifted(v, most)


def build(rows: DataFrame, dim: int, n: int, most: float, k: int = K) -> tuple[DataFrame, int]:
    """The graph of n rows (vec_id, v) of one length and norms up to most, as packed buckets, and their number.

    A bucket: ids, vectors, neighbours (ids, scores, flags of what is new) as arrays of k columns; missing
    neighbours score -inf.
    """
    n_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_ROWS))
    found = None
    for tree in range(TREES):
        more = _partners(_leaves(rows, dim, n, tree, most), dim, n_buckets, k, most)
        found = more if found is None else found.unionByName(more)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets)
        for batch in batches:
            ids, v = np.asarray(batch.column("vec_id")), matrix(batch.column("v"), dim)
            yield from gather.add(_deal(ids, n_buckets), ids.view(np.uint64), *_floats(v))
        yield from gather.flush()

    def start(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _blobs.ARROW.empty_table()
        ids, *v = _joined(_gathered(left))
        order = np.argsort(ids.view(np.int64))
        ids, v = ids.view(np.int64)[order], np.stack(v, 1).view(np.float64).reshape(len(order), dim)[order]
        state = [ids, v, np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf, np.float32), np.zeros((len(ids), k), np.uint8)]
        return _rows_of(left.column("bucket")[0].as_py(), _save(_merged(state, right, k)[0]))

    owned = _spark.arrow_map(rows.select("vec_id", "v"), own, _blobs.SCHEMA)
    state = _spark.stored(owned.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(start, _blobs.SCHEMA), "graph")
    changed, turn = n * k, 0
    while changed and changed >= SETTLED * n * k:
        state, changed = _round(state, dim, n_buckets, k, most, turn)
        turn += 1
    return state, n_buckets


def _cleared(ids: np.ndarray, node: np.ndarray, new: np.ndarray, owner: np.ndarray, other: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """The flags without those of the links (owner, other) that were met."""
    new = new.copy()
    for kind in (NEAR, FAR):
        at = np.searchsorted(ids, owner[flag == kind])
        r, c = np.nonzero(node[at] == other[flag == kind][:, None])
        new[at[r], c] &= ~np.uint8(kind)
    return new


def _merged(state: list[np.ndarray], updates: pa.Table, k: int) -> tuple[list[np.ndarray], int]:
    """The state with the better of its neighbours and the updates, and the number of new ones.

    Updates: (owner, node, score), of a round also flag: 0, or which flag of the link is done with.
    """
    ids, v, node, score, new = state
    parts = _gathered(updates)
    if not parts:
        return state, 0
    owner, other, s, *flag = _joined(parts)
    if flag:
        met = flag[0] > 0
        new = _cleared(ids, node, new, owner[met].view(np.int64), other[met].view(np.int64), flag[0][met])
        owner, other, s = owner[~met], other[~met], s[~met]
    at = np.searchsorted(ids, owner.view(np.int64))
    have = score.ravel() > -np.inf
    owners = np.concatenate((np.repeat(np.arange(len(ids)), k)[have], at))
    nodes = np.concatenate((node.ravel()[have], other.view(np.int64)))
    scores = np.concatenate((score.ravel()[have], s.view(np.float32)))
    tags = np.concatenate((np.zeros(have.sum(), np.int8), np.ones(len(at), np.int8)))
    fresh = np.concatenate((new.ravel()[have], np.full(len(at), NEAR | FAR, np.uint8)))
    keep = _best(owners, nodes, scores, k, tags)
    o = owners[keep]
    first = np.searchsorted(o, np.arange(len(ids)))
    column = np.arange(len(o)) - first[o]
    node, score, new = np.full_like(node, -1), np.full_like(score, -np.inf), np.zeros_like(new)
    node[o, column], score[o, column], new[o, column] = nodes[keep], scores[keep], fresh[keep]
    return [ids, v, node, score, new], int(tags[keep].sum())


def _round(state: DataFrame, dim: int, n_buckets: int, k: int, most: float, turn: int = 0) -> tuple[DataFrame, int]:
    """One join of neighbours of neighbours."""

    def few(columns: list[np.ndarray]) -> np.ndarray:
        """Of (vector, other, .., new) the bounded number for each vector, new ones first: a hub gets no more from a task."""
        at, other, fresh = columns[0], columns[1], columns[-1 if len(columns) == 3 else 3]
        return _best(at.view(np.int64), other.view(np.int64), luck(at, other) + (fresh > 0) * 2.0**64, REVERSE + k, (NEAR | FAR) - fresh.astype(np.int8))

    def luck(at: np.ndarray, other: np.ndarray) -> np.ndarray:
        return mixed(at * np.uint64(31) + other + mixed(np.array([turn], np.uint64))).astype(np.float64)

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets, thin=few)
        for batch in batches:
            for blob in batch.column("blob"):
                ids, _, node, score, new = _load(blob)
                r, c = np.nonzero(score > -np.inf)
                yield from gather.add(_deal(node[r, c], n_buckets), node[r, c].view(np.uint64), ids[r].view(np.uint64), new[r, c] & NEAR)
        yield from gather.flush()

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each vector to its neighbours and to a bounded number of those that it is a neighbour of."""
        gather, out = _blobs.Gather(n_buckets, thin=few), []
        if left.num_rows:
            ids, v, node, score, new = _load(left.column("blob")[0])
            r, c = np.nonzero(score > -np.inf)
            me, to, fresh = r, node[r, c], new[r, c] & FAR
            parts = _gathered(right)
            if parts:
                mine, other, flag = _joined(parts)
                at = np.searchsorted(ids, mine.view(np.int64))
                keep = _best(at, other.view(np.int64), luck(mine, other) + (flag > 0) * 2.0**64, REVERSE, np.zeros(len(at), np.int8))
                me, to, fresh = np.concatenate((me, at[keep])), np.concatenate((to, other.view(np.int64)[keep])), np.concatenate((fresh, flag[keep]))
            code, worst = _wide(_codes(_lifted(v, most))), score.min(1)
            for a in range(0, len(me), 1 << 18):
                m, t = me[a : a + (1 << 18)], to[a : a + (1 << 18)]
                out += gather.add(_deal(t, n_buckets), t.view(np.uint64), ids[m].view(np.uint64), worst[m].view(np.uint32), fresh[a : a + (1 << 18)], *[x[m] for x in code])
        return _out(gather, out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets)
        for _, spool in _blobs.spools(batches):
            at, who, worst, fresh, *code = _joined([_blobs.unpacked(b) for b in spool])
            order = few([at, who, worst, fresh])
            at, who, worst, fresh, code = at[order], who[order], worst[order], fresh[order], [c[order] for c in code]
            order = np.lexsort((who, at))
            at, who, worst, flag = at[order], who[order], worst[order].view(np.float32), fresh[order]
            x, fresh = _narrow([c[order] for c in code], dim + 1), flag > 0
            for kind, owner, node in ((NEAR, at, who), (FAR, who, at)):  # which links met here
                own, to = owner[flag == kind], node[flag == kind]
                yield from gather.add(_deal(own.view(np.int64), n_buckets), own, to, np.zeros(len(own), np.uint32), np.full(len(own), kind, np.uint8))
            edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            us, vs, ss = [], [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                f = fresh[a:b]
                if b - a < 2 or not f.any():
                    continue
                y = x[a:b].astype(np.float32)
                s = (y @ y.T) * np.float32(1 / 127**2)
                good = (s > worst[a:b, None]) & (f[:, None] | f[None, :])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                us.append(who[a:b][i])
                vs.append(who[a:b][j])
                ss.append(s[i, j])
            if us:
                u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss)
                keep = _best(u.view(np.int64), v.view(np.int64), s, k, np.zeros(len(u), np.int8))
                yield from gather.add(_deal(u[keep].view(np.int64), n_buckets), u[keep], v[keep], s[keep].view(np.uint32), np.zeros(len(keep), np.uint8))
        yield from gather.flush()

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.int64())], names=["bucket", "blob", "changed"])
        got, changed = _merged(_load(left.column("blob")[0]), right, k)
        return _rows_of(left.column("bucket")[0].as_py(), _save(got)).append_column("changed", pa.array([changed], pa.int64()))

    reverse = _spark.arrow_map(state.select("bucket", "blob"), point, _blobs.SCHEMA)
    sent = state.select("bucket", "blob").groupBy("bucket").cogroup(reverse.groupBy("bucket")).applyInArrow(send, _blobs.SCHEMA)
    better = _spark.arrow_map(_blobs.exchanged(sent), compare, _blobs.SCHEMA)
    merged = state.select("bucket", "blob").groupBy("bucket").cogroup(better.groupBy("bucket")).applyInArrow(merge, _blobs.SCHEMA + ", changed long")
    now = _spark.stored(merged, "graph")
    _spark.dropped(state)
    _spark.free_shuffles(state.sparkSession)
    return now, now.agg(F.coalesce(F.sum("changed"), F.lit(0))).first()[0]


def _entry(query: int, q: np.ndarray, want: np.ndarray) -> dict:
    return {"query": query, "q": q, "want": want, "seen": want, "node": np.zeros(0, np.int64), "score": np.zeros(0), "links": None, "opened": np.zeros(0, bool)}


def _stepped(x: dict, node: np.ndarray, score: np.ndarray, links: np.ndarray, beam: int, opened: int) -> None:
    """The beam with the vectors that came back; want: what the best unopened ones point at and was not met.

    Where these lead to nothing new the next ones are opened; want is empty only if all of the beam are open.
    """
    node, score = np.concatenate((x["node"], node)), np.concatenate((x["score"], score))
    links = links if x["links"] is None else np.concatenate((x["links"], links))
    done = np.concatenate((x["opened"], np.zeros(len(node) - len(x["node"]), bool)))
    top = np.lexsort((node, -score))[:beam]
    node, score, links, done = node[top], score[top], links[top], done[top]
    new = np.zeros(0, np.int64)
    while not len(new) and not done.all():
        now = np.flatnonzero(~done)[:opened]
        want = np.unique(links[now])
        new = np.setdiff1d(want[want >= 0], x["seen"], assume_unique=True)
        done[now] = True
    x |= {"node": node, "score": score, "links": links, "opened": done, "want": new, "seen": np.union1d(x["seen"], new)}


def search(state: DataFrame, dim: int, n_buckets: int, asked: DataFrame, k: int, beam: int = BEAM, opened: int = OPENED) -> DataFrame:
    """(query_id, rank, vec_id, score) for asked (query_id, q, entry array<long>): the k nearest found from the entries on.

    A walk ends when all of its beam are open. The vector of a query's own id is not returned but may be its entry.
    Ties go to the smaller vec_id.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            q, ids = matrix(batch.column("q"), dim), np.asarray(batch.column("query_id"))
            for b, i, x, entry in zip(_deal(ids, n_buckets).tolist(), ids.tolist(), q, batch.column("entry").to_pylist(), strict=True):
                parts.setdefault(b, []).append(_entry(i, x, np.unique(np.array(entry, np.int64))))
        yield from _blobs.batches((b, _save(x)) for b, x in parts.items())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the buckets of the vectors that they want to meet, with the score that these must reach."""
        for batch in batches:
            for blob in batch.column("blob"):
                parts: dict[int, list] = {}
                for x in _load(blob):
                    least = x["score"][-1] if len(x["score"]) >= beam else -np.inf
                    to = _deal(x["want"], n_buckets)
                    order = np.argsort(to, kind="stable")
                    edges = [0, *(np.flatnonzero(np.diff(to[order])) + 1).tolist(), len(to)] if len(to) else []
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        parts.setdefault(int(to[order[a]]), []).append((x["query"], x["q"], least, x["want"][order[a:b]]))
                if parts:
                    yield pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([_save(y) for y in parts.values()], pa.binary()), pa.array([sum(len(z[3]) for z in y) for y in parts.values()], pa.int64())], names=["bucket", "blob", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores and neighbours of the vectors asked for: the graph's bucket comes first, then the asks one after the other."""
        at_hand: tuple[int, list] = (-1, [])
        for batch in batches:
            for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 0:
                    at_hand = bucket, _load(blob)
                    continue
                if at_hand[0] != bucket:
                    continue  # no vector is there
                ids, v, node, _, _ = at_hand[1]
                parts: dict[int, list] = {}
                for query, q, least, want in _load(blob):
                    at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                    at = at[ids[at] == want]
                    s = v[at] @ q
                    ok = s >= least
                    if ok.any():
                        parts.setdefault(int(_deal(np.array([query]), n_buckets)[0]), []).append((query, ids[at[ok]], s[ok], node[at[ok]]))
                yield from _blobs.batches((b, _save(x)) for b, x in parts.items())

    def answered(wanted: DataFrame) -> DataFrame:
        """A bucket that many ask of is copied, and the asks are dealt to the copies: no hub is one task's work."""
        copies = F.ceil(F.col("n") / HOT_ASKS).cast("int").alias("copies")
        hot = wanted.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_ASKS).select("bucket", copies)  # one for each HOT_ASKS at most
        asks = wanted.join(F.broadcast(hot), "bucket", "left").select("bucket", F.pmod(F.xxhash64("blob"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"), F.lit(1).alias("kind"), "blob")
        there = graph.join(F.broadcast(hot), "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), F.lit(0).alias("kind"), "blob")
        both = there.unionByName(asks).repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "kind")
        return _spark.arrow_map(both.select("bucket", "kind", "blob"), answer, _blobs.SCHEMA)

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, blobs, open_ = [], [], []
        back: dict[int, list] = {}
        for blob in right.column("blob"):
            for query, *got in _load(blob):
                back.setdefault(query, []).append(got)
        for bucket, blob in zip(left.column("bucket").to_pylist(), left.column("blob"), strict=True):
            own = _load(blob)
            for x in own:
                got = back.get(x["query"])
                if got:
                    _stepped(x, *(np.concatenate(c) for c in zip(*got, strict=True)), beam, opened)
                elif x["links"] is not None:  # none that it asked for is good enough
                    _stepped(x, x["node"][:0], x["score"][:0], x["links"][:0], beam, opened)
                else:
                    x["want"] = np.zeros(0, np.int64)
            rows.append(bucket)
            blobs.append(_save(own))
            open_.append(sum(len(x["want"]) for x in own))
        return pa.table([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary()), pa.array(open_, pa.int64())], names=["bucket", "blob", "open"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                rows = []
                for x in _load(blob):
                    keep = x["node"] != x["query"]
                    found = zip(x["node"][keep][:k].tolist(), x["score"][keep][:k].tolist(), strict=True)
                    rows += [(x["query"], r, i, s) for r, (i, s) in enumerate(found, 1)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    now = _spark.stored(_spark.arrow_map(asked.select("query_id", "q", "entry"), begin, _blobs.SCHEMA), "beams")
    graph = state.select("bucket", "blob")
    while True:
        asks, last = _spark.stored(_spark.arrow_map(now.select("bucket", "blob"), ask, _blobs.SCHEMA + ", n long"), "asks"), now
        back = answered(asks)
        now = _spark.stored(now.select("bucket", "blob").groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(step, _blobs.SCHEMA + ", open long"), "beams")
        _spark.dropped(asks)
        _spark.dropped(last)
        if not now.agg(F.sum("open")).first()[0]:
            break
    return _spark.arrow_map(now.select("bucket", "blob"), finish, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query, in doubles.

    vectors: vec_id, embedding; is_query: a condition on vec_id. All rows are indexed, in graphs of regions
    (`regions`); candidates are all but those of the query's own id. Vectors that are null, empty, zero, or hold
    null or non-finite components, or have no id take no part; vectors of each length have an index of their
    own. vec_id is taken as a key: of rows with one id the smallest vector is indexed. An empty table gives an
    empty result. Equal vectors are one entry of the index: none of their ties is lost, and these go to the smaller vec_id.
    """
    rows = _spark.stored(clean(vectors), "vectors").withColumn("h", F.xxhash64("v"))
    by_vector = Window.partitionBy("h", "v").orderBy("vec_id")  # a query's own id and k more: none behind can be asked for
    few = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    index = _spark.stored(few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "index").withColumn("dim", F.size("v"))
    asked = rows.where(is_query)
    asks = _spark.stored(asked.groupBy("h", "v").agg(F.min("vec_id").alias("rep")), "asks")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    out = None
    for dim, n, least, most in sorted(map(tuple, index.groupBy("dim").agg(F.count("*"), F.min(norm), F.max(norm)).collect())):
        space = regions.Space(dim, most, least >= most * (1 - 1e-6), k)
        found = regions.found(index.where(F.col("dim") == dim), asks.where(F.size("v") == dim), space, n)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = asked.join(asks, ["h", "v"]).select(F.col("vec_id").alias("query_id"), "rep").join(out, "rep")
    others = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")), 1, k)
    own = own.select("query_id", F.posexplode(others).alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
