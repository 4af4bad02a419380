"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint is cut into blocks; of two fingerprints that differ in at most t bits, some block
differs in at most d = t // blocks. In each block the words of a covering code are the anchors: every
value has one within the radius R, its home. A value that differs by d from another is within R + d of
that one's home. So a fingerprint is replicated to all anchors within R + d, and per anchor those at
home there are compared with all that came.

The code of a block is a perfect Hamming code (R = 1), times all words of the block's other bits. Fewer
and wider blocks mean more replicas and far fewer comparisons: with n fingerprints three blocks take
45 replicas and about n / 3,000 comparisons each, two blocks 343 and n / 390,000. Which it is follows
from the number of fingerprints; both find every link. Copies have one fingerprint and are compared
once. Per anchor a spanning forest of the links is kept, not the pairs: its trees have the components
of the full graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm import _blobs, _rows, _spark, components
from tabulith.llm._words import mixed, slices

SHINGLE, SEED, THRESHOLD = 4, 42, 4
RADIUS = 1
#: (lowest bit, bits, bits of the code) of the blocks; the narrow ones up to so many fingerprints.
NARROW = ((0, 21, 15), (21, 21, 15), (42, 22, 15))
WIDE = ((0, 32, 31), (32, 32, 31))
NARROW_ROWS = 2_000_000
#: Anchor groups up to this size are compared by shifts of the sorted entries, larger ones node by node.
SMALL = 64

_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of hashes (counts of them, 0 allowed) the bits that over half have set."""
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    n = counts[has]
    pieces = -(-n // 255)  # sums of at most 255 ones fit a byte
    first = np.cumsum(n) - n
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(first, pieces) + 255 * piece
    of = np.cumsum(pieces) - pieces
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, k]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, of, axis=0)
        for j in range(8):
            out[has] |= (2 * ones[:, j] > n).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def _hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()
    n = len(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - shingle].tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text; zero for a null text or one without words."""

    def compute(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, at in slices(batch):
                raw, got, counts = data.tobytes(), [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    hashes = _hashes(raw[a:b], shingle)
                    counts.append(len(hashes))
                    got += hashes
                fp = majority(np.array(got, np.uint64), np.array(counts, np.int64))
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return _spark.arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), compute, "doc_id long, fp long")


@cache
def _patterns(bits: int, code: int, reach: int) -> list[np.ndarray]:
    """By syndrome: the error patterns of at most reach bits that lead from a value to a word of the code."""
    found: list[list[int]] = [[] for _ in range(code + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(bits), weight):
            syndrome = 0
            for i in places:
                syndrome ^= i + 1 if i < code else 0
            found[syndrome].append(sum(1 << i for i in places))
    return [np.array(x, np.uint64) for x in found]


def _syndromes(values: np.ndarray, code: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint8)
    for i in range(code):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.uint8) * np.uint8(i + 1)
    return out


def replicas(blocks: tuple, threshold: int) -> float:
    """How many anchors a fingerprint goes to, on the average."""
    return sum(sum(map(len, _patterns(bits, code, RADIUS + threshold // len(blocks)))) / (code + 1) for _, bits, code in blocks)


def _values(fps: np.ndarray, low: int, bits: int) -> np.ndarray:
    return (fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def anchors(fps: np.ndarray, threshold: int, blocks: tuple = NARROW, rows: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, fingerprints): every anchor that each fingerprint has to go to."""
    reach = RADIUS + threshold // len(blocks)
    for at in range(0, len(fps), rows):
        some = fps[at : at + rows]
        for block, (low, bits, code) in enumerate(blocks):
            values = _values(some, low, bits)
            syndromes = _syndromes(values, code)
            for s, patterns in enumerate(_patterns(bits, code, reach)):
                of = np.flatnonzero(syndromes == s)
                if len(of) and len(patterns):
                    yield ((values[of, None] ^ patterns[None, :]) | np.uint64(block << 32)).ravel(), np.repeat(some[of], len(patterns))


def at_home(anchor: np.ndarray, fps: np.ndarray, blocks: tuple) -> np.ndarray:
    """Whether each fingerprint's home is the anchor that it came to: the code's word within RADIUS, the other bits equal."""
    out = np.zeros(len(fps), bool)
    block = anchor >> np.uint64(32)
    for k, (low, bits, code) in enumerate(blocks):
        own = block == k
        away = _values(fps[own], low, bits) ^ (anchor[own] & np.uint64((1 << 32) - 1))
        out[own] = (np.bitwise_count(away) <= RADIUS) & (away >> np.uint64(code) == 0)
    return out


class _Forest:
    """Union-find over fingerprints; add() is true where an edge joins two trees."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


def _grown(fps: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a forest of one large group that joins what links at home have.

    From each fingerprint at home that was not reached, all are reached in turn, each held against those
    not yet reached: what is reached is done with, so that a dense group costs no pairs.
    """
    rest = fps
    open_ = fps[home]
    for seed in open_:
        at = np.searchsorted(rest, seed)
        if at >= len(rest) or rest[at] != seed:
            continue
        queue, rest = [seed], np.delete(rest, at)
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                got = rest[near]
                yield np.full(len(got), x), got
                queue += list(got)
                rest = rest[~near]


def _linked(anchor: np.ndarray, fps: np.ndarray, threshold: int, blocks: tuple = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """Links within each anchor's group, reduced to a forest."""
    order = np.lexsort((fps, anchor))
    anchor, fps = anchor[order], fps[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (fps[1:] != fps[:-1])
    anchor, fps = anchor[new], fps[new]
    home = at_home(anchor, fps, blocks)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.append(first, len(anchor)))
    size = np.where(np.add.reduceat(home.astype(np.int64), first) > 0, size, 0)  # where nobody is at home nothing is compared
    us, vs = [], []
    for a, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        for u, v in _grown(fps[a : a + n], home[a : a + n], threshold):
            us.append(u)
            vs.append(v)
    small = np.repeat((size > 1) & (size <= SMALL), np.diff(np.append(first, len(anchor))))
    anchor, fps, home = anchor[small], fps[small], home[small]
    for d in range(1, int(size[size <= SMALL].max(initial=1))):
        at = np.flatnonzero((anchor[d:] == anchor[:-d]) & (home[d:] | home[:-d]))
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= threshold]
        us.append(fps[at])
        vs.append(fps[at + d])
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]).view(np.int64), axis=1)
    forest = _Forest()
    keep = [forest.add(a, b) for a, b in zip(*pairs.tolist(), strict=True)]
    return pairs[0][keep], pairs[1][keep]


def links(fps: DataFrame, threshold: int = THRESHOLD, blocks: tuple | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) whose components are those of all links."""
    spark = fps.sparkSession
    n = fps.count()
    blocks = blocks or (NARROW if n <= NARROW_ROWS else WIDE)
    n_buckets = _spark.buckets(spark, replicas(blocks, threshold) * n, 1_000_000)

    def replicate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets)
        for batch in rows:
            values = np.asarray(batch.column(0).drop_null()).view(np.uint64)
            for anchor, fp in anchors(values, threshold, blocks):
                yield from gather.add((mixed(anchor) % np.uint64(n_buckets)).astype(np.int64), anchor, fp)
        yield from gather.flush()

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, spool in _blobs.spools(rows):
            got = [_blobs.unpacked(blob) for blob in spool]
            u, v = _linked(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), threshold, blocks)
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    sent = _blobs.exchanged(_spark.arrow_map(fps.select("fp"), replicate, _blobs.SCHEMA))
    return _spark.arrow_map(sent, compare, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    fp: see fingerprints. Fingerprints link at threshold or fewer differing bits; component_id is
    the smallest doc_id that a document reaches over links, itself included. Null and wordless texts
    have fingerprint zero and link like others. Rows with a null doc_id keep their fingerprint and
    take the component's smallest id that is not null. Repeated rows stay.
    """
    prints = _spark.stored(fingerprints(docs, shingle), "fingerprints")
    distinct = _spark.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components.components(links(distinct.select("fp"), threshold))
    tops = distinct.join(joined.withColumnRenamed("node", "fp"), "fp")
    roots = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = _spark.stored(tops.join(roots, "root").select("fp", "component_id"), "moved")
    classes = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
