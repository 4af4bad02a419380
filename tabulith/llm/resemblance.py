"""Documents whose shingle sets have a Jaccard similarity of at least LEAST: SimHash, banded MinHash and an exact check.

Documents whose SimHash fingerprints (simhash's, of the same shingles) are linked there are
candidates. Those that are similar and further apart are met by MinHash: every document has BANDS
hashes, each of ROWS minima of its shingles' hashes, and those that share one are candidates too; a
pair of similarity s goes unmet with the odds (1 - s**ROWS)**BANDS, 1.5e-5 at 0.8 and 2e-9 at 0.87,
unless SimHash links it. Candidates are first joined to loose groups, without their texts. The texts of
a loose group then meet once, in one place, and any two of them that are looked at are compared
exactly; from one document the group is grown over links, so that a group of near copies costs no
pairs. Documents with one set of shingles are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm import _blobs, _spark, components, simhash
from tabulith.llm._words import mixed, slices

#: Least similarity as a fraction of whole numbers, so that it is met exactly.
LEAST = (4, 5)
BANDS, ROWS = 28, 5
#: Shingles that are hashed at once: they and their products stay in the cache.
CHUNK = 1 << 15

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(text: bytes, n: int) -> np.ndarray:
    """The hashes of a text's shingles as they stand, repeats included."""
    return np.array(simhash._hashes(text, n), np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in their order."""
    return np.unique(hashed(text, n))


def key_of(own: np.ndarray) -> int:
    """A hash of the whole set; 0 for a text without words."""
    return int(mixed(mixed(own, 1).sum(dtype=np.uint64).reshape(1) + np.uint64(len(own)))[0]) if len(own) else 0


def bands(own: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS hashes for each set; none of them empty."""
    out = np.zeros((len(own), BANDS), np.uint64)
    size = np.array([len(x) for x in own])
    ends = np.cumsum(size)
    a = 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        h = np.concatenate(own[a:b])
        at = np.cumsum(size[a:b]) - size[a:b]
        for i in range(BANDS * ROWS):
            least = np.minimum.reduceat((h ^ _XOR[i]) * _ODD[i], at)
            out[a:b, i // ROWS] = mixed(out[a:b, i // ROWS] * np.uint64(31) + least + np.uint64(i + 1))
        a = b
    return out


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, mark, set_key, fp, bands) for rows (doc_id, mark, text). fp: the SimHash fingerprint."""

    def compute(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, at in slices(batch):
                raw = data.tobytes()
                every = [hashed(raw[a:b], n) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                fp = simhash.majority(np.concatenate(every), np.array([len(x) for x in every], np.int64)).view(np.int64)
                own = [np.unique(x) for x in every]
                keys = np.array([key_of(x) for x in own], np.uint64).view(np.int64)
                full = [k for k, x in enumerate(own) if len(x)]
                got: list[bytes | None] = [None] * len(own)
                if full:
                    for k, row in zip(full, bands([own[k] for k in full]), strict=True):
                        got[k] = row.tobytes()
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keys), pa.array(fp), pa.array(got, pa.binary())], names=["doc_id", "mark", "set_key", "fp", "bands"])

    return _spark.arrow_map(docs.select(F.col("doc_id").cast("long"), "mark", "text"), compute, "doc_id long, mark long, set_key long, fp long, bands binary")


def linked(prints: DataFrame) -> DataFrame:
    """(u, v): links between set_keys whose components are those of all pairs that SimHash links.

    The sets of one fingerprint are linked to the smallest of them, which stands for it. Texts without words are one set.
    """
    own = _spark.stored(prints.where("bands is not null").select("fp", "set_key").distinct(), "own")
    homes = _spark.stored(own.groupBy("fp").agg(F.min("set_key").alias("home"), F.count("*").alias("n")), "homes")
    same = own.join(homes.where("n > 1"), "fp").where("set_key <> home").select(F.col("home").alias("u"), F.col("set_key").alias("v"))
    far = simhash.links(homes.select("fp")).select(F.col("u").alias("fp"), "v").join(homes, "fp").select(F.col("home").alias("u"), F.col("v").alias("fp"))
    return same.unionByName(far.join(homes, "fp").select("u", F.col("home").alias("v")))


def candidates(sets: DataFrame) -> DataFrame:
    """(u, v): links between set_keys whose components are those of all pairs that share a band."""
    spark = sets.sparkSession
    n_buckets = _spark.buckets(spark, BANDS * _spark.plan_bytes(sets) / (8 * BANDS), 1_000_000)

    def replicate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_buckets)
        for batch in rows:
            keys = np.repeat(np.asarray(batch.column(0)).view(np.uint64), BANDS)
            band = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            yield from gather.add((mixed(band) % np.uint64(n_buckets)).astype(np.int64), band, keys)
        yield from gather.flush()

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, spool in _blobs.spools(rows):
            band, keys = (np.concatenate(c) for c in zip(*map(_blobs.unpacked, spool), strict=True))
            order = np.lexsort((keys, band))
            band, keys = band[order], keys[order]
            new = np.concatenate(([True], band[1:] != band[:-1]))
            first = keys[np.flatnonzero(new)[np.cumsum(new) - 1]]
            pairs = np.unique(np.stack((first, keys), 1)[first != keys], axis=0).view(np.int64)
            forest = simhash._Forest()
            keep = np.array([forest.add(a, b) for a, b in pairs.tolist()], bool)
            if keep.any():
                yield pa.record_batch([pa.array(pairs[keep, 0]), pa.array(pairs[keep, 1])], names=["u", "v"])

    sent = _blobs.exchanged(_spark.arrow_map(sets.where("bands is not null").select("set_key", "bands"), replicate, _blobs.SCHEMA))
    return _spark.arrow_map(sent, meet, "u long, v long")


def grown(own: list[np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """The group of each set: sets link at a similarity of least and more, and groups are what links reach."""
    up, down = least
    size = np.array([len(x) for x in own])
    order = np.argsort(size, kind="stable")
    size = size[order]
    flat = np.unique(np.concatenate([own[k] for k in order]), return_inverse=True)[1]
    at = np.cumsum(size) - size
    group, there = np.full(len(own), -1), np.zeros(int(flat.max()) + 1, bool)
    rest = np.arange(len(own))  # by size, those that no group has
    while len(rest):
        seed, rest = rest[0], rest[1:]
        group[seed], queue = seed, [seed]
        while queue and len(rest):
            x = queue.pop()
            mine = flat[at[x] : at[x] + size[x]]
            low, high = np.searchsorted(size[rest] * down, size[x] * up), np.searchsorted(size[rest] * up, size[x] * down, "right")
            near = rest[low:high]
            if not len(near):
                continue
            there[mine] = True
            n = size[near]
            start = np.cumsum(n) - n
            both = np.add.reduceat(there[flat[np.repeat(at[near] - start, n) + np.arange(n.sum())]].astype(np.int64), start)
            there[mine] = False
            hit = both * down >= (size[x] + n - both) * up
            if hit.any():
                group[near[hit]] = seed
                queue += near[hit].tolist()
                rest = np.concatenate((rest[:low], near[~hit], rest[high:]))
    out = np.empty(len(own), np.int64)
    out[order] = order[group]
    return out


def groups(texts: DataFrame, n: int) -> DataFrame:
    """(set_key, root) for rows (loose, set_key, text): the groups within each loose group, by one of their keys."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        own: dict[int, np.ndarray] = {}

        def solved() -> Iterator[pa.RecordBatch]:
            keys = np.array(list(own), np.int64)
            if len(keys):
                yield pa.record_batch([pa.array(keys), pa.array(keys[grown(list(own.values()))])], names=["set_key", "root"])

        for batch in rows:
            for loose, set_key, text in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), strict=True):
                if loose != key:
                    yield from solved()
                    key, own = loose, {}
                if set_key not in own:
                    own[set_key] = shingles((text.as_py() or "").encode(), n)
        yield from solved()

    dealt = texts.select("loose", "set_key", "text").repartition("loose").sortWithinPartitions("loose")
    return _spark.arrow_map(dealt, compare, "set_key long, root long")


def kept(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text and more) without near copies: of each group the row with the smallest doc_id stays.

    Rows link at a similarity of LEAST and more of their sets of n-word shingles (simhash's; a shorter
    text is one shingle), and a group is what links reach. Texts without words are copies of each
    other. Rows of one doc_id are rows like others: of those that are near copies one stays. A row
    without doc_id stays.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    known = docs.where("doc_id is not null")
    marked = known.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    prints = _spark.stored(sketches(marked, n), "sketches")
    sets = _spark.stored(prints.groupBy("set_key").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("bands").alias("bands")), "sets")
    loose = components.components(linked(prints).unionByName(candidates(sets))).select(F.col("node").alias("set_key"), F.col("root").alias("loose"))
    met = sets.select("set_key", "least.*").join(loose, "set_key")
    found = _spark.stored(groups(marked.join(met, ["doc_id", "mark"]), n), "groups")
    joined = sets.select("set_key", "least").join(found, "set_key", "left")
    stay = joined.groupBy(F.coalesce("root", "set_key").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_doc"), F.col("least.mark").alias("_mark"))
    rows = known.withColumn("_own", mark).join(stay, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col("_own") == F.col("_mark")))
    return rows.dropDuplicates(["_doc", "_mark"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
