"""Hash exchanges of packed entries.

A task gathers numpy columns, splits them by bucket and emits a compressed blob for each bucket;
a reader gets the blobs of one bucket after the other from a partition sorted by bucket. An entry
costs a few bytes where a row of Spark's shuffle costs about thirty.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "bucket int, blob binary"
ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
#: Entries that a task gathers before it emits them.
FLUSH = 3_000_000


def packed(columns: list[np.ndarray]) -> bytes:
    """Unsigned integer columns as byte planes, compressed: planes of zeros cost nothing."""
    n = len(columns[0])
    head = struct.pack("<IB", n, len(columns)) + bytes(c.itemsize for c in columns)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(n, c.itemsize).T).tobytes() for c in map(np.ascontiguousarray, columns)]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = struct.unpack_from("<IB", raw)
    sizes, at, out = raw[5 : 5 + k], 5 + k, []
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n))
        at += n * size
    return out


def split(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The entries of each bucket that has any, in their order."""
    order = np.argsort(bucket.astype(np.uint16 if n_buckets <= 65_536 else np.int64), kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), [c[at[b] : at[b + 1]] for c in columns]


class Gather:
    """Columns gathered over several slices, emitted by bucket when there are enough."""

    def __init__(self, n_buckets: int, encode: Callable[[list[np.ndarray]], bytes] = packed, thin: Callable[[list[np.ndarray]], np.ndarray] | None = None, most: int = FLUSH):
        """most: entries to be gathered; thin: the places of the entries that are worth sending, of the columns of all gathered ones."""
        self.n_buckets, self.encode, self.thin, self.most = n_buckets, encode, thin, most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.parts.append((bucket, *columns))
            self.size += len(bucket)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            bucket, *columns = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.parts, self.size = [], 0
            if self.thin:
                keep = self.thin(columns)
                bucket, columns = bucket[keep], [c[keep] for c in columns]
            yield from batches((b, self.encode(c)) for b, c in split(bucket, self.n_buckets, columns))


def batches(rows: Iterator[tuple[int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    keys, blobs, size = [], [], 0
    for key, blob in rows:
        keys.append(key)
        blobs.append(blob)
        size += len(blob)
        if size >= limit:
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], schema=ARROW)
            keys, blobs, size = [], [], 0
    if keys:
        yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], schema=ARROW)


def exchanged(df: DataFrame) -> DataFrame:
    """Blobs dealt by bucket, a partition's sorted by it (Spark's sort spills; nothing is grouped in memory)."""
    return df.repartition("bucket").sortWithinPartitions("bucket")


class Spool:
    """One bucket's blobs, to be read several times: in memory, or past a limit in an unlinked scratch file of the task."""

    def __init__(self, limit: int = 32 << 20):
        self.file = tempfile.SpooledTemporaryFile(max_size=limit)
        self.count = 0

    def add(self, blob: bytes) -> None:
        self.file.write(struct.pack("<Q", len(blob)))
        self.file.write(blob)
        self.count += 1

    def __iter__(self) -> Iterator[bytes]:
        self.file.seek(0)
        for _ in range(self.count):
            yield self.file.read(struct.unpack("<Q", self.file.read(8))[0])

    def close(self) -> None:
        self.file.close()


def spools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Spool]]:
    """A spool for each bucket of a partition sorted by bucket."""
    key, spool = None, None
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != key:
                if spool is not None:
                    yield key, spool
                    spool.close()
                key, spool = b, Spool()
            spool.add(blob.as_buffer())
    if spool is not None:
        yield key, spool
        spool.close()


def places_encoded(*heads: int) -> Callable[[list[np.ndarray]], bytes]:
    """Encoder of columns (hash, doc id, place): heads bytes of the hash; ids and places as differences."""
    (size,) = heads

    def encode(columns: list[np.ndarray]) -> bytes:
        rest, doc, place = columns
        step = np.diff(doc, prepend=np.int64(0)).view(np.uint64)
        zig = (step << np.uint64(1)) ^ (np.uint64(0) - (step >> np.uint64(63)))
        same = np.empty(len(doc), bool)
        same[:1] = False
        same[1:] = doc[1:] == doc[:-1]
        place = place.astype(np.int64)
        near = np.where(same & (np.diff(place, prepend=np.int64(0)) >= 0), np.diff(place, prepend=np.int64(0)), place)
        up = same & (np.diff(place, prepend=np.int64(0)) >= 0)
        low = rest.astype(np.uint32) if size == 4 else rest.astype(np.uint64)
        return packed([low, zig, (near.astype(np.uint64) << np.uint64(1) | up.astype(np.uint64)).astype(np.uint32)])

    return encode


def places_decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, zig, coded = unpacked(blob)
    step = (zig >> np.uint64(1)) ^ (np.uint64(0) - (zig & np.uint64(1)))
    doc = np.cumsum(step, dtype=np.uint64).view(np.int64)
    up, value = (coded & 1).astype(bool), (coded >> np.uint32(1)).astype(np.int64)
    total = np.cumsum(value)
    base = np.flatnonzero(~up)
    group = np.cumsum(~up) - 1
    return rest, doc, total - (total[base] - value[base])[group]
