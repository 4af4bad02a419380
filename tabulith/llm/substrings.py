"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping blocks of half a window; these reference blocks are the
index. Each rolling block of each text probes it. Any repeat of a whole window holds a whole
reference block, so the hits - a block that a smaller id has as a reference block - touch every
repeat. A hit is extended over each window that holds it, windows are compared with those extended
from the other documents' hits, and the windows that agree join to maximal repeats.

Documents are dealt to buckets by their id. What meets by hash are summaries: of each distinct hash
of a bucket of documents (of a bounded stretch of it) one entry with its smallest and largest id,
and what comes back is an entry for the bucket, which finds the places again in its texts. So a
passage that a third of all documents share costs an entry a bucket, not one an occurrence, and no
pair of documents is ever made.

Windows are compared by 64 bits of one hash and by the value of their bytes, as a polynomial modulo
the prime 2**61 - 1, at a point drawn anew for each run. Whatever the texts are, two different
windows of b bytes together agree in the second with odds of at most b / 2**61, and no text can be
made to collide in it. Of 10**12 windows with evenly spread first hashes about 10**24 / 2**65 pairs
share the first, so that a false repeat has odds near 1e-11.
"""

from __future__ import annotations

import secrets
import struct
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulith.llm import _blobs, _rows, _spark
from tabulith.llm._words import P61, Texts, slices, windows, windows61

WINDOW = 50
#: Entries of a bucket of documents that are gathered before they are reduced and sent.
STRETCH = 1_000_000
_NO_ID = np.int64(np.iinfo(np.int64).max)


def _encoded(by: int, origin: int | None = None):
    """Encoder of a blob: entries sorted by the ids in column by, these as differences; before it the bucket they come from."""

    def encode(columns: list[np.ndarray]) -> bytes:
        order = np.argsort(columns[by], kind="stable")
        columns = [c[order] for c in columns]
        columns[by] = np.diff(columns[by], prepend=np.int64(0)).view(np.uint64)
        return (b"" if origin is None else struct.pack("<i", origin)) + _blobs.packed(columns)

    return encode


def _decoded(blob, by: int, with_origin: bool) -> tuple[int, list[np.ndarray]]:
    raw = memoryview(blob)
    (origin,) = struct.unpack("<i", raw[:4]) if with_origin else (0,)
    columns = _blobs.unpacked(raw[4:] if with_origin else raw)
    columns[by] = np.cumsum(columns[by], dtype=np.uint64).view(np.int64)
    return origin, columns


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


class _Summary:
    """Entries of one bucket of documents, gathered over a stretch of text, reduced, and emitted by hash."""

    def __init__(self, reduce, n_buckets: int, origin: int):
        self.reduce, self.n_buckets, self.origin = reduce, n_buckets, origin
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.out = 0, []

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])
        if self.size >= STRETCH:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            hashes, columns, by = self.reduce(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
            self.parts, self.size = [], 0
            encode = _encoded(by, self.origin)
            bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
            self.out += _blobs.batches((b, encode(c)) for b, c in _blobs.split(bucket, self.n_buckets, columns))

    def table(self) -> pa.Table:
        self.flush()
        _spark.released()
        return pa.Table.from_batches(self.out, schema=_blobs.ARROW)


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the smallest id of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], docs[new]


class _Index:
    """The distinct hashes of a bucket with the smallest id of each, gathered blob by blob."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.kept = 0, 0

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        if len(keys):
            self.parts.append(_smallest(keys, docs))
            self.size += len(keys)
        if self.size > 2 * self.kept + 1_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            self.parts = [_smallest(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
        self.size = self.kept = len(self.parts[0][0])
        return self.parts[0]


def _found(index: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in the index, and whether they do."""
    if not len(index):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
    return at, index[at] == keys


def _texts(blobs: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Texts]]:
    """The rows of some blobs in slices: (rows, bytes, offsets, ids, whether they are there, texts)."""
    for blob in blobs.column("blob"):
        for batch in _rows.from_blob(blob).to_batches():
            for part, data, at in slices(batch):
                yield part, data, at, *_rows.doc_keys(part), Texts(data, at)


def _rolling(texts: Texts, valid: np.ndarray, window: int, n: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash, row) of every run of n words of the texts that hold a window and have an id."""
    long = valid & (np.diff(texts.first) >= window)
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    where, hashes = windows(texts.hashes(kind), texts.first, n, kind)
    row = texts.rows()[where]
    keep = long[row]
    return where[keep], hashes[keep], row[keep]


def probes(packed_docs: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Summaries of the rolling blocks of each bucket: (high half of the hash, largest id, its distance from the smallest id that has it as a reference block)."""
    block = window // 2

    def reduce(hashes: np.ndarray, ids: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
        order = np.lexsort((ids, hashes))
        hashes, ids = hashes[order], ids[order]
        start = _runs(hashes)
        most = ids[np.append(start[1:], len(ids)) - 1]
        least = np.minimum.reduceat(np.where(ref[order], ids, _NO_ID), start)
        gap = np.where(least == _NO_ID, np.uint64(0), (most - least).view(np.uint64) + np.uint64(1))
        return hashes[start], [(hashes[start] >> np.uint64(32)).astype(np.uint32), most, gap], 1

    def emit(left: pa.Table) -> pa.Table:
        out = _Summary(reduce, n_buckets, left.column("bucket")[0].as_py())
        for _, _, _, ids, valid, texts in _texts(left):
            where, hashes, row = _rolling(texts, valid, window, block, 0)
            out.add(hashes, ids[row], (where - texts.first[row]) % block == 0)
        return out.table()

    return _blobs.exchanged(packed_docs.groupBy("bucket").applyInArrow(emit, _blobs.SCHEMA))


def _keys(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """What of a block's hash is kept: its high half and its bucket."""
    return (hashes >> np.uint64(32) << np.uint64(16)) | (hashes % np.uint64(n_buckets))


def hits(probed: DataFrame, n_docs: int) -> DataFrame:
    """To the buckets of documents: (hash, smallest id that has it as a reference block, largest id) of the blocks that two documents have."""

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_docs, _encoded(1), most=STRETCH)
        for bucket, spool in _blobs.spools(rows):
            index = _Index()
            for blob in spool:
                _, (key, most, gap) = _decoded(blob, 1, True)
                is_ref = gap > 0
                index.add(key[is_ref], (most[is_ref].view(np.uint64) - (gap[is_ref] - np.uint64(1))).view(np.int64))
            keys, least = index.merge()
            last = np.full(len(keys), np.iinfo(np.int64).min)
            for blob in spool:
                _, (key, most, _) = _decoded(blob, 1, True)
                at, there = _found(keys, key)
                np.maximum.at(last, at[there], most[there])
            for blob in spool:
                origin, (key, most, gap) = _decoded(blob, 1, True)
                at, there = _found(keys, key)
                key, most, gap, at = key[there], most[there], gap[there], at[there]
                own = np.where(gap > 0, (most.view(np.uint64) - (gap - np.uint64(1))).view(np.int64), _NO_ID)
                live = (least[at] < most) | (own < last[at])
                at = at[live]
                yield from gather.add(np.full(len(at), origin), (key[live].astype(np.uint64) << np.uint64(16)) | np.uint64(bucket), least[at], last[at].view(np.uint64) - least[at].view(np.uint64))
        yield from gather.flush()

    return _spark.arrow_map(probed, meet, _blobs.SCHEMA)


def _replies(blobs: pa.Table, by: int, n: int) -> list[np.ndarray]:
    """The columns of some replies, sorted by the first and without repeats of the columns before by."""
    got = [_decoded(b.as_buffer(), by, False)[1] for b in blobs.column("blob")]
    if not got:
        return [np.zeros(0, np.int64 if k == by else np.uint64) for k in range(n)]
    columns = [np.concatenate(c) for c in zip(*got, strict=True)]
    order = np.lexsort(columns[:by][::-1])
    columns = [c[order] for c in columns]
    start = _runs(*columns[:by])
    return [c[start] for c in columns]


def _spread(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of size places lie in one of the spans [low, high)."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0


def extended(packed_docs: DataFrame, hit: DataFrame, window: int, n_buckets: int, base: int) -> DataFrame:
    """Summaries of the windows that hold a hit: (hash, value at base, smallest id, its distance from the largest)."""
    block = window // 2

    def reduce(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
        order = np.lexsort((ids, checks, hashes))
        hashes, checks, ids = hashes[order], checks[order], ids[order]
        start = _runs(hashes, checks)
        least, most = ids[start], ids[np.append(start[1:], len(ids)) - 1]
        return hashes[start], [hashes[start], checks[start], least, most.view(np.uint64) - least.view(np.uint64)], 2

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, least, more = _replies(right, 1, 3)
        if not left.num_rows or not len(keys):
            return _blobs.ARROW.empty_table()
        last = (least.view(np.uint64) + more).view(np.int64)
        out = _Summary(reduce, n_buckets, left.column("bucket")[0].as_py())
        for _, _, _, ids, valid, texts in _texts(left):
            where, hashes, row = _rolling(texts, valid, window, block, 0)
            at, there = _found(keys, _keys(hashes, n_buckets))
            is_ref = (where - texts.first[row]) % block == 0
            there &= (least[at] < ids[row]) | (is_ref & (last[at] > ids[row]))
            g, row = where[there], row[there]
            if not len(g):
                continue
            low, high = np.maximum(texts.first[row], g - (window - block)), np.minimum(g, texts.first[row + 1] - window) + 1
            ok = high > low
            live = _spread(len(texts.starts), low[ok], high[ok])
            where, hashes, row = _rolling(texts, valid, window, window, 1)
            keep = live[where]
            where, hashes, row = where[keep], hashes[keep], row[keep]
            out.add(hashes, windows61(texts, where, window, base), ids[row])
        return out.table()

    return _blobs.exchanged(packed_docs.groupBy("bucket").cogroup(hit.groupBy("bucket")).applyInArrow(extend, _blobs.SCHEMA))


class _Pairs:
    """The distinct (hash, value) of a bucket with the smallest id of each."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size, self.kept = 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(list(columns))
        self.size += len(columns[0])
        if self.size > 2 * self.kept + 1_000_000:
            self.merge()

    def merge(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        start = _runs(*columns[:2])
        self.parts = [[c[start] for c in columns]]
        self.size = self.kept = len(start)
        return self.parts[0]


def _paired(keys: np.ndarray, checks: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (key, check) stands among sorted pairs, and whether it does; equal keys with other checks are passed over."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.searchsorted(keys, key)
    while True:
        now = np.minimum(at, len(keys) - 1)
        on = (at < len(keys)) & (keys[now] == key) & (checks[now] < check)
        if not on.any():
            return now, (at < len(keys)) & (keys[now] == key) & (checks[now] == check)
        at = at + on


def repeats(extension: DataFrame, n_docs: int) -> DataFrame:
    """To the buckets of documents: (hash, value, smallest id) of the windows that a smaller id than theirs has too."""

    def agree(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _blobs.Gather(n_docs, _encoded(2), most=STRETCH)
        for _, spool in _blobs.spools(rows):
            index = _Pairs()
            for blob in spool:
                _, (key, check, least, _) = _decoded(blob, 2, True)
                index.add(key, check, least)
            keys, checks, first = index.merge()
            for blob in spool:
                origin, (key, check, least, more) = _decoded(blob, 2, True)
                at, _ = _paired(keys, checks, key, check)
                again = first[at] < (least.view(np.uint64) + more).view(np.int64)
                yield from gather.add(np.full(again.sum(), origin), key[again], check[again], first[at[again]])
        yield from gather.flush()

    return _spark.arrow_map(extension, agree, _blobs.SCHEMA)


def _kept(text: bytes, starts: np.ndarray, gone: np.ndarray, joined: bool) -> bytes:
    if joined:
        words = text.split()
        return b" ".join(compress(words, ~gone)) if gone.any() else b" ".join(words)
    if not gone.any():
        return text
    change = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    cut = np.append(starts, len(text))
    at, out = 0, []
    for low, high in zip(change[::2], change[1::2], strict=True):
        out.append(text[at : cut[low]])
        at = cut[high]
    return b"".join([*out, text[at:]])


def dedup(docs: DataFrame, window: int = WINDOW, joined: bool = False) -> DataFrame:
    """docs without the words that lie in a window which a smaller doc_id has too.

    docs: doc_id, text and any other columns, which stay (n_words and n_removed are replaced).
    text: what is left - with joined, the kept words joined by one space; else the text with the
    removed stretches cut out, unchanged where nothing goes. n_words, n_removed: words before, and gone.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Windows are judged on the input. A null
    text has no words and becomes empty (joined) or stays null; shorter texts than a window are kept
    whole. A row with a null doc_id is kept whole and makes no other row lose words. doc_id is taken
    as a key: equal rows are treated alike; rows of one id never make each other lose words. Texts
    are read whole; a very long text is handled alone.
    """
    spark = docs.sparkSession
    size = _spark.plan_bytes(docs)
    n_buckets = _spark.buckets(spark, 0.3 * size, 1_000_000)
    n_docs = _spark.buckets(spark, 2 * size, 8 << 20)
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    docs = docs.select(*rest)
    base = 2 + secrets.randbelow(P61 - 3)  # one for the job, so that tasks that run again agree
    packed_docs = _rows.dealt(docs, n_docs)
    found = hits(probes(packed_docs, window, n_buckets), n_docs)
    again = repeats(extended(packed_docs, found, window, n_buckets, base), n_docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, checks, first_id = _replies(right, 2, 3)
        out = []
        for part, data, at, ids, valid, texts in _texts(left):
            gone = np.zeros(len(texts.starts), bool)
            if len(keys):
                where, hashes, row = _rolling(texts, valid, window, window, 1)
                there = _found(keys, hashes)[1]
                where, hashes, row = where[there], hashes[there], row[there]
                if len(where):
                    k, same = _paired(keys, checks, hashes, windows61(texts, where, window, base))
                    again = where[same & (first_id[k] < ids[row])]
                    gone = _spread(len(texts.starts), again, again + window)
            raw, kept, first = data.tobytes(), [], texts.first
            lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
            for k in range(part.num_rows):
                kept.append(_kept(raw[at[k] : at[k + 1]], texts.starts[first[k] : first[k + 1]] - at[k], gone[first[k] : first[k + 1]], joined))
            null = part.column(part.schema.get_field_index("text")).is_null()
            text = pa.array(kept, pa.binary(), mask=None if joined else np.asarray(null)).cast(pa.string())
            columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            columns["text"] = text
            columns |= {"n_words": pa.array(np.diff(first)), "n_removed": pa.array(lost)}
            out.append(pa.table(columns))
        _spark.released()
        return pa.concat_tables(out) if out else empty

    empty = pa.table([pa.array([], f.type) for f in to_arrow_schema(schema)], schema=to_arrow_schema(schema))
    return packed_docs.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(cut, schema)
