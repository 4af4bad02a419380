"""Best-fit packing of documents into sequences by large-item matching.

A document longer than a sequence is cut: its remainder first, then full sequences. What is packed is
then described by its lengths alone, and there are at most `capacity` of them. The plan is made on
that histogram: lengths above a third of the capacity - at most two share a sequence - are matched
greedily, the largest with the largest that still fits; the smaller ones, largest first, go where the
least gap remains that holds them, or open sequences of their own. A step of the plan treats all
sequences of one filling at once, so the plan has a few thousand steps however many documents there
are; the documents take their places in it by their rank among those of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm import _spark, tokens

CAPACITY, END_ID = 1024, 2
#: Sums over tasks and lengths up to which they are broadcast; beyond, they are joined.
BROADCAST_SUMS = 500_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, sequences, first sequence, first offset) for counts of lengths up to capacity.

    The items of a length with rank first + k take sequence (first sequence + k % sequences), at
    first offset + length * (k // sequences), up to the next slot of that length.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    by_gap: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(capacity + 1)]
    third = capacity // 3

    def best(most: int, least: int) -> int:
        return next((x for x in range(most, least, -1) if left[x]), 0)

    for length in range(capacity, third, -1):
        while left[length]:
            mate = best(min(length, capacity - length), third)
            if not mate or (mate == length and left[length] == 1 and not (mate := best(length - 1, third))):
                n, filling, gap = left[length], ((length, 1),), capacity - length
                left[length] = 0
            elif mate == length:
                n, filling, gap = left[length] // 2, ((length, 2),), capacity - 2 * length
                left[length] -= 2 * n
            else:
                n, filling, gap = min(left[length], left[mate]), ((length, 1), (mate, 1)), capacity - length - mate
                left[length] -= n
                left[mate] -= n
            by_gap[gap].append((filling, n))

    for length in range(third, 0, -1):
        gap = length
        while left[length]:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // length
                n, k = (left[length] // each, each) if left[length] >= each else (1, left[length])
                by_gap[capacity - k * length].append((((length, k),), n))
                left[length] -= n * k
                gap = length
                continue
            filling, there = by_gap[gap].pop()
            n = min(there, left[length])
            if n < there:
                by_gap[gap].append((filling, there - n))
            last, k = filling[-1]
            more = (*filling[:-1], (length, k + 1)) if last == length else (*filling, (length, 1))
            by_gap[gap - length].append((more, n))
            left[length] -= n
            gap = length if gap - length >= length else gap

    slots, rank, sequence = [], [0] * (capacity + 1), 0
    for filling, n in (x for group in by_gap for x in group):
        offset = 0
        for length, k in filling:
            slots.append((length, rank[length], n, sequence, offset))
            rank[length] += n * k
            offset += length * k
        sequence += n
    return slots


def cut(total: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces."""
    first = total % capacity or capacity
    starts = np.concatenate(([0], np.arange(first, total, capacity)))
    return starts, np.diff(np.append(starts, total))


def pieces(docs: DataFrame, tokenizer: str = tokens.DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the whole texts' ids and the end id, cut to the capacity."""
    return _numbered(docs, tokenizer, capacity, end_id, keep_ids).drop("part", "own")


def _numbered(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """pieces() with part, the task that made them, and own, how many of the same length it made before."""
    where = tokens.tokenizer_path(tokenizer)
    schema = "part int, own long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        enc, end = tokens.encoder(where), np.array([end_id], "<u4").tobytes()
        part_id, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for part, texts in tokens.text_groups(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                ids += end
                for k, (a, n) in enumerate(zip(*(x.tolist() for x in cut(len(ids) // 4, capacity)), strict=True)):
                    own = ids[4 * a : 4 * (a + n)]
                    rows.append((part_id, made[n], doc, k, a, n, zlib.crc32(own), *([own] * keep_ids)))
                    made[n] += 1
            if rows:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=[f.split()[0] for f in schema.split(", ")])

    return _spark.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, schema)


def packed(docs: DataFrame, tokenizer: str = tokens.DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """pieces() of docs (doc_id, text) with sequence_id and offset: sequences have no gaps and no more than capacity tokens.

    A null text is empty and has the end id alone; an empty table has no rows. Equal and null doc_ids
    are rows like others. Only counts of lengths (capacity numbers) reach the driver. A piece's rank among
    those of its length is what its task counted before it and what the tasks before made: the sums of
    a row for each task and length, so that no piece is dealt by its length, however many share it.
    """
    spark = docs.sparkSession
    items = _spark.stored(_numbered(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    sizes = _spark.stored(items.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    placed = items.join(F.broadcast(before) if sizes.count() <= BROADCAST_SUMS else before, ["length", "part"])
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    kept = [f for f in items.schema.fields if f.name not in ("part", "own")]
    names, schema = [f.name for f in kept], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots[:, 0] << 44) + slots[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("at"))
                _, first, n, sequence, offset = slots[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
                k = rank - first
                columns = [batch.column(c) for c in names]
                yield pa.record_batch([*columns, pa.array(sequence + k % n), pa.array(offset + length * (k // n))], names=[*names, "sequence_id", "offset"])

    placed = placed.select(*names, (F.col("before") + F.col("own")).alias("at"))
    return _spark.arrow_map(placed, place, schema + ", sequence_id long, offset long")
