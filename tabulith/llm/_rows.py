"""Whole rows dealt by a key of theirs, packed as compressed Arrow streams: other columns travel unseen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulith.llm import _blobs, _spark
from tabulith.llm._words import mixed

#: Text bytes that a task gathers before it deals them.
GATHER_BYTES = 24 << 20


def doc_keys(batch: pa.RecordBatch, column: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """The ids (0 for null) and whether each is there."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
    valid = np.asarray(col.is_valid())
    return np.asarray(col.fill_null(0)), valid


def deal(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each id."""
    return (mixed(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_blob(blob: pa.Scalar | bytes) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob).read_all().combine_chunks()


def dealt(docs: DataFrame, n_buckets: int, key: str = "doc_id") -> DataFrame:
    """Rows (bucket, blob): every row of docs is in one blob of the bucket of its id."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            bucket = deal(doc_keys(table.combine_chunks().to_batches()[0], key)[0], n_buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            yield from _blobs.batches((int(b), to_blob(table.take(order[at[b] : at[b + 1]]))) for b in np.flatnonzero(np.diff(at)))

        for batch in rows:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GATHER_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return _spark.arrow_map(docs, pack, _blobs.SCHEMA)
