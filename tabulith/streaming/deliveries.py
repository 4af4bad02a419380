"""Deliveries from streams: events of a declared period, files that have settled, records new to the sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabulith.sinks import files


def in_period(events: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """events with period_state by a declared closed period: current, historical before it, unknown after it; what came late counts as what it is."""
    day = F.to_date(ts)
    return events.withColumn("period_state", F.when(day.between(start, end), "current").when(day < start, "historical").otherwise("unknown"))


def period_counts(events: DataFrame, start: Column, end: Column, window: str = "1 day") -> DataFrame:
    """Counts and sums by window and type of the current period's events (ts, event_type, value); for streams in complete or update mode."""
    own = in_period(events, start, end).where("period_state = 'current'")
    return own.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


SETTLED = "path string, mtime timestamp, size long, stable boolean"


def settled_files(listings: DataFrame, window_s: float = 5.0) -> DataFrame:
    """Of a stream of listings (path, mtime, size, now) each file's samples, and whether it has settled by then.

    State: the last sample of each path. A file has settled if it is older than the window and its sample
    before, if there is one, was the same.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("now")
        out = []
        for r in rows.itertuples(index=False):
            same = last is None or (last[0] == r.mtime.timestamp() and last[1] == r.size)
            out.append((key[0], r.mtime, r.size, bool(same and (r.now - r.mtime).total_seconds() >= window_s)))
            last = (r.mtime.timestamp(), int(r.size))
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "mtime", "size", "stable"])

    return listings.groupBy("path").applyInPandasWithState(follow, SETTLED, "mtime double, size long", "append", GroupStateTimeout.NoTimeout)


def new_rows(rows: DataFrame, target: str, key: str = "record_id") -> DataFrame:
    """rows whose key the target does not hold, of rows with one key one; a row without a key is new whatever the target holds."""
    spark = rows.sparkSession
    named, others = rows.where(F.col(key).isNotNull()).dropDuplicates([key]), rows.where(F.col(key).isNull())
    if files.exists(spark, target):
        named = named.join(spark.read.parquet(target).select(key), key, "left_anti")
    return named.select(*rows.columns).unionByName(others)


def deliver(records: DataFrame, target: str, state: str, key: str = "record_id") -> StreamingQuery:
    """Append records that the target does not hold; a batch that ran before adds nothing with a key when it runs again."""

    def batch(rows: DataFrame, number: int) -> None:
        done = f"{state.rstrip('/')}/delivered/{number}"
        if files.exists(rows.sparkSession, done):
            return
        new_rows(rows, target, key).write.mode("append").parquet(target)
        files.write(rows.sparkSession, done, b"")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
