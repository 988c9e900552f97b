"""Streams of operations into a tracked table, and streams of versions.

``snapshots_into_table`` applies each micro-batch as one transaction: a table's versions
are its states after the batches, so that of a key's operations in one batch only the
last makes one.  A batch that was applied is known by the stream's checkpoint and its
number and skipped when it comes again; other streams into the table have their own
numbers.  A stream's whole history, whatever its batches, is what ``versions`` gives: it
folds a stream of operations into closed versions with one small state for each key: the
open version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.versions import BY, CURRENT, DELETED_BY, FROM, TO


def snapshots_into_table(stream: DataFrame, session, name: str, checkpoint: str, order: str, deleted: str | None = None):
    """Start a query that upserts (and deletes) rows by key, the last operation of a key in a batch; ties of order go to the larger row."""

    def apply(batch: DataFrame, number: int) -> None:
        table = session.table(name)
        done = table.state.get("batches", {})
        if done.get(checkpoint, -1) >= number or batch.isEmpty():
            return
        last = batch.groupBy(*table.key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, *(f.name for f in batch.schema if f.name != order and not isinstance(f.dataType, T.MapType)))).alias("_r")).select("_r.*")
        last = session.pinned(last)
        with session.transaction():
            live = last if deleted is None else last.filter(~F.coalesce(F.col(deleted), F.lit(False)))
            table.upsert(live.select(*(c for c in live.columns if c in table.app_columns)))
            if deleted is not None:
                table.delete(source=last.filter(deleted).select(*table.key))
            session.change(name, batches=done | {checkpoint: number})

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def versions(stream: DataFrame, key: str, value: str, at: str, by: str, deleted: str, delay: str = "1 hour") -> DataFrame:
    """key, value and period of each closed version; operations later than delay behind the newest are dropped by the watermark.

    Of operations of one key, those before the open version began are late and ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {value} {kinds[value]}, {FROM} timestamp, {BY} string, {TO} timestamp, {DELETED_BY} string, {CURRENT} boolean"
    state = f"{value} {kinds[value]}, started timestamp, who string, live boolean"

    def close(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = group.get if group.exists else (None, None, None, False)
        rows = []
        for row in pd.concat(list(frames)).sort_values(at).itertuples(index=False):
            t, who, gone, new = getattr(row, at), getattr(row, by), getattr(row, deleted), getattr(row, value)
            old, started, author, live = held
            if started is not None and t < started or (gone and not live) or (live and not gone and old == new):
                continue
            if live and t > started:
                rows.append((k[0], old, started, author, t, who if gone else None, False))
            held = (None if gone else new, t, who, not gone)
        if held[1] is not None:
            group.update(held)
        yield pd.DataFrame(rows, columns=[key, value, FROM, BY, TO, DELETED_BY, CURRENT])

    watched = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return watched.groupBy(key).applyInPandasWithState(close, out, state, "append", GroupStateTimeout.NoTimeout)


def edits_per_window(stream: DataFrame, at: str, by: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Operations by window and author."""
    watched = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return watched.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("edits")).select(F.col("w.start").alias("bin"), by, "edits")
