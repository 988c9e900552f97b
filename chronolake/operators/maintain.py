"""Maintenance of a history: pruning and compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changes import comparable
from .versions import ALL_MANAGED, FROM, ROW_ID, TO, moment


def prune(history: DataFrame, cutoff) -> DataFrame:
    """The history without versions that ended before cutoff."""
    return history.filter(F.col(TO) >= moment(cutoff))


def drop_before(history: DataFrame, cutoff, segment: Column) -> DataFrame:
    """The history without whole segments that ended before cutoff, and without such versions of the others."""
    ended = history.groupBy(segment.alias("_segment")).agg(F.max(TO).alias("_end")).filter(F.col("_end") < moment(cutoff))
    kept = history.withColumn("_of", segment).join(ended, F.col("_of").eqNullSafe(F.col("_segment")), "left_anti").select(*history.columns)
    return prune(kept, cutoff)


def compact(history: DataFrame, keys: Sequence[str], base_columns: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Neighbouring versions of a key with equal visible columns as one, from the first's start to the last's end.

    Columns that the base no longer has don't count; the first version's authors stay,
    and the current row is never merged.
    """
    compared = [f for f in history.schema if f.name in base_columns and f.name not in (*ALL_MANAGED, ROW_ID, *excluded, *keys)]
    w = Window.partitionBy(*keys).orderBy(FROM)
    fresh = F.lag(TO).over(w).isNull() | (F.lag(TO).over(w) != F.col(FROM))
    for f in compared:
        fresh = fresh | ~F.lag(comparable(f)).over(w).eqNullSafe(comparable(f))
    islands = history.withColumn("_fresh", fresh.cast("int")).withColumn("_island", F.sum("_fresh").over(w))
    # one sort serves both: the island's rows are neighbours in the key's order
    last = F.max(TO).over(Window.partitionBy(*keys, "_island"))
    return islands.withColumn("_last", last).filter("_fresh = 1").withColumn(TO, F.col("_last")).select(*history.columns)
