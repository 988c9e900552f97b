"""What changed, when and by whom: change events, one column's timeline, counts by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TemporalError
from .versions import ALL_MANAGED, BY, CURRENT, DELETED_BY, FROM, ROW_ID, TO, moment


def comparable(field: T.StructField) -> Column:
    """A column in a form that <=> compares; maps as sorted entries."""
    return F.array_sort(F.map_entries(field.name)) if isinstance(field.dataType, T.MapType) else F.col(field.name)


def image_columns(found: DataFrame, excluded: Sequence[str] = ()) -> list[str]:
    return [c for c in found.columns if c not in (*ALL_MANAGED, ROW_ID, *excluded)]


def change_rows(found: DataFrame, keys: Sequence[str], excluded: Sequence[str] = (), start=None, end=None, match: dict | None = None, lineage: bool = False) -> DataFrame:
    """Events in [start, end): keys, changed_at, changed_by, operation, changed_columns, and the images as structs ``old`` and ``new``.

    found: versions().  A version that begins where its predecessor ends is an UPDATE,
    any other, one of no time too, an INSERT; one that ends with no successor at that
    time also gives a DELETE.  The predecessor is looked up before times are filtered.  With lineage,
    versions follow each other by row id rather than by key.
    """
    names = image_columns(found, excluded)
    if match:
        hit = F.lit(True)
        for name, value in match.items():
            hit = hit & F.col(name).eqNullSafe(F.lit(value))
        # with lineage, all versions of the rows that match at any time
        found = found.join(found.filter(hit).select(ROW_ID).distinct(), ROW_ID, "left_semi") if lineage else found.filter(hit)
    w = Window.partitionBy(*([ROW_ID] if lineage else keys)).orderBy(F.col(FROM).asc_nulls_last())
    image = F.struct(*names)
    seen = found.select(*keys, FROM, BY, TO, DELETED_BY, CURRENT, image.alias("new"), F.lag(image).over(w).alias("before"), F.lag(TO).over(w).alias("before_to"), F.lead(FROM).over(w).alias("next"))
    inside = lambda c: (F.lit(True) if start is None else c >= moment(start)) & (F.lit(True) if end is None else c < moment(end))
    update = F.coalesce(F.col("before_to") == F.col(FROM), F.lit(False))
    value = lambda side, n: F.array_sort(F.map_entries(f"{side}.{n}")) if isinstance(found.schema[n].dataType, T.MapType) else F.col(f"{side}.{n}")
    differ = F.filter(F.array(*(F.when(~value("before", n).eqNullSafe(value("new", n)), F.lit(n)) for n in sorted(names))), lambda x: x.isNotNull())
    writes = seen.filter(inside(F.col(FROM))).select(
        *keys, F.col(FROM).alias("changed_at"), F.col(BY).alias("changed_by"), F.when(update, "UPDATE").otherwise("INSERT").alias("operation"),
        F.when(update & (F.size(differ) > 0), differ).alias("changed_columns"), F.when(update, F.col("before")).alias("old"), "new",
    )
    gone = ~F.col(CURRENT) & (F.col("next").isNull() | (F.col("next") != F.col(TO)))
    deletes = seen.filter(gone & inside(F.col(TO))).select(
        *keys, F.col(TO).alias("changed_at"), F.col(DELETED_BY).alias("changed_by"), F.lit("DELETE").alias("operation"),
        F.lit(None).cast("array<string>").alias("changed_columns"), F.col("new").alias("old"), F.lit(None).cast(seen.schema["new"].dataType).alias("new"),
    )
    return writes.unionByName(deletes)


def changes(found: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    """change_rows() with key and images as JSON, in order of time."""
    rows = change_rows(found, keys, **how)
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return rows.select(text(F.struct(*keys)).alias("pk"), "changed_at", "changed_by", "operation", text(F.col("old")).alias("old_row"), text(F.col("new")).alias("new_row"), "changed_columns").orderBy("changed_at")


def column_history(found: DataFrame, keys: Sequence[str], column: str, match: dict | None = None, until=None, excluded: Sequence[str] = (), lineage: bool = False) -> DataFrame:
    """changed_at, changed_by and value of one column wherever it differs from the version before; keys tell rows apart."""
    if column not in image_columns(found, excluded):
        raise TemporalError(f"no tracked column {column}")
    if match:
        hit = F.lit(True)
        for name, value in match.items():
            hit = hit & F.col(name).eqNullSafe(F.lit(value))
        found = found.join(found.filter(hit).select(ROW_ID).distinct(), ROW_ID, "left_semi") if lineage else found.filter(hit)
    if until is not None:
        found = found.filter(F.col(FROM) <= moment(until))
    by = [ROW_ID] if lineage else list(keys)
    w = Window.partitionBy(*by).orderBy(F.col(FROM).asc_nulls_last())
    value = comparable(found.schema[column])
    seen = found.withColumn("_before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return seen.filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(value)).select(*by, F.col(FROM).alias("changed_at"), F.col(BY).alias("changed_by"), F.col(column).alias("value"))


def table_stats(base: DataFrame, history: DataFrame) -> DataFrame:
    """One row: counts of base, history and versions, the first and last write, versions for each row."""
    side = lambda df: df.agg(F.count("*").alias("n"), F.min(FROM).alias("low"), F.max(FROM).alias("high"))
    both = side(base).select(*(F.col(c).alias(f"b_{c}") for c in ("n", "low", "high"))).crossJoin(side(history).select(*(F.col(c).alias(f"h_{c}") for c in ("n", "low", "high"))))
    every = F.col("b_n") + F.col("h_n")
    return both.select(
        F.col("b_n").alias("base_rows"), F.col("h_n").alias("history_rows"), every.alias("version_rows"), F.least("b_low", "h_low").alias("oldest"), F.greatest("b_high", "h_high").alias("newest"),
        F.when(F.col("b_n") > 0, F.round(every / F.col("b_n"), 2)).alias("avg_versions"),
    )


def date_bin(width_seconds: int, t: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin of t, bins counted from origin."""
    start = F.lit(origin).cast("timestamp_ntz")
    passed = F.timestamp_diff("MICROSECOND", start, t.cast("timestamp_ntz")) if hasattr(F, "timestamp_diff") else F.unix_micros(t.cast("timestamp"))
    width = width_seconds * 1_000_000
    return F.timestamp_add("MICROSECOND", (F.floor(passed / F.lit(width)) * F.lit(width)).cast("long"), start)


def heatmap(found: DataFrame, keys: Sequence[str], bin_seconds: int | None = None) -> DataFrame:
    """bin, changed_by, distinct rows and versions written, by day or by bins of bin_seconds."""
    when = F.date_trunc("DAY", FROM).cast("timestamp_ntz") if bin_seconds is None else date_bin(bin_seconds, F.col(FROM))
    return found.groupBy(when.alias("bin"), BY).agg(F.count_distinct(*keys).alias("rows"), F.count("*").alias("versions"))
