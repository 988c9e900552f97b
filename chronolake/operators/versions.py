"""Row versions in system time: whole scans, one instant, and ranges of instants.

A version holds from ``valid_from`` up to, but not at, ``valid_to``; a current one has no
``valid_to``.  Every function takes and returns DataFrames and adds filters and unions
only, so Catalyst pushes the instant into both scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptData, MissingColumn, WrongType

FROM, BY, TO, DELETED_BY, CURRENT, ROW_ID = "valid_from", "changed_by", "valid_to", "deleted_by", "is_current", "temporal_row_id"
MANAGED = (FROM, BY)
HISTORY_ONLY = (TO, DELETED_BY)
ALL_MANAGED = (FROM, BY, TO, DELETED_BY, CURRENT)


def moment(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t)


def as_of(base: DataFrame, history: DataFrame, t) -> DataFrame:
    """The rows that held at t, with the base table's columns as they are today.

    A column that the history lacks is an error rather than a null.
    """
    missing = [c for c in base.columns if c not in history.columns]
    if missing:
        raise CorruptData(f"the history lacks {', '.join(missing)}")
    t = moment(t)
    then = history.filter((F.col(FROM) <= t) & (F.col(TO) > t)).select(*base.columns)
    return base.filter(F.col(FROM) <= t).unionByName(then)


def versions(base: DataFrame, history: DataFrame) -> DataFrame:
    """All versions with valid_to, deleted_by and is_current; history columns that the base has dropped are left out."""
    kind = dict(history.dtypes)
    now = base.withColumns({TO: F.lit(None).cast(kind[TO]), DELETED_BY: F.lit(None).cast("string"), CURRENT: F.lit(True)})
    then = history.withColumn(CURRENT, F.lit(False)).select(*now.columns)
    return then.unionByName(now)


def from_to(found: DataFrame, a, b) -> DataFrame:
    """Versions that held at some time after a and before b."""
    return found.filter((F.col(FROM) < moment(b)) & (F.col(TO).isNull() | (F.col(TO) > moment(a))))


def between(found: DataFrame, a, b) -> DataFrame:
    """Versions that held at some time after a and up to b."""
    return found.filter((F.col(FROM) <= moment(b)) & (F.col(TO).isNull() | (F.col(TO) > moment(a))))


def contained_in(found: DataFrame, a, b) -> DataFrame:
    """Versions that began and ended within [a, b]; open ones never do."""
    return found.filter((F.col(FROM) >= moment(a)) & (F.col(TO) <= moment(b)))


def at_instant(found: DataFrame, t) -> DataFrame:
    """Of versions(), those that held at t."""
    t = moment(t)
    return found.filter((F.col(FROM) <= t) & (F.col(TO).isNull() | (F.col(TO) > t)))


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions as base and history."""
    return found.filter(CURRENT).drop(TO, DELETED_BY, CURRENT), found.filter(~F.col(CURRENT)).drop(CURRENT)


def _checked(df: DataFrame, name: str, kinds: tuple) -> Column:
    field = next((f for f in df.schema if f.name == name), None)
    if field is None:
        raise MissingColumn(f"rows have no {name}")
    if not isinstance(field.dataType, kinds):
        raise WrongType(f"{name} is {field.dataType.simpleString()}")
    return F.col(name)


def mod_date(df: DataFrame) -> Column:
    """When a row of a base, history or versions table was written."""
    return _checked(df, FROM, (T.TimestampType, T.TimestampNTZType))


def mod_user(df: DataFrame) -> Column:
    """Who wrote it."""
    return _checked(df, BY, (T.StringType,))
