"""Settings of a tracked table and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta

from pyspark.sql import types as T

from .errors import TemporalError
from .operators.versions import ALL_MANAGED, BY, DELETED_BY, FROM, ROW_ID, TO

NAME_LENGTH = 51


@dataclass(frozen=True)
class TableConfig:
    """combine_interval folds edits of one user into one version; excluded columns change without a version."""

    key: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    combine_interval: timedelta = timedelta(seconds=5)
    include_indexes: bool = False  # kept as a setting: files are sorted by key, there are no secondary indexes
    lineage: bool = False
    codec: str = "zstd"
    retention: timedelta | None = None
    compaction: bool = False
    generated: dict = field(default_factory=dict)  # column: SQL expression, evaluated before a row is stamped

    def to_json(self) -> dict:
        return self.__dict__ | {"key": list(self.key), "excluded": list(self.excluded), "combine_interval": self.combine_interval.total_seconds(), "retention": None if self.retention is None else self.retention.total_seconds()}

    @staticmethod
    def from_json(x: dict) -> TableConfig:
        return TableConfig(**x | {"key": tuple(x["key"]), "excluded": tuple(x["excluded"]), "combine_interval": timedelta(seconds=x["combine_interval"]), "retention": None if x["retention"] is None else timedelta(seconds=x["retention"])})


def check_interval(interval: timedelta) -> None:
    if not isinstance(interval, timedelta):
        raise TemporalError("combine_interval must be a timedelta: it has no months or years")
    if interval < timedelta(0):
        raise TemporalError("combine_interval must not be negative")


def check_excluded(excluded: Sequence[str], key: Sequence[str], schema: T.StructType) -> None:
    for c in excluded:
        if c in (*ALL_MANAGED, ROW_ID):
            raise TemporalError(f"{c} is managed and can't be excluded")
        if c in key:
            raise TemporalError(f"{c} belongs to the key and can't be excluded")
        if c not in schema.names:
            raise TemporalError(f"no column {c} to exclude")


def check_new(config: TableConfig, schema: T.StructType) -> None:
    """What enabling refuses."""
    if not config.key:
        raise TemporalError("a primary key is required")
    for c in config.key:
        if c not in schema.names:
            raise TemporalError(f"no key column {c}")
    check_interval(config.combine_interval)
    for c in (TO, DELETED_BY):
        if c in schema.names:
            raise TemporalError(f"{c} is reserved for the history")
    kinds = {FROM: T.TimestampType, BY: T.StringType, ROW_ID: T.LongType}
    for c, kind in kinds.items():
        if c in schema.names and (c != ROW_ID or config.lineage) and not isinstance(schema[c].dataType, kind):
            raise TemporalError(f"{c} must be {kind().simpleString()}")
    check_excluded(config.excluded, config.key, schema)


def with_defaults(config: TableConfig, defaults: dict) -> TableConfig:
    """Model-wide defaults where the table leaves a setting alone; lineage is never defaulted."""
    plain = TableConfig(key=config.key)
    return replace(config, **{k: v for k, v in defaults.items() if k != "lineage" and getattr(config, k) == getattr(plain, k)})
