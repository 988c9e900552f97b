"""Errors that carry the SQLSTATE of the condition."""

from __future__ import annotations


class TemporalError(Exception):
    sqlstate = "P0001"


class ReadOnlyAsOf(TemporalError):
    """A write to a tracked table while an instant is set."""

    sqlstate = "25006"


class NotSupported(TemporalError):
    sqlstate = "0A000"


class NullInstant(TemporalError):
    sqlstate = "22004"


class InvalidInstant(TemporalError):
    sqlstate = "22023"


class StaleWriter(TemporalError):
    """The row is newer than the transaction, or another commit came first: retry."""

    sqlstate = "40001"


class NotAllowed(TemporalError):
    """A write without a user where one is required, or to the history."""

    sqlstate = "42501"


class UnknownTable(TemporalError):
    sqlstate = "42704"


class MissingColumn(TemporalError):
    sqlstate = "42703"


class WrongType(TemporalError):
    sqlstate = "42804"


class NotNullViolation(TemporalError):
    sqlstate = "23502"


class UniqueViolation(TemporalError):
    sqlstate = "23505"


class CorruptData(TemporalError):
    sqlstate = "XX001"
