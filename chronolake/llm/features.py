"""Hashed text features and bounded samples of labelled rows, shared by the classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache import Cache
from .shingles import mix

TOKENS = re.compile(r"\w+|[^\w\s]+")
_tokens = Cache(xxhash.xxh3_64_intdigest, 50_000)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(text: str | None, buckets: int) -> np.ndarray:
    """The buckets of all words, runs of signs and pairs of neighbours of a text, with repeats; buckets: a power of two."""
    found = TOKENS.findall((text or "").lower())
    if not found:
        return np.empty(0, np.int64)
    one = np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))
    two = mix(one[:-1] * _MIX + one[1:])
    return (np.concatenate([one, two]) & np.uint64(buckets - 1)).astype(np.int64)


def sample_rows(labels: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of labels, those with the least hash of key: the same rows in any order of the input."""
    return labels.orderBy(F.xxhash64(F.col(key), F.lit(5)), key).limit(most)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def sparse_sums(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each index at which any of the arrays isn't zero."""
    hit = np.flatnonzero(np.any([x != 0 for x in columns.values()], axis=0))
    if len(hit):
        yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(x[hit]) for x in columns.values())], ["bucket", *columns])


def dense(sums: DataFrame, names: list[str], buckets: int) -> list[np.ndarray]:
    """Sums by bucket as arrays on the driver: no more than ``buckets`` rows."""
    rows = sums.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    out = []
    for x in names:
        full = np.zeros(buckets)
        full[rows["bucket"].to_numpy(np.int64)] = rows[x].to_numpy(float)
        out.append(full)
    return out
