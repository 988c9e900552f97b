"""Quality selection by importance resampling.

Words, runs of signs and pairs of neighbours are hashed to ``BUCKETS`` buckets.  Two
generative models are counted: of the target texts (labelled good, at most
``TARGET_ROWS`` of them) and of the raw texts (all rows).  The importance weight of a
document is the ratio of its likelihoods under them; so that long texts don't outweigh
all others, it is the ratio for ``LENGTH`` n-grams drawn from the document (its mean log
ratio times that).  Documents are drawn without replacement in proportion to their
weight by Gumbel top-k: noise that depends on the id, the text and the seed alone is
added to the log weight, and the k largest sums stay.  By default k is the target's size
in the raw texts: the number of rows that weigh at least as much as all but ``LOST`` of
the good rows that were held back from the target model, and ``SLACK`` more.

The k-th largest sum is found by counts over ever narrower bins, never by a global sort.
Null and empty texts have weight 1 (log weight 0).  Rows whose sums tie with the k-th
all stay; rows that agree in id and text tie.  Null ids take part; an id that is labelled
more than once is good if any of its labels is.  Without any target row every weight is
1 and all rows stay.
Texts count as a whole, whatever their length.  Other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import dense, ngram_buckets, sample_rows, sparse_sums
from .scratch import materialize

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
PRIOR = 100  # n-grams that a bucket is taken to have on both sides besides those seen
LENGTH = 100
HELD_BACK = 5  # of the good rows, one in so many
LOST = 0.002
SLACK = 0.005
BINS = 1024
LAST_BIN = 10_000


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.bincount(ngram_buckets(text, BUCKETS), minlength=BUCKETS) if text and len(text) > 20_000 else ngram_buckets(text, BUCKETS)
            if len(own) == BUCKETS:
                raw += own
                target += own * bool(good)
            else:
                np.add.at(raw, own, 1)
                if good:
                    np.add.at(target, own, 1)
    yield from sparse_sums({"raw": raw, "target": target})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of target over raw probability by bucket, near 0 where few n-grams were seen."""
    share = target.sum() / max(1, raw.sum())
    return np.log((target + PRIOR) / (raw * share + PRIOR)) if share else np.zeros(len(raw))


def score_texts(ratios: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (ngram_buckets(x, BUCKETS) for x in batch.column(2).to_pylist())
            weights = [LENGTH * float(ratios[x].mean()) if len(x) else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(weights, pa.float64())], ["doc_id", "th", "probe", "log_weight"])

    return run


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key``."""
    low, high = keys.agg(F.min("key"), F.max("key")).head()
    while low < high:
        width = (high - low) / BINS
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), reverse=True)
        for row in bins:
            if k <= row.n:
                break
            k -= row.n
        low, high = row.a, row.b
        if row.n <= LAST_BIN:
            last = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()
            return sorted((x.key for x in last), reverse=True)[k - 1]
        if len(bins) == 1:
            break  # no finer than the numbers themselves
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, th (hash of the text), log_weight, key and kept of each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    good = sample_rows(labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct(), "doc_id", TARGET_ROWS)
    good = good.withColumn("probe", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_BACK)) == 0)
    # at most TARGET_ROWS ids
    marked = rows.join(F.broadcast(good), "doc_id", "left")
    raw, target = dense(marked.select("text", (~F.col("probe")).alias("good")).mapInArrow(count_ngrams, "bucket bigint, raw bigint, target bigint"), ["raw", "target"], BUCKETS)
    scored = marked.select("doc_id", "th", "text", "probe").mapInArrow(score_texts(log_ratios(raw, target)), "doc_id bigint, th bigint, probe boolean, log_weight double")
    # a uniform number in (0, 1) of the id, the text and the seed
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "th", F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    keys = materialize(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    if k is None:
        # of at most TARGET_ROWS rows with distinct ids
        probes = [x[0] for x in keys.filter("probe").groupBy("doc_id").agg(F.min("log_weight")).select("min(log_weight)").collect()]
        least = float(np.quantile(probes, LOST)) if probes else float("-inf")
        k = math.ceil(keys.filter(F.col("log_weight") >= least).count() * (1 + SLACK))
    n = keys.count()
    keys = keys.drop("probe")
    if k <= 0 or n == 0:
        return keys.withColumn("kept", F.lit(False))
    return keys.withColumn("kept", F.col("key") >= F.lit(kth_largest(keys, min(k, n))))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are drawn."""
    kept = importance_resample(docs, labels).filter("kept").select(F.col("doc_id").alias("_cl_id"), F.col("th").alias("_cl_th")).distinct()
    key = F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_cl_th"))
    return docs.join(kept, key, "left_semi")
