"""Language identification by sparse multinomial logistic regression.

Character n-grams of 1 to 3 letters (words in lower case, with a blank at either end)
are hashed to ``BUCKETS`` buckets and weighted by TF-IDF: the share of the n-gram among
all of the text times the logarithm of its rarity.  Document counts cover all rows that
may be learned from.  The weights are trained by follow-the-regularised-leader with
elastic-net penalties on about ``TRAIN_ROWS`` of these rows; as many others set the
temperature by which the log odds are divided, so that the score is a calibrated
probability.  Of each language the rows with the least hash of the id are taken, one for
each id: its share of 2 x ``TRAIN_ROWS``, and ``LEAST`` at least where it has so many.
They reach the driver as packed counts of buckets.

A text that is null or has no letter is ``und`` with score 0.  Rows with a null id are
predicted and count as an empty id for the fold.  Without any row to learn from, all are
``und``.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import dense, fold, sparse_sums

BUCKETS = 1 << 16
TRAIN_ROWS = 4_000
LEAST = 200
PASSES = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
CHUNK = 1 << 16
NO_LETTERS = re.compile(r"[\W\d_]+")


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the character n-grams of a text's words, with repeats; empty without letters."""
    words = NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words:
        return np.empty(0, np.uint16)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.concatenate([x >> np.uint32(16) for x in (one + np.uint32(1), two, three)]).astype(np.uint16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows each bucket occurs; row 0's ``rows`` has the number of rows."""
    df, rows = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        rows[0] += len(batch)
        for text in batch.column(0).to_pylist():
            df[np.unique(ngram_buckets(text))] += 1
    yield from sparse_sums({"df": df, "rows": rows})


def collect_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang, rn, text -> doc_id, lang, rn and the packed buckets of the text with their counts."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = []
        for text in batch.column(3).to_pylist():
            where, n = np.unique(ngram_buckets(text), return_counts=True)
            packed.append(press(np.diff(where, prepend=np.uint16(0)).tobytes() + n.astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["doc_id", "lang", "rn", "packed"])


class Vectors:
    """Packed rows as buckets and their TF-IDF weights, of length 1; unpacked one at a time."""

    def __init__(self, packed: list[bytes], idf: np.ndarray):
        self.packed, self.idf = packed, idf

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        unpack = zstandard.ZstdDecompressor().decompress
        for row in self.packed:
            raw = unpack(row)
            k = len(raw) // 6
            where = np.cumsum(np.frombuffer(raw, np.uint16, k), dtype=np.int64)
            x = np.frombuffer(raw, np.uint32, k, 2 * k) * self.idf[where]
            size = np.sqrt((x * x).sum())
            yield where, x / size if size else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Weights (classes x buckets) by FTRL-proximal; most are exactly zero."""
    z, n = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))

    def weights(where: np.ndarray | slice) -> np.ndarray:
        w = -(z[:, where] - np.sign(z[:, where]) * L1) / ((BETA + np.sqrt(n[:, where])) / ALPHA + L2)
        return np.where(np.abs(z[:, where]) <= L1, 0.0, w)

    for _ in range(passes):
        for (where, x), y in zip(rows, labels):
            w = weights(where)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            rate = (np.sqrt(n[:, where] + g * g) - np.sqrt(n[:, where])) / ALPHA
            z[:, where] += g - rate * w
            n[:, where] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, from a fixed range."""
    if not len(labels):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def shares(counts: dict[str, int]) -> dict[str, int]:
    """How many rows of each language are taken."""
    every = sum(counts.values())
    return {lang: min(n, max(LEAST, round(2 * TRAIN_ROWS * n / every))) for lang, n in counts.items()}


def sampled(known: DataFrame):
    """doc_id, lang, rn (from 1 in each language) and packed counts of the sampled rows on the driver.

    Ids are chosen first, so that no task returns more than is used; texts stay where they are.
    """
    order = F.xxhash64("doc_id", F.lit(5))
    one = known.select("doc_id", "lang", F.xxhash64("text").alias("th")).groupBy("doc_id").agg(F.min(F.struct("lang", "th")).alias("r")).select("doc_id", "r.*")
    counts = {r.lang: r.n for r in one.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.sparkSession.createDataFrame([], "doc_id bigint, lang string, rn int, packed binary").toPandas()
    # hashes below the limit are enough for the share, so that no task sorts a whole language
    wanted = [(lang, k, min(1.0, (2 * k + 200) / counts[lang])) for lang, k in shares(counts).items()]
    wanted = known.sparkSession.createDataFrame(wanted, "_cl_lang string, k long, part double")
    few = one.join(F.broadcast(wanted), F.col("lang") == F.col("_cl_lang")).filter(order / 2.0**64 + 0.5 <= F.col("part"))
    few = few.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))).filter("rn <= k")
    few = few.select(F.col("doc_id").alias("_cl_id"), F.col("lang").alias("_cl_lang"), F.col("th").alias("_cl_th"), "rn")
    same = F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (F.col("lang") == F.col("_cl_lang")) & (F.xxhash64("text") == F.col("_cl_th"))
    found = known.join(F.broadcast(few), same).select("doc_id", "lang", "rn", "text").mapInArrow(collect_counts, "doc_id bigint, lang string, rn int, packed binary")
    return found.groupBy("doc_id", "lang", "rn").agg(F.min("packed").alias("packed")).toPandas().sort_values(["lang", "rn"]).reset_index(drop=True)


def predict(names: list[str], weights: np.ndarray, idf: np.ndarray, heat: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray((weights * idf).T)
        for batch in batches:
            best, scores = [], []
            for text in batch.column(2).to_pylist():
                if not names or not has_letter(text):
                    best.append("und")
                    scores.append(0.0)
                    continue
                found = ngram_buckets(text)
                n = np.bincount(found, minlength=BUCKETS) if len(found) > CHUNK else None
                if n is None:
                    where, k = np.unique(found, return_counts=True)
                else:
                    where, k = np.flatnonzero(n), n[n > 0]
                size = np.sqrt(((k * idf[where]) ** 2).sum())
                p = softmax((k @ table[where]) / (size or 1) / heat)
                best.append(names[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs.

    learn and held_out are conditions on a column ``doc_id``; languages of rows where
    learn isn't true are never read.
    """
    ids = F.col(id_col).cast("long").alias("doc_id")
    known = docs.select(ids, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, rows = dense(known.select("text").mapInArrow(count_documents, "bucket bigint, df bigint, rows bigint"), ["df", "rows"], BUCKETS)
    idf = np.log((1 + rows[0]) / (1 + df)) + 1
    # of each language every other row to train, the first one always, and the rest for the temperature
    some = sampled(known).sample(frac=1, random_state=1)
    names = sorted(some["lang"].unique())
    labels = np.array([names.index(x) for x in some["lang"]], np.int64)
    first = (some["rn"] % 2 == 1).to_numpy(bool)
    weights = train(Vectors(list(some["packed"][first]), idf), labels[first], len(names)) if names else np.zeros((0, BUCKETS))
    logits = np.array([weights[:, where] @ x for where, x in Vectors(list(some["packed"][~first]), idf)])
    heat = temperature(logits, labels[~first]) if names else 1.0
    out = docs.select(ids, F.col(text_col).alias("text")).select("doc_id", held_out.alias("held_out"), "text")
    return out.mapInArrow(predict(names, weights.astype(np.float32), idf.astype(np.float32), heat), "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_fold(doc_id: Column) -> Column:
    return fold(doc_id, 4)
