"""Toxicity by a linear classifier with a counterfactual penalty.

Features are the distinct words of a text and their beginnings of 4 to 7 letters, and
that two or three words share such a beginning, hashed to ``BUCKETS`` buckets.  The
weights minimise the logistic loss on labelled texts, an L1 penalty, and for each
labelled text that holds a term the squared change of its score (log odds) when the terms
in it are swapped for others of their kind: mentioning a group then moves no score, and
neutral mentions are no false positives.

Terms are given, by kind (``IDENTITY_TERMS``), and learned: of the words of the labelled
texts that stand in toxic and clean ones alike (their share of toxic texts is within one
standard deviation of all), the ``LEARNED`` most frequent, neighbours by frequency as one
kind.  So the penalty acts where no text names a group of the list, too.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the least
hash of the id and one row for each id.  Only buckets that tell toxic from clean texts
(``SCREEN`` standard deviations) or in which a text differs from its counterfactual are
fitted; they are chosen by sums over these rows, and the rows reach the driver as those
buckets alone.  All rows are scored on their whole texts.  Null and empty texts get the
score of a text without words.  Rows with a null id are scored and count as an empty id
for the fold; repeated rows are each scored; labels with a null id, null label or no
document are not used, and an id labelled twice is toxic if any of its labels is.
Without labels of both kinds every score is the share of toxic ones (0.5 where there is
none).  Other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache import Cache
from .features import dense, fold, sample_rows, sparse_sums
from .scratch import materialize
from .shingles import mix

BUCKETS = 1 << 20
TRAIN_ROWS = 8_000
CHUNK = 1 << 18
STEPS = 400
L1 = 1e-5
STILL = 1e-5  # a step that moves no weight by more is the last
SCREEN = 3.0
COUNTERFACTUAL = 1.0
LEARNED = 64
KIND = 4  # learned terms of one kind
LEVELS = (2, 3)
#: Identity terms by kind, each swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrant", "citizen"), ("immigrants", "citizens"),
    ("deaf", "hearing"), ("blind", "sighted"), ("disabled", "able"), ("old", "young"),
)
WORDS = re.compile(r"\w+")


def word_parts(word: str) -> bytes:
    parts = [f"={word}", *(word[:k] for k in range(4, min(7, len(word)) + 1))]
    return np.array([xxhash.xxh3_64_intdigest(x) for x in parts], np.uint64).tobytes()


_words = Cache(word_parts, 150_000)


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features(words: set[str]) -> np.ndarray:
    """Sorted buckets of the words, of their beginnings, and of beginnings that several words share."""
    found, n = np.unique(np.frombuffer(b"".join(map(_words.__getitem__, words)), np.uint64), return_counts=True)
    shared = [mix(found[n >= k] * np.uint64(2 * k + 1)) for k in LEVELS]
    return np.unique(np.concatenate([found, *shared]) & np.uint64(BUCKETS - 1)).astype(np.int32)


def swaps(terms: Sequence[Sequence[str]]) -> dict[str, str]:
    """Each term and the next of its kind; a term of several kinds goes by the first."""
    out: dict[str, str] = {}
    for kind in terms:
        for k, x in enumerate(kind):
            out.setdefault(x, kind[(k + 1) % len(kind)])
    return out


def swapped(words: set[str], swap: dict[str, str]) -> set[str] | None:
    """The words with each term as the next of its kind; None if there is none."""
    return {swap.get(x, x) for x in words} if words & swap.keys() else None


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label -> word, n, toxic: in how many texts a word of at least 4 letters stands."""
    for batch in batches:
        n: Counter = Counter()
        toxic: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = [x for x in words_of(text) if len(x) > 3]
            n.update(words)
            if label:
                toxic.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[x] for x in n], pa.int64())], ["word", "n", "toxic"])


def learned_terms(marked: DataFrame, share: float, most: int = LEARNED, kind: int = KIND) -> list[tuple[str, ...]]:
    """Kinds of the most frequent words that mark neither toxic nor clean texts, of the labelled rows alone."""
    seen = marked.select("text", "label").mapInArrow(count_words, "word string, n bigint, toxic bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    usual = F.abs(F.col("toxic") - F.col("n") * share) <= F.sqrt(F.col("n") * share * (1 - share))
    words = [r.word for r in seen.filter(usual & (F.col("toxic") >= 2) & (F.col("n") > F.col("toxic"))).orderBy(F.col("n").desc(), "word").limit(most).collect()]
    return [tuple(words[k : k + kind]) for k in range(0, len(words), kind) if len(words[k : k + kind]) > 1]


def count_buckets(swap: dict[str, str]) -> Callable:
    """text, label -> bucket and in how many texts it stands, in how many toxic ones, and in how many it differs from the counterfactual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic, moved = (np.zeros(BUCKETS, np.int64) for _ in range(3))
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                own, twin = features(words), swapped(words, swap)
                n[own] += 1
                toxic[own] += label
                if twin is not None:
                    moved[np.setxor1d(own, features(twin), assume_unique=True)] += 1
        yield from sparse_sums({"n": n, "toxic": toxic, "moved": moved})

    return run


def collect_features(swap: dict[str, str], kept: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.zeros(BUCKETS, bool)
        inside[kept] = True
        pack = lambda x: x[inside[x]].tobytes()
        for batch in batches:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                own.append(pack(features(words)))
                twin = swapped(words, swap)
                other.append(None if twin is None else pack(features(twin)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.binary()), pa.array(other, pa.binary())], ["doc_id", "label", "own", "other"])

    return run


def screened(n: np.ndarray, toxic: np.ndarray, moved: np.ndarray, share: float) -> np.ndarray:
    """The buckets that are fitted."""
    spread = np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    return np.flatnonzero(((np.abs(toxic - n * share) >= SCREEN * spread) & (n >= 3)) | ((moved > 0) & (n >= 2)))


class Rows:
    """Sparse rows of ones; products go by runs of rows of about CHUNK entries, so that none is as large as all rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.index = np.concatenate([*rows, np.empty(0, np.int32)], dtype=np.int32, casting="unsafe")
        self.starts = np.cumsum([0, *map(len, rows)])
        cuts = np.searchsorted(self.starts, np.arange(0, self.starts[-1], CHUNK))
        self.runs = np.unique([0, *cuts, len(rows)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = [np.empty(0)]
        for a, b in zip(self.runs, self.runs[1:]):
            at = self.starts[a : b + 1]
            ends = np.concatenate([[0.0], np.cumsum(w[self.index[at[0] : at[-1]]])])
            out.append(np.diff(ends[at - at[0]]))
        return np.concatenate(out)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for a, b in zip(self.runs, self.runs[1:]):
            at = self.starts[a : b + 1]
            out += np.bincount(self.index[at[0] : at[-1]], np.repeat(g[a:b], np.diff(at)), n)
        return out


def fit(labels: np.ndarray, own: list[np.ndarray], other: list[np.ndarray | None], steps: int = STEPS, l1: float = L1, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, by accelerated proximal gradient steps."""
    n = len(labels)
    if n == 0 or labels.min() == labels.max() or not any(map(len, own)):
        p = labels.mean() if n else 0.5
        return np.zeros(BUCKETS), float(np.log((p + 1e-3) / (1 - p + 1e-3)))
    seen = np.zeros(BUCKETS, np.int64)
    for r in own:
        seen[r] += 1
    often = np.flatnonzero(seen >= min(2, seen.max()))
    m = len(often)
    place = np.full(BUCKETS, -1, np.int32)
    place[often] = np.arange(m)
    within = lambda x: (p := place[x])[p >= 0]
    x = Rows([within(r) for r in own])
    pairs = [k for k, r in enumerate(other) if r is not None]
    a, b = Rows([within(own[k]) for k in pairs]), Rows([within(other[k]) for k in pairs])
    w, v, bias, vbias, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    # the step follows the curvature along each feature, bounded by the documents' lengths
    share = np.bincount(x.index, minlength=m) / n
    curve = 0.25 * np.sqrt(share) * np.sqrt(np.diff(x.starts).mean() * share.max() + 1) + 0.05
    if pairs:
        # a bound of the penalty's curvature along each feature
        change = [np.setxor1d(within(own[k]), within(other[k])) for k in pairs]
        sizes = np.repeat([len(c) for c in change], [len(c) for c in change])
        curve = curve + 2 * counterfactual / len(pairs) * np.bincount(np.concatenate(change), sizes, m)
    step = 1.0 / curve
    for _ in range(steps):
        z = x.dot(v) + vbias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        g = x.back(error, m)
        if pairs:
            change = 2 * counterfactual * (a.dot(v) - b.dot(v)) / len(pairs)
            g += a.back(change, m) - b.back(change, m)
        moved = v - step * g
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
        new_bias = vbias - error.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vbias = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        still = max(np.abs(new - w).max(initial=0), abs(new_bias - bias)) < STILL
        w, bias, t = new, new_bias, after
        if still:
            break
    out = np.zeros(BUCKETS)
    out[often] = w
    return out, float(bias)


def score_texts(places: np.ndarray, weights: np.ndarray, bias: float) -> Callable:
    """Scores by the few buckets whose weight isn't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS)
        full[places] = weights
        for batch in batches:
            z = [float(full[features(words_of(x))].sum()) + bias for x in batch.column(2).to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None], list[tuple[str, ...]]]:
    """Labels, buckets and counterfactual buckets (None: no term) of the training rows, and all terms.  docs: doc_id, text; labels: doc_id, label."""
    known = labels.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    some = sample_rows(known, "doc_id", TRAIN_ROWS)
    # at most TRAIN_ROWS labels; of an id's texts one
    marked = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    marked = materialize(marked.select("text", "doc_id", "label"), "marked")
    seen = marked.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).head()
    share = (seen.toxic or 0) / max(1, seen.n)
    every = [*map(tuple, terms), *learned_terms(marked, share)]
    swap = swaps(every)
    sums = dense(marked.select("text", "label").mapInArrow(count_buckets(swap), "bucket bigint, n bigint, toxic bigint, moved bigint"), ["n", "toxic", "moved"], BUCKETS)
    packed = marked.mapInArrow(collect_features(swap, screened(*sums, share)), "doc_id bigint, label int, own binary, other binary")
    found = packed.toPandas().sort_values("doc_id")
    unpack = lambda x: None if x is None else np.frombuffer(x, np.int32)
    return found["label"].to_numpy(float), list(map(unpack, found["own"])), list(map(unpack, found["other"])), every


def swap_change(weights: np.ndarray, own: list[np.ndarray], other: list[np.ndarray | None]) -> tuple[int, float]:
    """How many texts have a counterfactual, and by how much its log odds differ on average."""
    change = [abs(weights[a].sum() - weights[b].sum()) for a, b in zip(own, other) if b is not None]
    return len(change), float(np.mean(change)) if change else 0.0


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, held_out: Column, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    train and held_out are conditions on a column ``doc_id``; labels of rows where train
    isn't true are never read.
    """
    ids = F.col(id_col).cast("long").alias("doc_id")
    rows = docs.select(ids, F.col(text_col).alias("text"))
    known, own, other, _ = learn(rows, labels.select(ids, F.col(label_col).cast("int").alias("label")).filter(train), terms)
    weights, bias = fit(known, own, other)
    places = np.flatnonzero(weights)
    scored = rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(score_texts(places, weights[places], bias), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxic_fold(doc_id: Column) -> Column:
    return fold(doc_id, 5)
