"""Removal of repeated byte strings by a sparse suffix array over sampled splitters.

A string of ``length`` bytes is removed where it also starts earlier.  Only suffixes at
anchors are sorted: the anchor of a string is its leftmost position with the least hash
of ``GRAM`` bytes, so equal strings have their anchor at the same place, and a string
is known by its anchor's suffix and the bytes before it.  An anchor owns the run of
string starts of which it is the anchor.

1. Anchors are found in each task, with the ``GRAM`` bytes that follow, as eight-byte
   characters, and a hash of all bytes that their own strings cover.  Of anchors that
   agree in all of it the task sends the first only; the strings of the others are
   repeats already.
2. Sampled splitters of ``GRAM`` bytes, weighted quantiles of a bounded sample of
   anchors, deal the suffixes to range buckets of about ``BUCKET_BYTES`` of text.  A
   bucket sorts by multikey quicksort on eight-byte characters: runs of equals are sorted
   by their next character.  Splitters never part suffixes that agree in all characters,
   so what would be compared across a boundary differs there before its end.
3. Of neighbours with equal own bytes all but the first are repeats.  Anchors with the
   same characters and other surroundings send their own bytes to a second exchange,
   where their strings are compared one by one; a group too large for one task is dealt
   by string instead.
4. Repeated starts are merged for each document, and the bytes under them removed.

Suffixes that agree in ``GRAM`` bytes are in no order of their further bytes: they are
told apart by the hash of their own bytes (64 bits), and strings by 128-bit hashes.

Nulls count as empty texts.  Order is by id (null first), then by a hash of the text;
rows that agree in both are one document and get the same result.  Texts count as a
whole, whatever their length (a task holds one text at a time).  Other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .shingles import mix

GRAM = 32
CHARACTERS = GRAM // 8
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 20_000
SAMPLE_DOCS = 2000
SAMPLE_ANCHORS = 64  # of each sampled document
LARGE_NODE = 5000
NULL_ID = -(1 << 63)
_W = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number."""
    n = len(text) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= text[k : n + k]
    return out


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """at, first, last and the characters of the anchors of a text of at least length bytes: position, own string starts (inclusive), GRAM bytes by eight."""
    lead = eights(text)
    m = len(text) - GRAM + 1
    gram = lead[:m] * _W[0]
    for k in range(1, CHARACTERS):
        gram = mix(gram ^ (lead[8 * k : m + 8 * k] * _W[k]))
    # the least hash in each window of grams, leftmost of equals, by doubling
    best = ((gram >> np.uint64(32)) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    of = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(of) - 1]])
    at = of[first]
    return at, first, last, *(lead[at + 8 * k] for k in range(CHARACTERS))


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by keys as characters: quicksort on the first, and runs of equals on the next."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.ones(len(order), bool)
    group = np.zeros(len(order), np.int64)
    for depth, key in enumerate(keys[1:], 1):
        before = keys[depth - 1][order]
        fresh = np.concatenate([[True], before[1:] != before[:-1]]) | np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(fresh)
        sizes = np.bincount(group)
        tied = sizes[group] > 1
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        rows = order[spots]
        inner = np.argsort(key[rows], kind="stable")
        inner = inner[np.argsort(group[spots][inner], kind="stable")]
        order[spots] = rows[inner]
    return order


#: What is sent of an anchor; documents are numbered within a block.
FIELDS = [*((f"c{k}", np.uint64) for k in range(CHARACTERS)), ("own", np.uint64), ("at", np.uint32), ("number", np.uint32), ("back", np.uint16), ("front", np.uint16)]


def packed(columns: tuple[np.ndarray, ...]) -> bytes:
    """A block of the characters, own, doc, th, at, back, front of some anchors."""
    *characters, own, doc, th, at, back, front = columns
    both, number = np.unique(np.stack([doc, th], axis=1), axis=0, return_inverse=True)
    body = b"".join(np.ascontiguousarray(c.astype(t)).tobytes() for c, (_, t) in zip((*characters, own, at, number.ravel(), back, front), FIELDS))
    return zstandard.ZstdCompressor(level=1).compress(len(own).to_bytes(8, "little") + body + both.tobytes())


def unpacked(block: bytes) -> tuple[np.ndarray, ...]:
    """What packed() was given."""
    body = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(body[:8], "little"), 8, {}
    for name, t in FIELDS:
        out[name] = np.frombuffer(body, t, n, at)
        at += n * np.dtype(t).itemsize
    doc, th = np.frombuffer(body, np.int64, -1, at).reshape(-1, 2)[out["number"]].T
    return *(out[f"c{k}"] for k in range(CHARACTERS)), out["own"], doc, th, *(out[x].astype(np.int64) for x in ("at", "back", "front"))


def as_bytes(characters: list[np.ndarray]) -> np.ndarray:
    """The characters of each row as one string of GRAM bytes, in their order."""
    return np.ascontiguousarray(np.stack(characters, axis=1).astype(">u8")).view(f"S{GRAM}").ravel()


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def starts_batches(doc: np.ndarray, th: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
    """One row for each document: its repeated starts as packed pairs (low, high)."""
    order = np.lexsort((low, th, doc))
    doc, th, low, high = doc[order], th[order], low[order], high[order]
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])) + 1
    edges = [0, *cuts.tolist(), len(doc)]
    pairs = np.stack([low, high], axis=1).astype("<i4")
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(doc[a]), int(th[a]), pairs[a:b].tobytes()


def runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before."""
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def sorted_once(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The suffixes in order, with each (doc, th, at) once: rows that are one document don't repeat each other."""
    *characters, own, doc, th, at, _, _ = columns
    order = multikey_order([*characters, own, unsigned(doc), unsigned(th), at])
    columns = tuple(x[order] for x in columns)
    return tuple(x[runs_of(list(columns[:-2]))] for x in columns)


def find_anchors(length: int, splitters: list[bytes]) -> Callable:
    """doc, th, text -> bucket with a block of anchors, or with doc, th and starts that are repeats within the task's batch."""
    names = ["bucket", "block", "doc", "th", "starts"]
    ends = np.array(splitters, f"S{GRAM}")

    def flush(docs: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = []
        digest = xxhash.xxh3_64_intdigest
        for doc, th, text in docs:
            if len(text) < length:
                continue
            at, first, last, *characters = anchors(np.frombuffer(text, np.uint8), length)
            view, n = memoryview(text), len(at)
            own = np.fromiter((digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, n)
            back, front = at - first, at - last
            # the anchor's place in its own bytes belongs to their identity
            own ^= mix((back * 65536 + front).astype(np.uint64))
            parts.append((*characters, own, np.full(n, doc), np.full(n, th), at, back, front))
        if not parts:
            return
        columns = sorted_once(tuple(np.concatenate(x) for x in zip(*parts)))
        *_, doc, th, at, back, front = columns
        fresh = runs_of(list(columns[: CHARACTERS + 1]))
        again = ~fresh
        rows = [(int(d % (len(ends) + 1)), None, d, t, x) for d, t, x in starts_batches(doc[again], th[again], (at - back)[again], (at - front)[again])]
        columns = tuple(x[fresh] for x in columns)
        # where each bucket begins among the sorted suffixes
        edges = [0, *np.searchsorted(as_bytes(list(columns[:CHARACTERS])), ends).tolist(), len(columns[0])]
        rows += [(k, packed(tuple(c[x:y] for c in columns)), None, None, None) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 5000]), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                held.append((doc, th, text))
                size += len(text)
                if size > BATCH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return run


#: Kinds of rows from sort_bucket: repeats, anchors to compare by bytes, anchors of a node too large for one task.
REPEAT, ASK, ASK_LARGE = 0, 1, 2


def sort_bucket(most: int = LARGE_NODE) -> Callable:
    """bucket, block, doc, th, starts, sorted by bucket -> kind, doc, th, starts (repeated starts or packed anchors)."""
    names = ["kind", "doc", "th", "starts"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def bucket(blocks: list[bytes]) -> Iterator[tuple]:
        columns = sorted_once(tuple(np.concatenate(x) for x in zip(*map(unpacked, blocks))))
        *_, doc, th, at, back, front = columns
        new_gram, new_own = runs_of(list(columns[:CHARACTERS])), runs_of(list(columns[: CHARACTERS + 1]))
        for row in starts_batches(doc[~new_own], th[~new_own], (at - back)[~new_own], (at - front)[~new_own]):
            yield REPEAT, *row
        group = np.cumsum(new_gram) - 1
        classes = np.bincount(group, weights=new_own)[group]
        for kind, ask in ((ASK, new_own & (classes > 1) & (classes <= most)), (ASK_LARGE, new_own & (classes > most))):
            if ask.any():
                node = np.zeros(int(ask.sum()), np.uint64)
                for c, w in zip(columns[:CHARACTERS], _W):
                    node = mix(node * w + c[ask])
                node = node.view(np.int64)
                asks = [node, doc[ask], th[ask], at[ask], back[ask], front[ask]]
                o = np.lexsort((asks[3], asks[2], asks[1]))
                node, d, t, x, y, z = (c[o] for c in asks)
                edges = np.flatnonzero(np.concatenate([runs_of([d, t]), [True]]))
                body = np.stack([node, x, y, z], axis=1)
                for a, b in zip(edges, edges[1:]):
                    yield kind, int(d[a]), int(t[a]), body[a:b].tobytes()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, last = [], None
        for batch in batches:
            for k, block, doc, th, starts in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None:
                    yield REPEAT, doc, th, starts
                    continue
                if k != last and held:
                    yield from bucket(held)
                    held = []
                last = k
                held.append(block)
        if held:
            yield from bucket(held)

    return lambda batches: in_batches(rows_of(batches), kinds, names)


def in_batches(rows: Iterator[tuple], kinds: tuple, names: list[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column compressed, to be shuffled."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = pa.array([press(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """node, doc, th, first start, place of the anchor and own bytes, of doc, th, asks and packed text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc, th, asks, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack(text)
            for ask in asks:
                for node, at, back, front in np.frombuffer(ask, np.int64).reshape(-1, 4).tolist():
                    yield node, doc, th, at - back, back, front, text


def cut_own(length: int) -> Callable:
    names, kinds = ["node", "doc", "th", "first", "back", "body"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cut = lambda rows: ((n, d, t, first, back, text[first : first + back - front + length]) for n, d, t, first, back, front, text in rows)
    return lambda batches: in_batches(cut(asked(batches)), kinds, names)


def cut_strings(length: int) -> Callable:
    """A row for each string: its 128-bit hash in two halves, the anchor's place in it, and where it starts."""
    names, kinds = ["h", "l", "place", "doc", "th", "start"], (pa.int64(),) * 6

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, doc, th, first, back, front, text in rows:
            view = memoryview(text)
            for k in range(back - front + 1):
                h, low = np.frombuffer(xxhash.xxh3_128_digest(view[first + k : first + k + length]), np.int64).tolist()
                yield h, low, back - k, doc, th, first + k

    return lambda batches: in_batches(cut(asked(batches)), kinds, names)


def compare_strings(length: int) -> Callable:
    """Rows of cut_own sorted by node, doc, th, first: what is seen again among the strings of one node."""
    names, kinds = ["doc", "th", "starts"], (pa.int64(), pa.int64(), pa.binary())

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: set = set()
        node, before = None, None
        digest = xxhash.xxh3_128_digest
        found: list[list[int]] = []
        for batch in batches:
            for own, doc, th, first, back, body in zip(*(c.to_pylist() for c in batch.columns)):
                if own != node:
                    seen, node = set(), own
                if (own, doc, th, first) == before:
                    continue
                before = (own, doc, th, first)
                view = memoryview(body)
                for k in range(len(body) - length + 1):
                    key = digest(view[k : k + length]) + (back - k).to_bytes(2, "little")
                    if key not in seen:
                        seen.add(key)
                    elif found and found[-1][:2] == [doc, th] and found[-1][3] == first + k - 1:
                        found[-1][3] += 1
                    else:
                        found.append([doc, th, first + k, first + k])
                if len(found) > 50_000:
                    yield from starts_batches(*map(np.array, zip(*found)))
                    found = []
        if found:
            yield from starts_batches(*map(np.array, zip(*found)))

    return lambda batches: in_batches(repeats(batches), kinds, names)


def single_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packs = [np.repeat(np.array(x, "<i4"), 2).tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packs, pa.binary())], ["doc", "th", "starts"])


def remove(length: int) -> Callable:
    """doc_id, text, starts -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans: list[list[int]] = []
                if starts:
                    pairs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in starts])
                    for low, high in sorted(pairs.tolist()):
                        if spans and low <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], high + length)
                        else:
                            spans.append([low, high + length])
                text = unpack(text)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds))], names)

    return run


def sample_anchors(length: int) -> Callable:
    """text -> some of its anchors' bytes, and how many anchors each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(text) >= length:
                    _, _, _, *characters = anchors(np.frombuffer(text, np.uint8), length)
                    n = len(characters[0])
                    some = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_ANCHORS)).astype(np.int64))
                    found = np.stack([c[some] for c in characters], axis=1).astype(">u8")
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array(np.full(len(some), n / len(some)))], ["gram", "weight"])

    return run


def splitters_of(sample: list[tuple[bytes, float]], n: int) -> list[bytes]:
    """At most n - 1 splitters that part the sample's weight evenly."""
    sample = sorted(sample)
    passed = np.cumsum([w for _, w in sample])
    spots = np.searchsorted(passed, passed[-1] * np.arange(1, n) / n) if sample else []
    return sorted({sample[k][0] for k in spots})


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end, begin, end ... in bytes) of each row."""
    if not GRAM <= length < 1 << 16:
        raise ValueError(f"length must be from {GRAM} to 65535")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))

    # splitters from a bounded sample of documents; results don't depend on them
    held = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    n = buckets or max(8, min(MOST_BUCKETS, -(-held // BUCKET_BYTES)))
    sample = rows.filter(F.pmod(F.xxhash64("th", F.lit(11)), F.lit(64)) == 0).select("text").limit(SAMPLE_DOCS)
    splitters = splitters_of([tuple(x) for x in sample.mapInArrow(sample_anchors(length), "gram binary, weight double").collect()], n)

    starts = "doc bigint, th bigint, starts binary"
    dealt = rows.select("doc", "th", "text").mapInArrow(find_anchors(length, splitters), f"bucket int, block binary, {starts}")
    judged = materialize(dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(sort_bucket(), f"kind int, {starts}"), "judged")

    key = ["doc", "th"]
    texts = rows.select("doc", "th", "text").mapInArrow(pack, "doc bigint, th bigint, text binary")
    asks = lambda kind: judged.filter(F.col("kind") == kind).groupBy(*key).agg(F.collect_list("starts").alias("asks"))
    own = texts.join(asks(ASK), key).select("doc", "th", "asks", "text").mapInArrow(cut_own(length), "node bigint, doc bigint, th bigint, first bigint, back bigint, body binary")
    compared = own.repartition("node").sortWithinPartitions("node", "doc", "th", "first").mapInArrow(compare_strings(length), starts)
    repeats = [judged.filter(F.col("kind") == REPEAT).select("doc", "th", "starts"), materialize(compared, "compared")]
    if not judged.filter(F.col("kind") == ASK_LARGE).isEmpty():
        # by string: the first is an aggregate, and a hot string is a skewed join that Spark splits
        each = texts.join(asks(ASK_LARGE), key).select("doc", "th", "asks", "text").mapInArrow(cut_strings(length), "h bigint, l bigint, place bigint, doc bigint, th bigint, start bigint")
        each = materialize(each, "strings")
        spot = F.struct("doc", "th", "start")
        first = each.groupBy("h", "l", "place").agg(F.min(spot).alias("first"))
        later = each.join(first, ["h", "l", "place"]).filter(spot > F.col("first"))
        repeats.append(materialize(later.groupBy(*key).agg(F.collect_set("start").alias("s")).mapInArrow(single_starts, starts), "later"))
    every = repeats[0]
    for more in repeats[1:]:
        every = every.unionByName(more)
    by_doc = every.groupBy(*key).agg(F.collect_list("starts").alias("starts"))
    whole = rows.select("doc_id", "doc", "th", "text").mapInArrow(pack, "doc_id bigint, doc bigint, th bigint, text binary")
    found = whole.join(by_doc, key, "left").select("doc_id", "text", "starts")
    return found.mapInArrow(remove(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
