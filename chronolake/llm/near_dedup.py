"""Near-duplicate components by a chosen-path set similarity join.

Documents with one shingle set are a class, represented by its smallest id.  In each of
``TREES`` independent trees a representative goes to the node of a path of ``PATH``
minwise shingles; two sets of similarity s meet there with probability s^PATH.  A node
of more than ``SMALL`` sets branches again by a minwise value that the node selects, and
one node in ``SECOND`` by a second value: 1.25 branches on average, so that a pair at 0.8
has one node in common to expect at each level of a tree, while rows grow by a quarter a
level on average at most.  A small node is compared exhaustively on 128-value sketches.  At
similarity 0.8 a pair is missed by all trees with probability 0.36^16 (8e-8) where the
first nodes are small, and with 4e-6, 4e-5 and 2e-4 where all of them branch at one, two
and three levels.

Pairs that the sketches allow are candidates.  In a dense node only links to a few hubs
are candidates at first; large nodes link to their hub.  Candidates are confirmed on
full shingle sets, and components are built from confirmed links.  A second round
returns to the dense nodes, and in blocks to large nodes that are little but their hub's
family or have no level left, for the pairs whose documents are not in one component yet: documents outside a node's main
component are compared with all of that component, and with each other, so that no candidate link
between components is skipped, and pairs within a component are never enumerated.

Null and empty texts have no shingles and are linked with nothing.  A row with a null id
is linked with nothing, has no component and is kept.  Rows of one id are one document:
it is linked with whatever any of its texts is linked with.  Texts count as a whole,
whatever their length.  Other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .shingles import mix, shingle_set

TREES = 16
PATH = 2
SKETCH = 128
SMALL = 1024
LEVELS = 8
SECOND = 4  # one large node in so many branches by two values
SALTS = 16
MARGIN = 4  # standard deviations of the sketch's estimate below the threshold
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, TREES * PATH + SKETCH, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, TREES * PATH + SKETCH, dtype=np.uint64).astype(np.uint32)[:, None]


def least_match(threshold: float) -> int:
    """Equal sketch values from which a pair is a candidate."""
    return int(SKETCH * threshold - MARGIN * (SKETCH * threshold * (1 - threshold)) ** 0.5)


def signature(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The first path of each tree, and the sketch of a non-empty set."""
    low = (found ^ (found >> np.uint64(29))).astype(np.uint32)
    m = TREES * PATH
    tokens, best, least = np.zeros(m, np.uint64), np.full(m, 1 << 32, np.uint64), np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096]
        hashed = _A * part + _B
        first = hashed[:m].argmin(axis=1)
        value = hashed[np.arange(m), first]
        better = value < best
        tokens[better], best[better] = found[at + first[better]], value[better]
        np.minimum(least, hashed[m:].min(axis=1), out=least)
    path = tokens[:TREES].copy()
    for k in range(1, PATH):
        path = mix(path * np.uint64(31) + tokens[k * TREES : (k + 1) * TREES])
    return path, ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sign(size: int) -> Callable:
    names = ["id", "n", "digest", "tokens", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n, digests, tokens, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(text, size)
                    n.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    t, s = signature(found) if len(found) else (None, None)
                    tokens.append(None if t is None else t.view(np.int64))
                    sketches.append(s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names)

    return run


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []

    def value(batch: pa.RecordBatch, k: int) -> tuple:
        return tuple(batch.column(c)[k].as_py() for c in range(keys))

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if held and (a or value(held[-1], 0) != value(batch, 0)):
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def allowed_pairs(sizes: np.ndarray, sketches: np.ndarray, threshold: float, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that sizes and sketches allow; with rows, only those of these rows with others."""
    least, n = least_match(threshold), len(sizes)
    for i in range(n - 1) if rows is None else rows.tolist():
        first = i + 1 if rows is None else 0
        fits = first + np.flatnonzero((sizes[first:] * threshold <= sizes[i] + 1e-9) & (sizes[first:] + 1e-9 >= sizes[i] * threshold))
        if len(fits):
            near = fits[(sketches[fits] == sketches[i]).sum(axis=1) >= least]
            if len(near):
                yield np.full(len(near), i), near


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64())])


def pair_batches(found: Iterator[tuple[np.ndarray, np.ndarray, int | None]]) -> Iterator[pa.RecordBatch]:
    """a < b of candidate pairs; a node in their place marks one that is to be visited again."""
    held, count = [], 0

    def flush() -> pa.RecordBatch:
        a, b, node = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(node, mask=node == 0)], schema=PAIRS)

    for a, b, node in found:
        held.append((a, b, np.full(len(a), node or 0, np.int64)))
        count += len(a)
        if count > 20_000:
            yield flush()
            held, count = [], 0
    if held:
        yield flush()


def compare_small(threshold: float) -> Callable:
    """node, id, n, sketch, sorted by node: candidate pairs of each node."""

    def in_node(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        ids, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        found = list(allowed_pairs(sizes, sketches_of(batch.column(3)), threshold))
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a) <= 4 * len(ids):
            yield ids[a], ids[b], None
            return
        # dense: each document with its first few neighbours of highest degree, the rest when components are known
        degree = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((y, -degree[y], x))
        x, y = x[order], y[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        first = rank < 2
        yield ids[x[first]], ids[y[first]], None
        yield np.zeros(1, np.int64), np.zeros(1, np.int64), batch.column(0)[0].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pair_batches(p for group in groups(batches, 1) if len(group) > 1 for p in in_node(group))

    return run


def compare_across(threshold: float, size: int, percent: int) -> Callable:
    """g, ob, rb, id, n, sketch, comp, role, packed, sorted by the first three: confirmed links of a row of role 1 with a row of role 0 of another component."""

    def in_block(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        ids, sizes, comps, role = (batch.column(k).to_numpy() for k in (3, 4, 6, 7))
        asking = np.flatnonzero(role == 1)
        if len(asking) in (0, len(ids)):
            return
        unpack = zstandard.ZstdDecompressor().decompress
        sets: dict[int, np.ndarray] = {}

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(unpack(batch.column(8)[k].as_py()), size)
            return sets[k]

        for a, b in allowed_pairs(sizes, sketches_of(batch.column(5)), threshold, asking):
            b = b[(role[b] == 0) & (comps[b] != comps[a[0]])]
            found = [k for k in b.tolist() if linked(full(int(a[0])), full(k), percent)]
            if found:
                yield np.repeat(ids[a[:1]], len(found)), ids[found], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pair_batches(p for group in groups(batches, 3) for p in in_block(group))

    return run


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def near_hub(threshold: float) -> Callable:
    """node, id, hub, sketch, hub_sketch, more -> node, id, hub, more and whether the sketches allow a link with the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                same = (sketches_of(batch.column(3)) == sketches_of(batch.column(4))).sum(axis=1) >= least_match(threshold)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[5:], pa.array(same)], [*batch.schema.names[:3], *batch.schema.names[5:], "near"])

    return run


def confirm(size: int, percent: int) -> Callable:
    """a, b and both packed texts: the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[bytes, np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor().decompress

        def full(doc: int, packed: bytes) -> np.ndarray:
            known = last.get(doc)
            if known is None or known[0] != packed:
                if len(last) > 200:
                    last.clear()
                known = last[doc] = (packed, shingle_set(unpack(packed), size))
            return known[1]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                keep.append(linked(full(a, x), full(b, y), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(x) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "packed"])


def components(links: DataFrame) -> DataFrame:
    """id and comp (the smallest id reachable) of every id in links (a, b), by alternating large and small stars."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # done once each id has either one smaller neighbour and no larger one, or none smaller
        down, up = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        if both.groupBy("u").agg(down.alias("down"), up.alias("up")).filter("down > 1 or down = 1 and up > 0").isEmpty():
            break
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialize(pairs.distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def salted_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows, which may have any number of one key, joined with few, which has each key once."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def node_sizes(rows: DataFrame) -> DataFrame:
    """node, m, hub of the nodes of more than one row; of small nodes with the same ids only one, since the others have the same pairs."""
    parts = [part for seed in (5, 6) for h in [F.xxhash64("id", F.lit(seed))] for part in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = {f"_s{k}": F.sum(part) for k, part in enumerate(parts)}
    found = rows.groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("hub"), *(x.alias(n) for n, x in sums.items())).filter("m > 1")
    # a large node is told apart by its own number: it branches by values that this selects
    own = F.when(F.col("m") > SMALL, F.col("node")).alias("_own")
    return found.groupBy("m", "hub", *sums, own).agg(F.min("node").alias("node")).select("node", "m", "hub")


def links_of(signed: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id and comp of the representatives that have confirmed links.  docs: id, text."""
    threshold = percent / 100
    rep = signed.filter("n > 0 and id is not null").groupBy("digest").agg(F.min_by(F.struct("id", "n", "tokens", "sketch"), "id").alias("r"))
    own = materialize(rep.select("r.*"), "own")
    lean = own.select("id", "n", "sketch")

    rows = own.select("id", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "id")
    small, hubs, families, level = [], [], [], 0
    while True:
        rows = materialize(rows.join(node_sizes(rows), "node").select("node", "id", "m", "hub"), f"level{level}")
        small.append(rows.filter(F.col("m") <= SMALL).select("node", "id"))
        large = rows.filter(F.col("m") > SMALL)
        if large.isEmpty():
            break
        level += 1
        hub = lean.select(F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch"))
        values = [F.substr("sketch", F.pmod(F.col("node") + k * 61, F.lit(SKETCH)).cast("int") + 1, F.lit(1)).alias(f"v{k}") for k in (0, 1)]
        flagged = large.join(lean, "id").join(hub, "hub").select("node", "id", "hub", "sketch", "hub_sketch", *values).mapInArrow(near_hub(threshold), "node bigint, id bigint, hub bigint, v0 binary, v1 binary, near boolean")
        flagged = materialize(flagged, f"hubs{level}")
        hubs.append(flagged.filter("near and id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.lit(None).cast("bigint").alias("node")))
        # a node that is little but its hub's family needs no more branching: the others ask all its rows in the second round
        kinds = flagged.groupBy("node").agg((F.count_if(~F.col("near")) * 8 <= F.count("*")).alias("family"))
        split = materialize(flagged.select("node", "id", "v0", "v1").join(kinds, "node"), f"split{level}")
        families.append(split if level == LEVELS else split.filter("family"))
        if level == LEVELS:
            break
        branch = F.explode(F.sequence(F.lit(0), F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SECOND)) == 0, 1).otherwise(0)))
        wide = split.filter("not family").select("node", "id", "v0", "v1", branch.alias("branch"))
        rows = wide.select(F.xxhash64("node", "branch", F.when(F.col("branch") == 0, F.col("v0")).otherwise(F.col("v1"))).alias("node"), "id")

    nodes = small[0]
    for more in small[1:]:
        nodes = nodes.unionByName(more)
    by_node = nodes.join(lean, "id").select("node", "id", "n", "sketch").repartition("node").sortWithinPartitions("node", "id")
    found = by_node.mapInArrow(compare_small(threshold), "a bigint, b bigint, node bigint")
    for more in hubs:
        found = found.unionByName(more)
    found = materialize(found, "found")
    pairs = materialize(found.filter("node is null and a <> b").select("a", "b").distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    for more in families:
        needed = needed.unionByName(more.select("id"))
    needed = needed.distinct()
    # the ids have no proven bound, so they are never broadcast
    texts = materialize(docs.join(needed.hint("merge"), "id", "left_semi").select("id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "id bigint, packed binary").join(lean, "id"), "texts")

    x, y = texts.select(F.col("id").alias("a"), F.col("packed").alias("x")), texts.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    links = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirm(size, percent), "a bigint, b bigint"), "links")
    comps = components(links)

    # dense nodes again, and nodes that are still large, for pairs across components
    again = nodes.join(found.filter("node is not null").select("node").distinct(), "node", "left_semi").select("node", "id")
    for more in families:
        again = again.unionByName(more.select("node", "id"))
    known = again.join(comps, "id", "left").select("node", "id", F.coalesce("comp", "id").alias("comp"))
    tally = known.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    open_nodes = tally.filter(F.col("top.c") < F.col("all")).select("node", F.col("top.comp").alias("main"))
    outside = materialize(salted_join(known, open_nodes, "node").filter("comp <> main"), "outside")
    if outside.isEmpty():
        return comps
    # who asks whom: those outside ask the node's main component as a whole, once, and each other
    asks = outside.select(F.xxhash64("main", F.lit("component")).alias("g"), "id", "comp", "main").distinct()
    mains = asks.select("g", F.col("main").alias("comp")).distinct()
    whole = salted_join(own.select("id").join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), mains, "comp").select("g", "id", "comp")
    among = outside.select(F.col("node").alias("g"), "id", "comp")
    roles = asks.select("g", "id", "comp", F.lit(1).alias("role")).unionByName(whole.withColumn("role", F.lit(0))).unionByName(among.withColumn("role", F.lit(1))).unionByName(among.withColumn("role", F.lit(0)))
    sizes = roles.groupBy("g").agg(F.ceil(F.count_if(F.col("role") == 0) / SMALL).cast("int").alias("rbs"), F.ceil(F.count_if(F.col("role") == 1) / SMALL).cast("int").alias("obs"))
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = salted_join(roles, sizes, "g")
    asking = sized.filter("role = 1").withColumn("ob", block("obs")).withColumn("rb", all_of("rbs"))
    asked = sized.filter("role = 0").withColumn("rb", block("rbs")).withColumn("ob", all_of("obs"))
    columns = ["g", "ob", "rb", "id", "comp", "role"]
    blocks = asking.select(*columns).unionByName(asked.select(*columns)).join(texts, "id")
    blocks = blocks.select("g", "ob", "rb", "id", "n", "sketch", "comp", "role", "packed").repartition("g", "ob", "rb").sortWithinPartitions("g", "ob", "rb", "role", "id")
    found = materialize(blocks.mapInArrow(compare_across(threshold, size, percent), "a bigint, b bigint, node bigint").select("a", "b"), "more")
    if found.isEmpty():
        return comps
    return components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(found))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Documents are linked at 100 * intersection >= percent * union of their sets of
    distinct shingles of ``shingle`` words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(rows.mapInArrow(sign(shingle), "id bigint, n bigint, digest binary, tokens array<bigint>, sketch binary"), "signed")
    comps = links_of(signed, rows, shingle, percent)
    classes = signed.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    named = signed.select("id", "n", "digest").join(classes, "digest", "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    out = named.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id stays."""
    kept = near_dedup(docs, shingle, percent).filter("kept").select(F.col("doc_id").alias("_cl_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_cl_id")), "left_semi")
