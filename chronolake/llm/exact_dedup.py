"""Exact deduplication by Patricia tries that own every distinct byte string.

1. Each task inserts its texts into a compressed radix trie, flushed at a byte
   bound, so that a text repeated within a task leaves it once, with its ids.
2. What is left is dealt by (length, content hash), so that a text's copies meet in one
   task.  It inserts the full byte strings into a trie whose terminals keep the
   smallest and the largest id and the number of rows: when the input has ended, each
   terminal gives one row, its class.  A trie over its byte bound spills its heaviest
   subtree: the terminals below it, and all later texts there, go to the shared folder
   and are dealt again for another round, until none is left.
3. Members learn their class by a join on small rows of (SHA-256, ids); no class is
   ever collected.

Nulls count as empty texts.  Rows with a null id take part; they own a class only if
all its ids are null.  Repeated (id, text) rows are all reported, each as kept when
its id is the owner's.  Other columns are ignored, whatever their names.  An empty table
gives an empty result; a text counts with all its bytes against a trie's bound, and one
that is larger than the bound has a trie of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

TRIE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
NODE_BYTES = 200


class Node:
    """An edge label ``source[start:end]``, the children by first byte, the value of a text that ends here, and the bytes held here and below."""

    __slots__ = ("source", "start", "end", "children", "value", "held")

    def __init__(self, source: bytes, start: int, end: int, held: int):
        self.source, self.start, self.end, self.children, self.value, self.held = source, start, end, None, None, held


def common(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], up to most."""
    low = 0
    while low < most:
        step = (most - low + 1) // 2
        if a[i + low : i + low + step] == b[j + low : j + low + step]:
            low += step
        elif step == 1:
            return low
        else:
            most = low + step - 1
    return low


class PatriciaTrie:
    def __init__(self):
        self.root = Node(b"", 0, 0, 0)

    def terminal(self, key: bytes) -> Node:
        """The node at which key ends, made if need be."""
        node, at, n, path = self.root, 0, len(key), []
        while at < n:
            path.append(node)
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                # a leaf keeps all of its key
                child = node.children[key[at]] = Node(key, at, n, n + NODE_BYTES)
                for x in path:
                    x.held += child.held
                return child
            size = child.end - child.start
            if key.startswith(child.source[child.start : child.end], at):
                node, at = child, at + size
                continue
            same = common(child.source, child.start, key, at, min(size, n - at))
            upper = Node(child.source, child.start, child.start + same, child.held + NODE_BYTES)
            child.start += same
            upper.children = {child.source[child.start]: child}
            node.children[key[at]] = upper
            for x in path:
                x.held += NODE_BYTES
            node, at = upper, at + same
        return node

    def cut(self) -> tuple[bytes, Node] | None:
        """Take the heaviest subtree below the first branch out: what is spelled above its node, and the node; None if nothing branches."""
        node, prefix, path = self.root, b"", []
        while node.children and len(node.children) == 1 and node.value is None:
            path.append(node)
            node = next(iter(node.children.values()))
            prefix += node.source[node.start : node.end]
        if not node.children or len(node.children) + (node.value is not None) < 2:
            return None
        child = max(node.children.values(), key=lambda x: x.held)
        del node.children[child.source[child.start]]
        for x in [*path, node]:
            x.held -= child.held
        return prefix, child


def terminals(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    """The texts that end at node or below it, with their values; prefix: what is spelled above it."""
    stack = [(prefix, node)]
    while stack:
        prefix, node = stack.pop()
        key = prefix + node.source[node.start : node.end]
        if node.value is not None:
            yield key, node.value
        stack.extend((key, x) for x in (node.children or {}).values())


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class OwnerTrie:
    """Terminals of (SHA-256, smallest id, largest id, rows); subtrees beyond ``limit`` bytes are given back."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.trie, self.limit, self.spilled = PatriciaTrie(), limit, []

    def insert(self, key: bytes, low: int | None, high: int | None, n: int) -> tuple[str, list[tuple]]:
        """The SHA-256 of key, and rows (key, low, high, n) that are to be inserted elsewhere."""
        for prefix in self.spilled:
            if key.startswith(prefix):
                return hashlib.sha256(key).hexdigest(), [(key, low, high, n)]
        node = self.trie.terminal(key)
        if node.value is not None:
            name, a, b, m = node.value
            node.value = (name, smaller(a, low), larger(b, high), m + n)
            return name, []
        name = hashlib.sha256(key).hexdigest()
        node.value = (name, low, high, n)
        return name, self.spill() if self.trie.root.held > self.limit else []

    def spill(self) -> list[tuple]:
        found = self.trie.cut()
        if not found:
            return []
        prefix, node = found
        self.spilled.append(prefix + node.source[node.start : node.end])
        return [(key, *value[1:]) for key, value in terminals(node, prefix)]

    def classes(self) -> Iterator[tuple]:
        return (value for _, value in terminals(self.trie.root, b""))


LOCAL = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])
OWNED = pa.schema([("kind", pa.int32()), ("text_sha256", pa.string()), *LOCAL])
OWNED_KINDS = "kind int, text_sha256 string, key binary, ids array<bigint>, low bigint, high bigint, n bigint"
#: Kinds of rows from owner_tries: ids of a text, a class, a text for another round.
MEMBERS, CLASS, AGAIN = 0, 1, 2


def rows_in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) if isinstance(x, (bytes, str)) else 8 * len(x) if isinstance(x, list) else 8 for x in row)
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(found: list) -> Iterator[tuple]:
        for key, ids in found:
            known = [x for x in ids if x is not None]
            yield key, ids, min(known, default=None), max(known, default=None), len(ids)

    def rows() -> Iterator[tuple]:
        trie, found, size = PatriciaTrie(), [], 0
        for batch in batches:
            for doc, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node = trie.terminal(key)
                if node.value is None:
                    node.value = len(found)
                    found.append((key, []))
                found[node.value][1].append(doc)
                size += 8
                if trie.root.held + size > TRIE_BYTES:
                    yield from flush(found)
                    trie, found, size = PatriciaTrie(), [], 0
        yield from flush(found)

    return rows_in_batches(rows(), LOCAL)


def owner_tries(limit: int = TRIE_BYTES):
    """key, ids, low, high, n -> OWNED; null ids: the row was there in an earlier round."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        owners = OwnerTrie(limit)
        for batch in batches:
            for key, ids, low, high, n in zip(*(c.to_pylist() for c in batch.columns)):
                name, elsewhere = owners.insert(key, low, high, n)
                if ids is not None:
                    yield MEMBERS, name, None, ids, None, None, None
                for x, *value in elsewhere:
                    yield AGAIN, None, x, None, *value
        for name, *value in owners.classes():
            yield CLASS, name, None, None, *value

    return lambda batches: rows_in_batches(rows(batches), OWNED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", the id of a class that stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("key"))
    texts = rows.mapInArrow(local_tries, "key binary, ids array<bigint>, low bigint, high bigint, n bigint")
    found, turn = [], 0
    while True:
        # another hash in each round, so that what spilled together is spread
        dealt = texts.repartition(F.length("key"), F.xxhash64("key", F.lit(turn)))
        found.append(materialize(dealt.mapInArrow(owner_tries(trie_bytes), OWNED_KINDS), f"owned{turn}"))
        texts, turn = found[-1].filter(F.col("kind") == AGAIN).select("key", "ids", "low", "high", "n"), turn + 1
        if texts.isEmpty():
            break
    owned = found[0].drop("key")
    for more in found[1:]:
        owned = owned.unionByName(more.drop("key"))
    classes = owned.filter(F.col("kind") == CLASS).select("text_sha256", F.col("high" if keep == "max" else "low").alias("keep_id"), F.col("n").alias("group_size"))
    members = owned.filter(F.col("kind") == MEMBERS).select("text_sha256", "ids").join(classes, "text_sha256")
    return members.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, one for each text."""
    kept = exact_dedup(docs, keep=keep).filter("kept").select(F.col("doc_id").alias("_cl_id"), F.col("text_sha256").alias("_cl_sha")).distinct()
    named = docs.withColumn("_cl_of", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    found = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (F.col("_cl_of") == F.col("_cl_sha")), "left_semi")
    return found.dropDuplicates(["doc_id", "_cl_of"]).drop("_cl_of")
