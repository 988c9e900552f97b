"""Byte-pair encoding by a deterministic tokenization automaton, and decoding by its arc labels.

A state of the automaton is the token read last; an arc is labelled with the token it
reads, and leads to that token's state.  At first every byte may follow every byte.
Merges are compiled in rank order, each by a gadget: merging u and v to w makes the state
w with the arcs of the state v, takes the arc v from the state u (what began as u v is
now w), and gives every state with an arc u an arc w.  A merge whose arc is gone by then
can never happen and makes no token.

The arcs are a table of bits.  States with the same arcs share a row and tokens that the
same states read share a column: a gadget copies by sharing, and a row or a column is
split when only one of its sharers loses an arc.  A vocabulary of 50,000 merges takes
some 15,000 rows of 11,000 bits (20 MB).  Exactly one path of arcs spells a word, and it
is the word's encoding.  Words are encoded many at a time: the bytes go through a table
of transitions (nodes of the tokens' prefix tree by byte) that gives all tokens at all
positions, and one bit of the table tells whether a token goes on from the state before.

A text is first cut at the added tokens and then into words by the tokenizer's own rule.
Null texts count as empty; whole texts are encoded, whatever their length.  A row stays a
row: null ids, repeated ids and repeated rows are encoded as any other; other columns are
ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import Cache

#: White space of Unicode and the word rule of the byte-level tokenizer.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_rule = lambda space, letters, numbers: rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
WORDS = regex.compile(_rule(SPACE, r"\p{L}", r"\p{N}"))
#: The same rule up to U+024F, by the letters and numbers there.
LATIN_WORDS = re.compile(_rule(r"\t\n\x0b\x0c\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾"))
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
CHUNK_BYTES = 1 << 20
LONG = 64  # bytes from which a word is encoded by itself


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class TokenAutomaton:
    """``row`` and ``column`` give the place of a token's state and of its arcs in ``table``; -1: no such token is ever made."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.added.values()])
        self.labels = [b""] * n
        for word, k in vocab.items():
            self.labels[k] = bytes(letters[c] for c in word)
        for word, k in self.added.items():
            self.labels[k] = word.encode()
        merges = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
        self.compile([k for word, k in vocab.items() if len(word) == 1], [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges])
        self.grow_tree()
        self.lengths = [len(x) for x in self.labels]
        self.sizes = np.array(self.lengths, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        self.pool = np.frombuffer(b"".join(self.labels), np.uint8)
        digits = [f"{k}," for k in range(n)]
        self.width = max(map(len, digits))
        self.decimal = np.frombuffer("".join(x.ljust(self.width) for x in digits).encode(), np.uint8).reshape(n, self.width)
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.word = Cache(self.word_ids, 100_000)

    def compile(self, letters: list[int], merges: list[tuple[int, int, int]]) -> None:
        """The arcs of all states, gadget by gadget."""
        n = len(self.labels)
        row, column = [-1] * n, [-1] * n
        for k in letters:
            row[k] = column[k] = 0
        in_row, in_column = [len(letters)], [len(letters)]  # how many states and tokens share each
        table = np.zeros((1024, 128), np.uint8)
        table[0, 0] = 1
        for u, v, w in merges:
            r, c = row[u], column[v]
            if r < 0 or c < 0 or not table[r, c >> 3] >> (c & 7) & 1:
                continue
            if row[w] >= 0:
                raise ValueError(f"two merges make the token {self.labels[w]!r}")
            # the state w has the arcs of v, as they were before u lost its own
            row[w] = row[v]
            in_row[row[v]] += 1
            if in_row[r] > 1:
                in_row[r] -= 1
                row[u] = len(in_row)
                in_row.append(1)
                if row[u] == len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[row[u]] = table[r]
            if in_column[c] > 1:
                in_column[c] -= 1
                column[v] = new = len(in_column)
                in_column.append(1)
                if new >> 3 == table.shape[1]:
                    table = np.concatenate([table, np.zeros_like(table)], axis=1)
                table[:, new >> 3] |= (table[:, c >> 3] >> (c & 7) & 1) << (new & 7)
            r, c = row[u], column[v]
            table[r, c >> 3] &= ~np.uint8(1 << (c & 7))
            # who has an arc u has an arc w
            column[w] = column[u]
            in_column[column[u]] += 1
        self.table = np.ascontiguousarray(table[: len(in_row), : (len(in_column) + 7) // 8])
        self.row, self.column = np.array(row, np.int32), np.array(column, np.int32)
        self.bits, self.stride = self.table.reshape(-1).data, self.table.shape[1]

    def grow_tree(self) -> None:
        """The prefix tree of all tokens that are ever made: transitions by byte, inner nodes first, and the token that each node reads."""
        step, reads = {}, [-1]
        for k in np.flatnonzero(self.row >= 0).tolist():
            node = 0
            for b in self.labels[k]:
                found = step.get(node << 8 | b)
                if found is None:
                    found = step[node << 8 | b] = len(reads)
                    reads.append(-1)
                node = found
            reads[node] = k
        inner = {x >> 8 for x in step}
        order = sorted(range(len(reads)), key=lambda x: x not in inner)
        place = {old: new for new, old in enumerate(order)}
        self.step = {place[x >> 8] << 8 | x & 255: place[y] for x, y in step.items()}
        self.reads = np.array([reads[x] for x in order], np.int32)
        self.inner = len(inner)
        self.goto = np.full((self.inner, 256), -1, np.int32)
        at = np.array(list(self.step), np.int64)
        self.goto[at >> 8, at & 255] = list(self.step.values())
        self.rows, self.columns, self.reading = self.row.tolist(), self.column.tolist(), self.reads.tolist()

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells word, of any length."""
        n, step, reads, bits, stride, rows, columns = len(word), self.step, self.reading, self.bits, self.stride, self.rows, self.columns
        last = [-1] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            base = rows[last[i]] * stride if i else 0
            node = 0
            for j in range(i, n):
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                token = reads[node]
                if token >= 0 and last[j + 1] < 0 and (i == 0 or bits[base + ((c := columns[token]) >> 3)] >> (c & 7) & 1):
                    last[j + 1] = token
        out = []
        while n:
            out.append(last[n])
            n -= self.lengths[last[n]]
        return out[::-1]

    def paths(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each of some short words, none of them empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(words), np.uint8)
        low, high = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        # every token that the bytes spell, from each position on
        at, node, depth = np.arange(len(text)), np.zeros(len(text), np.int32), 0
        begins, stops, tokens = [], [], []
        while len(at):
            node = self.goto[node, text[at + depth]]
            depth += 1
            at, node = at[node >= 0], node[node >= 0]
            token = self.reads[node]
            hit = token >= 0
            begins.append(at[hit])
            stops.append(at[hit] + depth)
            tokens.append(token[hit])
            more = (node < self.inner) & (at + depth < high[at])
            at, node = at[more], node[more]
        begin, stop, token = (np.concatenate(x) for x in (begins, stops, tokens))
        place = begin - low[begin]
        order = np.argsort(place, kind="stable")
        begin, stop, token = begin[order], stop[order], token[order]
        cuts = np.searchsorted(place[order], np.arange(int(sizes.max()) + 1))
        column = self.column[token]
        # the state in which each position is reached
        last = np.full(len(text) + 1, -1, np.int32)
        last[stop[: cuts[1]]] = token[: cuts[1]]
        for a, b in zip(cuts[1:], cuts[2:]):
            c = column[a:b]
            good = self.table[self.row[last[begin[a:b]]], c >> 3] >> (c & 7).astype(np.uint8) & 1 == 1
            last[stop[a:b][good]] = token[a:b][good]
        # back from the ends of the words
        mark, at, least = np.zeros(len(text) + 1, bool), ends, ends - sizes
        while len(at):
            mark[at] = True
            at = at - self.sizes[last[at]]
            at, least = at[at > least], least[at > least]
        ids = last[mark].astype("<u4").tobytes()
        edges = [0, *(4 * np.cumsum(mark)[ends]).tolist()]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def word_ids(self, word: str) -> bytes:
        return np.array(self.path(word.encode()), "<u4").tobytes()

    def words_of(self, text: str) -> list[str]:
        return (WORDS if BEYOND_LATIN.search(text) else LATIN_WORDS).findall(text)

    def parts(self, text: str | None) -> list[tuple[bytes, list[str]]]:
        """A text as runs of words, each with the id of the added token before it."""
        if not text:
            return []
        if self.specials is None or not any(x in text for x in self.added):
            return [(b"", self.words_of(text))]
        cut = self.specials.split(text)
        ids = (np.array([self.added[x]], "<u4").tobytes() for x in cut[1::2])
        return [(before, self.words_of(x)) for before, x in zip([b"", *ids], cut[::2])]

    def learn(self, words: set[str]) -> None:
        """Encode those of some words that aren't known yet, many at a time."""
        new = [(x, y) for x in self.word.unknown(words) if len(y := x.encode()) <= LONG]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for (x, _), ids in zip(part, self.paths([y for _, y in part])):
                self.word.put(x, ids)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        every = [self.parts(x) for x in texts]
        self.learn(set().union(*(words for runs in every for _, words in runs)))
        return [b"".join(before + b"".join(map(self.word.__getitem__, words)) for before, words in runs) for runs in every]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of ids, one after another."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.pool[at].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a comma."""
        wide = self.decimal[ids]
        return wide[wide != 32].tobytes()


@lru_cache(maxsize=4)
def automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(path)


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of about CHUNK_BYTES, each with the index of its first."""
    at, n, most = 0, len(texts), 64
    while at < n:
        run = texts.slice(at, most).to_pylist()
        held, k = 0, 0
        while k < len(run) and (k == 0 or held < CHUNK_BYTES):
            held += len(run[k] or "")
            k += 1
        yield at, run[:k]
        at += k


def encode_texts(tokens: TokenAutomaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each text's begin and end."""
    parts = tokens.encode_all(texts)
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return np.frombuffer(b"".join(parts), "<u4"), ends


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text; with digest, decoded_sha256 of the text decoded from them."""
    names = ["doc_id", "ids", *["decoded_sha256"] * digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(path)
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                ids, ends = encode_texts(tokens, texts)
                columns = [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))]
                if digest:
                    decoded = (tokens.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))
                    columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>" + ", decoded_sha256 string" * digest)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids give an empty text, broken characters U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(path)
        for batch in batches:
            out = [tokens.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them.

    Encoding and decoding run in one pass, so that the ids never leave the task.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = automaton(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for _, texts in chunks(batch.column(1)):
                ids, ends = encode_texts(tokens, texts)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    own = ids[a:b]
                    counts.append(b - a)
                    ids_sha.append(hashlib.sha256(tokens.decimals(own)[:-1]).hexdigest())
                    text_sha.append(hashlib.sha256(tokens.decode(own).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
