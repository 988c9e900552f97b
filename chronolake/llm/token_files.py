"""Token ids as Parquet list columns, in ascending document order, for selective reads.

The documents are range-partitioned and sorted by id before they are encoded, so that
the files in order of their smallest id, and the rows within a file, follow the id.
Row groups, pages and the encoding of the ids are controlled; Parquet's page indexes let
a reader fetch the ids of some documents, and the counts alone are read without the ids.

Null texts count as empty; each document ends with ``end_id``, so none is without ids.
Rows with a null id come first; rows of one id follow each other in order of their texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters, chunks
from .cache import Cache

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000


#: The steps before the merges of a lower-case tokenizer with word ends.
LOWER_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same rule for printable ASCII and the letters of Latin-1, for which NFC changes nothing.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class LibraryEncoder:
    """The tokenizers library behind a cache of words.

    by_word: words between white space are encoded one by one; right for a tokenizer
    whose normalizer makes white space one blank and whose words never hold a blank.
    Where the steps before the merges are the known ones, a plain word is cut here and
    only its merges are left to the library's model.
    """

    def __init__(self, path: str, by_word: bool):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.by_word = by_word
        # str.split() also cuts at these, which are no white space to the library
        added = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[\x1c-\x1f]", *added]))
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps, cuts = (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.known = steps == LOWER_STEPS and cuts[0].get("pattern") == {"Regex": WORD_RULE} and len(cuts) == 2 and cuts[1].get("type") == "ByteLevel"
        self.model = self.library.model
        letters = {b: c for c, b in byte_letters().items()}
        self.spelling = {k: "".join(letters[b] for b in chr(k).encode()) for k in range(256)}
        self.part = Cache(self.merged, 220_000)
        self.word = Cache(self.cut if self.known else self.ids, 180_000)

    def merged(self, part: str) -> bytes:
        # printable ASCII spells itself
        return array("I", [x.id for x in self.model.tokenize(part if part.isascii() else part.translate(self.spelling))]).tobytes()

    def cut(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.part[word.lower()]
        if PLAIN.fullmatch(word):
            return b"".join(map(self.part.__getitem__, PLAIN_WORDS.findall(word.lower())))
        return self.ids(word)

    def ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or self.odd.search(text):
            return self.ids(text)
        return b"".join(map(self.word.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool) -> LibraryEncoder:
    return LibraryEncoder(path, by_word)


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, by_word: bool = True, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, n_tokens and tokens of each row of docs below out.

    encoding: "dictionary" or "delta" (binary packed) for the ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer, by_word)
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                parts = [library.encode(x) + end for x in texts]
                ends = np.cumsum([0, *map(len, parts)]) // 4
                ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.diff(ends), pa.int64()), lists], ["doc_id", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>")
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS}
    if encoding == "delta":
        options |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    encoded.write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens and tokens, of the ids from first to last where given; page indexes skip the other rows."""
    found = spark.read.schema("doc_id bigint, n_tokens bigint, tokens array<int>").parquet(path)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    return found


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """file, row, doc_id, n_tokens and start (the ids before the row in all files), from the counts alone."""
    rows = read_tokens(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file meets in one task here
    files = rows.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("own"))
    files = files.select("file", F.coalesce(F.sum("own").over(before.orderBy(F.col("least").asc_nulls_first(), "file")), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("file").orderBy("row")), F.lit(0))
    return rows.withColumn("inside", inside).join(files, "file").select("file", "row", "doc_id", "n_tokens", (F.col("earlier") + F.col("inside")).alias("start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, row and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, ids = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["file", "row", "ids_crc32"])

    rows = read_tokens(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "tokens")
    return rows.mapInArrow(run, "file string, row bigint, ids_crc32 bigint")
