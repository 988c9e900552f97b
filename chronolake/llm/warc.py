"""WARC archives and an index of captures merged from sorted runs.

Writing: a row becomes one WARC/1.1 record, compressed as a gzip member of its own, so
that a reader gets it by its offset and length in the archive.  A task packs members to
archives of about ``ARCHIVE_BYTES`` (one record at least) and of ``ARCHIVE_RECORDS`` at
most; each is written as a file by Spark's text writer, whose line separator is an empty
gzip member, so that archives go to any store and are committed as a whole.

Payloads of at least ``least_bytes`` that are equal (same length, SHA-1 and SHA-256) are
stored once: the record with the largest id is the response, the others are revisits
that name it.  Smaller ones take no part in the search.

Reading: each archive is read as one binary file, member by member.  What an archive
holds is a run of index entries sorted by (URL key, timestamp, id), written to the shared
folder.  Runs are dealt to ranges of that key of about ``RANGE_ROWS`` entries, found by
sampling, and each range merges its parts of the runs by a loser tree that holds a block
of each run; the ranges in order are the captures of all archives in order.

A null url is written as an empty one and a null html counts as an empty payload.
A null id is written as "null", read back as null, and is smaller than any other.
Rows that repeat an id and a payload are all responses if their id is the largest.
Captures that agree in URL key, timestamp and id follow each other by archive and offset.
Without a timestamp column the capture time is the id in seconds after the epoch.  A page
of any length (up to Spark's 2 GB for a value) is one record.  Other columns are ignored,
whatever their names; no page gives no archive and an empty index.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

ARCHIVE_RECORDS = 2000
ARCHIVE_BYTES = 16 << 20
RANGE_ROWS = 100_000
PIECE = 1 << 16
GZIP = 31  # zlib's window bits for a gzip member
END = "\r\n\r\n"
PREFIX = "urn:chronolake:page:"


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query: com,example,www)/path?query."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def classify(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of each row."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"), F.sha2(html.cast("binary"), 256).alias("content"),
    )
    key = ["payload_bytes", "payload_digest", "content"]
    # small pages are never matched, so they aren't shuffled
    small, large = rows.filter(F.col("payload_bytes") < least_bytes), rows.filter(F.col("payload_bytes") >= least_bytes)
    owners = large.groupBy(*key).agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    found = large.join(owners, key, "left").unionByName(small, allowMissingColumns=True).withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    return found.withColumn("refers_to", F.when(revisit, F.col("owner"))).drop("content", "owner", "copies")


def member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return press.compress(data) + press.flush()


def pack_archives(most_records: int, most_bytes: int) -> Callable:
    """record -> archive: members of some records, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

        for batch in batches:
            for record in batch.column(0):
                held.append(member(record.as_buffer().to_pybytes() + END.encode()))
                size += len(held[-1])
                if len(held) >= most_records or size >= most_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write_warc(classified: DataFrame, out: str, records_per_archive: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of rows from classify()."""
    when = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit(f"<{PREFIX}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    # control characters and blanks can't stand in a header line
    url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""), " ", "%20")
    head = lambda *lines: F.concat_ws("\r\n", *lines)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise("")
    common = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), when), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), "payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    rows = classified.withColumn("block", block)
    record = F.concat(head(*common, F.concat(F.lit("Content-Length: "), F.octet_length("block"))), F.lit(END), F.col("block"))
    archives = rows.select(record.alias("record")).mapInArrow(pack_archives(records_per_archive, archive_bytes), "archive binary")
    # a cast leaves the bytes as they are, and so does the writer
    archives.select(F.col("archive").cast("string").alias("value")).write.options(lineSep=member(b"").decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=1).text(out)


class LoserTree:
    """k sorted runs as one: an inner node holds the run that lost there, the root the winner."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = self.k = max(1, len(runs))
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.losers[0] = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def __iter__(self):
        while self.runs and self.heads[run := self.losers[0]] is not None:
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self.before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.losers[0] = run


ENTRY = pa.schema([(x, pa.string()) for x in ("url_key", "captured_at")] + [("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
KINDS = "url_key string, captured_at string, page_id bigint, archive string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
HEADER = re.compile(rb"([^:\r\n]+):[ ]?([^\r\n]*)\r\n")


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{PREFIX}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and decompressed bytes of each gzip member that isn't empty."""
    at = 0
    while at < len(content):
        unpack, end, parts = zlib.decompressobj(GZIP), at, []
        while not unpack.eof:
            piece = content[end : end + PIECE]
            if not len(piece):
                raise ValueError("the archive ends within a member")
            parts.append(unpack.decompress(piece))
            end += len(piece)
        end -= len(unpack.unused_data)
        data = b"".join(parts)
        if data:
            yield at, end - at, data
        at = end


def parsed(record: bytes) -> tuple[dict[str, str], memoryview]:
    """Headers and block of a record."""
    stop = record.index(b"\r\n\r\n") + 4
    head = {k.decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(record[: stop - 2])}
    size = int(head["Content-Length"])
    if record[stop + size :] != END.encode():
        raise ValueError("a record doesn't end where it says")
    return head, memoryview(record)[stop : stop + size]


def order(entry: tuple) -> tuple:
    """By URL key, timestamp and id, nulls first; the rest breaks ties."""
    return (entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4])


def archive_run(name: str, content: memoryview) -> list[tuple]:
    """The index entries of an archive, sorted; digests of stored payloads are computed again and must agree."""
    out = []
    for offset, length, record in members(content):
        head, block = parsed(record)
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            payload = block[bytes(block[:400]).index(b"\r\n\r\n") + 4 :]
            if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"{name}: the record at {offset} doesn't hold the payload that it names")
        out.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], page_of(head["WARC-Record-ID"]), name, offset, length, size, digest, head["WARC-Type"], page_of(head.get("WARC-Refers-To"))))
    return sorted(out, key=order)


def batches_of(rows: Iterator[tuple], most: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), ENTRY)], schema=ENTRY)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), ENTRY)], schema=ENTRY)


def read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from batches_of(iter(archive_run(name, memoryview(content.as_buffer()))))


def run_entries(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The entries of a run with their order, a block at a time."""
    for part in parts:
        for at in range(0, len(part), 256):
            for row in zip(*(c.to_pylist() for c in part.slice(at, 256).columns)):
                yield order(row), row


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come by archive, each archive's in order: that many sorted runs, kept as they came."""
    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        names = batch.column(3).to_pylist()
        edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if names[a] != last:
                    runs.append([])
                    last = names[a]
                runs[-1].append(batch.slice(a, b - a))
    yield from batches_of(row for _, row in LoserTree([run_entries(x) for x in runs]))


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path, in order of URL key, timestamp and id; offset and length are those of a record's gzip member."""
    archives = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    runs = materialize(archives.mapInArrow(read_runs, KINDS), "runs")
    n = max(1, -(-runs.count() // RANGE_ROWS))
    ranges = runs.repartitionByRange(n, "url_key", "captured_at", "page_id").sortWithinPartitions("archive", "url_key", "captured_at", F.col("page_id").asc_nulls_first(), "offset")
    return ranges.mapInArrow(merge_runs, KINDS)
