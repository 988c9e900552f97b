"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .language import identify_language, language_fold
from .near_dedup import near_dedup
from .quality import importance_resample
from .scratch import new_path
from .suffix_dedup import repeated_spans
from .token_files import token_digests, token_offsets, write_token_files
from .toxicity import score_toxicity, toxic_fold
from .warc import capture_index, classify, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_offsets(spark, path).join(token_digests(spark, path), ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), length=100).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(classify(table(spark, sf_dir, "pages"), least_bytes=1000), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxic_fold(F.col("doc_id")) == 0
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, held_out)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("text_hash")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_fold(F.col("doc_id")) == 2
    return identify_language(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_language": op9_language,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM owner AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
        FROM (SELECT page_id, body, CAST(strlen(body) AS BIGINT) AS size, max(page_id) OVER (PARTITION BY body) AS owner
              FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))""",
    "op7_decontaminate": r"""
        WITH d AS (SELECT doc_id, w, len(w) AS n, row_number() OVER () AS r FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
        b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(n - 10, 0) + 2)) AS i FROM b)),
        size AS (SELECT DISTINCT k FROM win),
        spot AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, n - k + 2)) AS i FROM d, size WHERE n >= k)),
        hit AS (SELECT r, spot.k, i, item_id FROM spot JOIN win ON spot.k = win.k AND spot.s = win.s),
        n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
