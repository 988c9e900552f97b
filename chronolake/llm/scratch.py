"""Intermediate tables in the folder that the cluster shares.

``materialize`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and
reads it back: lineage is cut and a lost executor costs no recomputation.  Only a
local session that names no such folder falls back to a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/chronolake-{uuid.uuid4().hex}/{name}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path.rsplit("/", 1)[0])
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote in this application; results that still read it must be written first."""
    jvm = spark.sparkContext._jvm
    for folder in _made.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numeric_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
