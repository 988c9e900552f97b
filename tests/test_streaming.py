from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from chronolake.config import TableConfig
from chronolake.plans.session import TemporalSession
from chronolake.streaming import ingest

T0 = datetime(2024, 1, 1)


def log(spark, folder, rows):
    spark.createDataFrame(rows, "id bigint, v string, ts timestamp, who string, gone boolean").coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema("id bigint, v string, ts timestamp, who string, gone boolean").parquet(folder)


def test_snapshots_into_table(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    session = TemporalSession(spark, f"file://{tmp_path}/store", user_id="s", buckets=1, clock=lambda: datetime.now(timezone.utc))
    session.enable("t", spark.createDataFrame([], "id bigint, v string"), TableConfig(key=("id",), combine_interval=timedelta(0)))
    for rows in ([(1, "a", T0, "u", False), (2, "b", T0, "u", False)], [(1, "c", T0 + timedelta(1), "u", False), (2, None, T0 + timedelta(1), "u", True)]):
        log(spark, folder, rows)
        query = ingest.snapshots_into_table(source(spark, folder), session, "t", f"file://{tmp_path}/check", "ts", "gone")
        query.processAllAvailable()
        query.stop()
    t = session.table("t")
    assert [(r.id, r.v) for r in t.current().collect()] == [(1, "c")]
    assert sorted((r.id, r.v) for r in t.history().collect()) == [(1, "a"), (2, "b")]


def test_streams_have_their_own_batch_numbers(spark, tmp_path):
    session = TemporalSession(spark, f"file://{tmp_path}/store", user_id="s", buckets=1, clock=lambda: datetime.now(timezone.utc))
    session.enable("t", spark.createDataFrame([], "id bigint, v string"), TableConfig(key=("id",), combine_interval=timedelta(0)))
    for k in range(2):
        folder = f"file://{tmp_path}/in{k}"
        log(spark, folder, [(k, "a", T0, "u", False)])
        for _ in range(2):  # the second run has no new batch
            query = ingest.snapshots_into_table(source(spark, folder), session, "t", f"file://{tmp_path}/check{k}", "ts", "gone")
            query.processAllAvailable()
            query.stop()
    assert sorted((r.id, r.v) for r in session.table("t").current().collect()) == [(0, "a"), (1, "a")]


def test_stream_of_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    log(spark, folder, [(1, "a", T0, "u", False), (1, "a", T0 + timedelta(seconds=1), "u", False), (1, "b", T0 + timedelta(seconds=2), "w", False), (1, None, T0 + timedelta(seconds=3), "x", True)])
    out = ingest.versions(source(spark, folder), "id", "v", "ts", "who", "gone")
    query = out.writeStream.format("memory").queryName("closed_versions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    found = [(r.v, r.changed_by, (r.valid_to - r.valid_from).seconds, r.deleted_by) for r in spark.table("closed_versions").orderBy("valid_from").collect()]
    assert found == [("a", "u", 2, None), ("b", "w", 1, "x")]


def test_edits_per_window(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    log(spark, folder, [(1, "a", T0, "u", False), (2, "b", T0, "u", False)])
    query = ingest.edits_per_window(source(spark, folder), "ts", "who").writeStream.format("memory").queryName("edits").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.who, r.edits) for r in spark.table("edits").filter(F.col("edits") > 0).collect()] == [("u", 2)]
