"""Queries over tracked tables in a store: what ``TemporalTable`` writes and ``TemporalSession.sql`` reads, each with DuckDB SQL.

``ledger`` is keyed by user and written from ``events`` in ``COMMITS`` transactions: of a
transaction's events of a user (those whose id has its number as remainder) the last one
counts, an error deletes.  A last transaction changes an excluded column of all rows.  A
store is made once for each application and folder of tables; queries that write work on
a clone of it.  Times are in seconds after ``START``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import TableConfig
from .operators import versions as V
from .plans.session import TemporalSession
from .sources.scratch import new_path
from .sources.table import TemporalTable

COMMITS = 4
START = datetime(2024, 2, 1, tzinfo=timezone.utc)
BASE = int(START.timestamp())
THEN = 15
COMBINE = (0, 10, 40, 50)  # when the transactions of ``tally`` begin; 15 seconds combine
_made: dict[tuple[str, str], TemporalSession] = {}


class Clock:
    """A clock that is set."""

    def __init__(self, seconds: int = 0):
        self.seconds = seconds

    def __call__(self) -> datetime:
        return START + timedelta(seconds=self.seconds)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, turn, event_type, value, props, gone: a row for each user and transaction."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.groupBy("user_id", (F.col("event_id") % COMMITS).alias("turn")).agg(F.max_by(F.struct("event_type", "value", "props"), F.struct("ts", "event_id")).alias("r"))
    return last.select("user_id", "turn", "r.*", (F.col("r.event_type") == "error").alias("gone"))


def store(spark: SparkSession, sf_dir: str) -> TemporalSession:
    """The store with ``ledger`` and ``tally``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _made:
        return _made[key]
    clock = Clock()
    session = TemporalSession(spark, new_path(spark, "store"), user_id="nobody", clock=clock)
    ops = session.pinned(operations(spark, sf_dir))
    row = ops.drop("turn", "gone").limit(0)
    ledger = session.enable("ledger", row, TableConfig(key=("user_id",), excluded=("props",), combine_interval=timedelta(0)))
    tally = session.enable("tally", row.select("user_id", F.lit(0).cast("long").alias("v")), TableConfig(key=("user_id",), combine_interval=timedelta(seconds=15)))
    for turn in range(COMMITS):
        own = ops.filter(F.col("turn") == turn)
        live, gone = own.filter("not gone"), own.filter("gone").select("user_id")
        clock.seconds = 10 * turn
        with session.as_user(f"w{turn % 2}"), session.transaction():
            ledger.upsert(live.drop("turn", "gone"))
            ledger.delete(source=gone)
        clock.seconds = COMBINE[turn]
        with session.as_user("w"), session.transaction():
            tally.upsert(live.select("user_id", F.round(F.col("value") / 4).cast("long").alias("v")))
            tally.delete(source=gone)
    clock.seconds = 60
    with session.as_user("auditor"):
        ledger.update({"props": F.concat(F.lit("seen "), F.col("event_type"))})
    session.create_view("high", "SELECT * FROM ledger WHERE value > 50")
    session.create_view("high_by_type", "SELECT event_type, count(*) AS n FROM high GROUP BY event_type")
    _made[key] = session
    return session


def clone(spark: SparkSession, sf_dir: str, seconds: int) -> tuple[TemporalSession, TemporalTable]:
    """A store of its own for a query that writes at that time, and its ledger."""
    found = store(spark, sf_dir).clone(new_path(spark, "clone"))
    found.clock, found.user_id = Clock(seconds), "editor"
    return found, found.table("ledger")


def at(seconds: int) -> datetime:
    return START + timedelta(seconds=seconds)


def seconds(column: str):
    return F.unix_seconds(column) - BASE


def shown(df: DataFrame, *names: str) -> DataFrame:
    """Rows of a history or of versions, with times in seconds."""
    return df.select("user_id", *names, seconds(V.FROM).alias("from_s"), seconds(V.TO).alias("to_s"), V.BY, V.DELETED_BY)


def as_of_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).sql("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM ledger WHERE temporal.as_of('2024-02-01T00:00:15Z') /* temporal.as_of('now') */ GROUP BY event_type")


def view_over_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).sql("SELECT * FROM high_by_type WHERE temporal.as_of(:t)", t=at(THEN))


def join_with_own_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("chronolake_customers")
    with (session := store(spark, sf_dir)).as_of(at(THEN)):
        return session.sql("SELECT c_mktsegment, count(*) AS n, count(DISTINCT ledger.event_type) AS types FROM ledger JOIN chronolake_customers c ON c.c_custkey = ledger.user_id GROUP BY c_mktsegment")


def history_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).sql("SELECT v.user_id, count(*) AS versions, count_if(v.is_current) AS present, count(h.user_id) AS closed FROM ledger__versions v LEFT JOIN ledger__history h ON h.user_id = v.user_id AND h.valid_from = v.valid_from GROUP BY v.user_id")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir).table("ledger").changes(start=at(5), end=at(25))
    return rows.select(F.get_json_object("pk", "$.user_id").cast("long").alias("user_id"), seconds("changed_at").alias("at_s"), "changed_by", "operation", F.get_json_object("new_row", "$.event_type").alias("new_type"), F.array_join("changed_columns", ",").alias("changed"))


def combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(store(spark, sf_dir).table("tally").versions(), "v").drop(V.BY)


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = store(spark, sf_dir).table("ledger")
    counts = table.versions().groupBy("user_id").agg(F.count("*").alias("versions"))
    return table.current().join(counts, "user_id").select("user_id", "props", V.BY, "versions")


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = clone(spark, sf_dir, 100)
    names = ["user_id", "event_type", "value"]
    table.merge(
        table.as_of(at(THEN)).select(*names), update={c: F.col(f"s.{c}") for c in names[1:]}, update_when=F.col("s.value") > F.col("t.value"),
        delete_when=F.col("s.event_type") == "view", insert={c: F.col(f"s.{c}") for c in names},
    )
    return table.current().select(*names, V.BY)


def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = clone(spark, sf_dir, 100)
    then, now = (x.select("user_id", F.col("value").alias(n)) for x, n in ((table.as_of(at(THEN)), "a"), (table.current(), "b")))
    key = then.join(now, "user_id").filter("a <> b").agg(F.min("user_id")).head()[0]
    if key is not None:
        table.restore({"user_id": key}, at(THEN))
    return shown(table.versions(), "event_type", "value", V.CURRENT).filter(F.col("user_id") == F.lit(key))


def restore_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = clone(spark, sf_dir, 100)
    key = table.history().select("user_id").join(table.current().select("user_id"), "user_id", "left_anti").agg(F.min("user_id")).head()[0]
    if key is not None:
        table.restore_deleted({"user_id": key})
    return shown(table.versions(), "event_type", "value", V.CURRENT).filter(F.col("user_id") == F.lit(key))


def prune_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = clone(spark, sf_dir, 100)
    n = table.prune(at(25))
    left = table.history().count()
    return spark.createDataFrame([(n, left)], "pruned bigint, left bigint")


def drop_history_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = clone(spark, sf_dir, 100)
    table.drop_history_before(at(20))
    return shown(table.history(), "event_type", "value")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, table = clone(spark, sf_dir, 100)
    session.add_policy("ledger", "retention", drop_after=timedelta(seconds=75))
    if session.run_due_policies() != 1 or session.run_due_policies() != 0:
        raise ValueError("a due policy runs once")
    return shown(table.history(), "event_type", "value")


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = clone(spark, sf_dir, 100)
    table.drop_column("value")
    table.compact_history()
    return table.history().select("user_id", "event_type", seconds(V.FROM).alias("from_s"), seconds(V.TO).alias("to_s"))


def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, table = clone(spark, sf_dir, 100)
    table.rename_column("event_type", "kind")
    table.alter_column_type("value", "decimal(18,2)")
    table.add_column("note", "string", "new")
    table.update({"note": F.lit("old")}, F.col("kind") == "click")
    text = "SELECT '{0}' AS age, kind, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total, count_if(note = 'old') AS old FROM ledger {1} GROUP BY kind"
    return session.sql(text.format("now", "")).unionByName(session.sql(text.format("then", "WHERE temporal.as_of('2024-02-01T00:00:15Z')")))


RELATIONS = f"""
raw AS (SELECT user_id, event_id % {COMMITS} AS turn, event_type, value, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id, event_id % {COMMITS} ORDER BY ts DESC, event_id DESC) AS rn FROM events),
ops AS (SELECT user_id, turn, event_type, value, gone, lag(gone) OVER w AS was_gone, lag(event_type) OVER w AS was_type, lag(value) OVER w AS was_value FROM raw WHERE rn = 1 WINDOW w AS (PARTITION BY user_id ORDER BY turn)),
vis AS (SELECT * FROM ops WHERE NOT (gone AND coalesce(was_gone, true)) AND NOT (NOT gone AND coalesce(NOT was_gone AND was_type = event_type AND was_value IS NOT DISTINCT FROM value, false))),
nxt AS (SELECT *, lead(turn) OVER w AS t2, lead(gone) OVER w AS g2 FROM vis WINDOW w AS (PARTITION BY user_id ORDER BY turn)),
ver AS (SELECT user_id, event_type, value, CAST(10 * turn AS BIGINT) AS from_s, CAST(10 * t2 AS BIGINT) AS to_s, 'w' || CAST(turn % 2 AS VARCHAR) AS changed_by, CASE WHEN g2 THEN 'w' || CAST(t2 % 2 AS VARCHAR) END AS deleted_by, t2 IS NULL AS is_current FROM nxt WHERE NOT gone),
cur AS (SELECT * FROM ver WHERE is_current),
hist AS (SELECT user_id, event_type, value, from_s, to_s, changed_by, deleted_by FROM ver WHERE NOT is_current),
acc AS (SELECT * FROM ver WHERE from_s <= {THEN} AND (to_s IS NULL OR to_s > {THEN}))
"""


def over(text: str) -> str:
    """A text over the relations; one that begins with a comma has more of them."""
    return f"WITH {RELATIONS.strip()}{text}" if text.startswith(",") else f"WITH {RELATIONS} {text}"


def _tally_sql(combine_sql: Callable[[str, int], str]) -> str:
    when = " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(COMBINE))
    ops = f"raw AS (SELECT user_id AS k, event_id % {COMMITS} AS turn, event_type = 'error' AS gone, CAST(round(value / 4) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id, event_id % {COMMITS} ORDER BY ts DESC, event_id DESC) AS last FROM events), "
    ops += f"o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY turn) AS rn, CAST(1000000 * CASE turn {when} END AS BIGINT) AS us, make_timestamp(0) AS ts, 'w' AS who, gone, v FROM raw WHERE last = 1)"
    return combine_sql(ops, 15_000_000) + "SELECT k AS user_id, v, vf // 1000000 AS from_s, vt // 1000000 AS to_s, db AS deleted_by FROM every"


#: name: (query, DuckDB's text)
STORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "store_versions": (lambda s, d: shown(store(s, d).table("ledger").versions(), "event_type", "value", V.CURRENT), over("SELECT * FROM ver")),
    "store_as_of": (as_of_sql, over("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM acc GROUP BY event_type")),
    "store_view_over_view": (view_over_view, over("SELECT event_type, count(*) AS n FROM acc WHERE value > 50 GROUP BY event_type")),
    "store_join": (join_with_own_view, over("SELECT c_mktsegment, count(*) AS n, count(DISTINCT event_type) AS types FROM acc JOIN customer ON c_custkey = user_id GROUP BY c_mktsegment")),
    "store_history_sql": (history_by_sql, over("SELECT user_id, count(*) AS versions, count(*) FILTER (WHERE is_current) AS present, count(*) FILTER (WHERE NOT is_current) AS closed FROM ver GROUP BY user_id")),
    "store_changes": (
        changes,
        over("""SELECT user_id, from_s AS at_s, changed_by, CASE WHEN p_to = from_s THEN 'UPDATE' ELSE 'INSERT' END AS operation, event_type AS new_type,
                  CASE WHEN p_to = from_s THEN nullif(concat_ws(',', CASE WHEN p_type IS DISTINCT FROM event_type THEN 'event_type' END, CASE WHEN p_value IS DISTINCT FROM value THEN 'value' END), '') END AS changed
                FROM (SELECT *, lag(to_s) OVER w AS p_to, lag(event_type) OVER w AS p_type, lag(value) OVER w AS p_value FROM ver WINDOW w AS (PARTITION BY user_id ORDER BY from_s)) WHERE from_s >= 5 AND from_s < 25
                UNION ALL SELECT user_id, to_s, deleted_by, 'DELETE', NULL, NULL FROM ver WHERE deleted_by IS NOT NULL AND to_s >= 5 AND to_s < 25"""),
    ),
    "store_combine": (combine, _tally_sql),
    "store_excluded": (excluded, over("SELECT c.user_id, 'seen ' || c.event_type AS props, c.changed_by, n AS versions FROM cur c JOIN (SELECT user_id, count(*) AS n FROM ver GROUP BY user_id) USING (user_id)")),
    "merge_from_history": (
        merge,
        over("""SELECT coalesce(c.user_id, a.user_id) AS user_id, CASE WHEN c.user_id IS NULL OR a.value > c.value THEN a.event_type ELSE c.event_type END AS event_type,
                  CASE WHEN c.user_id IS NULL OR a.value > c.value THEN a.value ELSE c.value END AS value, CASE WHEN c.user_id IS NULL OR a.value > c.value THEN 'editor' ELSE c.changed_by END AS changed_by
                FROM cur c FULL JOIN acc a ON a.user_id = c.user_id WHERE NOT (c.user_id IS NOT NULL AND coalesce(a.event_type = 'view', false))"""),
    ),
    "restore": (
        restore,
        over(""", k AS (SELECT min(a.user_id) AS id FROM acc a JOIN cur c ON a.user_id = c.user_id WHERE a.value <> c.value)
                SELECT user_id, event_type, value, from_s, coalesce(to_s, 100) AS to_s, changed_by, deleted_by, false AS is_current FROM ver, k WHERE user_id = id
                UNION ALL SELECT user_id, event_type, value, 100, NULL, 'editor', NULL, true FROM acc, k WHERE user_id = id"""),
    ),
    "restore_deleted": (
        restore_deleted,
        over(""", k AS (SELECT min(user_id) AS id FROM ver WHERE user_id NOT IN (SELECT user_id FROM cur))
                SELECT ver.* FROM ver, k WHERE user_id = id
                UNION ALL SELECT user_id, event_type, value, 100, NULL, 'editor', NULL, true FROM (SELECT * FROM ver, k WHERE user_id = id ORDER BY from_s DESC LIMIT 1)"""),
    ),
    "prune_count": (prune_count, over("SELECT count(*) FILTER (WHERE to_s < 25) AS pruned, count(*) FILTER (WHERE to_s >= 25) AS left FROM hist")),
    "drop_history_before": (drop_history_before, over("SELECT * FROM hist WHERE to_s >= 20")),
    "store_retention": (retention, over("SELECT * FROM hist WHERE to_s >= 25")),
    "store_compact": (
        compact,
        over(""", isl AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY from_s) AS island FROM (
                  SELECT *, CASE WHEN lag(to_s) OVER w = from_s AND lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM hist WINDOW w AS (PARTITION BY user_id ORDER BY from_s)))
                SELECT user_id, min(event_type) AS event_type, min(from_s) AS from_s, max(to_s) AS to_s FROM isl GROUP BY user_id, island"""),
    ),
    "store_schema": (
        schema,
        over("""SELECT 'now' AS age, event_type AS kind, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS old FROM cur GROUP BY event_type
                UNION ALL SELECT 'then', event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 0 FROM acc GROUP BY event_type"""),
    ),
}

QUERIES = {name: query for name, (query, _) in STORE.items()}


def oracle(combine_sql: Callable[[str, int], str]) -> dict[str, str]:
    """combine_sql: versions of a log by recursion."""
    return {name: text(combine_sql) if callable(text) else text for name, (_, text) in STORE.items()}
