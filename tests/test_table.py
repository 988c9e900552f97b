"""Golden scenarios of tracked tables, with a clock that the tests move."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronolake.config import TableConfig
from chronolake.errors import InvalidInstant, NotAllowed, NotNullViolation, NotSupported, NullInstant, ReadOnlyAsOf, StaleWriter, TemporalError, UniqueViolation, UnknownTable
from chronolake.plans.session import TemporalSession

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ZERO = timedelta(0)


class Clock:
    def __init__(self):
        self.t = T0

    def __call__(self):
        return self.t

    def move(self, seconds):
        self.t += timedelta(seconds=seconds)
        return self.t


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def session(spark, tmp_path, clock):
    return TemporalSession(spark, f"file://{tmp_path}", user_id="alice", clock=clock, buckets=2)


def items(session, rows=((1, "a", "x"),), interval=ZERO, **settings):
    df = session.spark.createDataFrame(list(rows), "id int, name string, note string")
    return session.enable("items", df, TableConfig(key=("id",), combine_interval=interval, **settings))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def row(session, *values):
    return session.spark.createDataFrame([values], "id int, name string, note string")


def test_versions_as_of_changes_and_restore(session, clock):
    t = items(session, excluded=("note",))
    clock.move(10)
    with session.as_user("bob"):
        t.update({"name": F.lit("b")}, F.col("id") == 1)
        clock.move(10)
        t.update({"note": F.lit("y")}, F.col("id") == 1)  # excluded: no version, old stamps
    assert t.history().count() == 1
    assert rows(t.current(), "name", "note", "changed_by", "valid_from") == [("b", "y", "bob", (T0 + timedelta(seconds=10)).replace(tzinfo=None))]
    assert rows(t.as_of(T0), "name") == [("a",)]
    assert rows(t.as_of(T0 + timedelta(seconds=10)), "name") == [("b",)]
    assert rows(t.as_of(T0 - timedelta(seconds=1)), "name") == []
    clock.move(10)
    with session.as_user("carol"):
        t.delete(F.col("id") == 1)
    found = [(r.operation, r.changed_by, r.changed_columns) for r in t.changes().collect()]
    assert found == [("INSERT", "alice", None), ("UPDATE", "bob", ["name"]), ("DELETE", "carol", None)]
    assert rows(t.column_history({"id": 1}, "name"), "value") == [("a",), ("b",)]
    clock.move(10)
    assert t.restore_deleted({"id": 1}) == 1
    with pytest.raises(TemporalError):
        t.restore_deleted({"id": 1})
    clock.move(10)
    t.restore({"id": 1}, T0)
    assert rows(t.current(), "name") == [("a",)]
    assert rows(t.stats(), "base_rows", "history_rows", "version_rows") == [(1, 3, 4)]
    assert t.from_to(T0, T0 + timedelta(seconds=10)).count() == 1
    assert t.between(T0, T0 + timedelta(seconds=10)).count() == 2
    assert t.contained_in(T0, T0 + timedelta(seconds=30)).count() == 2


def test_combine_chain_and_collapse(session, clock):
    t = items(session, interval=timedelta(seconds=5))
    clock.move(4)
    t.update({"name": F.lit("v1")})  # collapses into the insert
    assert t.history().count() == 0 and rows(t.as_of(T0), "name") == [("v1",)]
    clock.move(6)
    with session.as_user("bob"):
        for k in range(3):
            t.update({"name": F.lit(f"w{k}")})
            clock.move(4)
    assert rows(t.history(), "name", "valid_to") == [("v1", (T0 + timedelta(seconds=18)).replace(tzinfo=None))]
    assert rows(t.as_of(T0 + timedelta(seconds=12)), "name") == [("v1",)]  # before the burst
    with session.as_user(None):
        t.update({"name": F.lit("x")})
        t.update({"name": F.lit("y")})
    assert t.history().count() == 2  # same instant combines, no user never does otherwise


def test_one_transaction(session, clock):
    t = items(session)
    clock.move(5)
    with session.transaction():
        t.insert(row(session, 2, "n", None))
        t.update({"name": F.lit("m")}, F.col("id") == 2)
        t.delete(F.col("id") == 2)
        t.update({"name": F.lit("c")}, F.col("id") == 1)
        t.delete(F.col("id") == 1)
    assert rows(t.history(), "id", "name", "deleted_by") == [(1, "a", None)] and t.current().count() == 0
    clock.move(5)
    with pytest.raises(ZeroDivisionError), session.transaction():
        t.insert(row(session, 3, "z", None))
        raise ZeroDivisionError
    assert t.current().count() == 0
    with session.transaction():
        t.insert(row(session, 4, "k", None))
        with pytest.raises(ZeroDivisionError), session.transaction():
            t.insert(row(session, 5, "k", None))
            raise ZeroDivisionError
    assert rows(t.current(), "id") == [(4,)]


def test_dml_shapes(session, clock):
    t = items(session, [(1, "a", "x"), (2, "b", "y")])
    clock.move(1)
    given = session.spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    assert t.upsert(given) == 2
    assert rows(t.current().fillna("-"), "id", "name", "note") == [(1, "a", "x"), (2, "B", "y"), (3, "C", "-")]
    clock.move(1)
    assert t.insert(row(session, 3, "again", None), on_conflict="nothing") == 0
    with pytest.raises(UniqueViolation):
        t.insert(row(session, 3, "again", None))
    with pytest.raises(NotNullViolation):
        t.insert(row(session, None, "again", None))
    clock.move(1)
    n = t.merge(given, update={"name": F.concat("t.name", "s.name")}, delete_when=F.col("s.id") == 3, insert={"id": F.col("s.id"), "name": F.col("s.name")})
    assert n == 2 and rows(t.current(), "id", "name") == [(1, "a"), (2, "BB")]
    clock.move(1)
    t.update({"name": F.col("extra")}, source=session.spark.createDataFrame([(1, "from")], "id int, extra string"))
    t.delete(source=session.spark.createDataFrame([(2,)], "id int"))
    assert rows(t.current(), "id", "name") == [(1, "from")]
    clock.move(1)
    t.update({"id": F.lit(99)}, F.col("id") == 1)  # the old key keeps its history
    assert rows(t.history().filter("id in (1, 99)"), "id", "name", "deleted_by")[-1] == (1, "from", None)
    with pytest.raises(NotSupported):
        t.truncate()


def test_guards(session, clock):
    t = items(session)
    with session.as_of(T0):
        for call in (lambda: t.insert(row(session, 9, "q", None)), lambda: t.delete(), lambda: t.update({"name": F.lit("q")})):
            with pytest.raises(ReadOnlyAsOf):
                call()
        for call in (t.changes, t.stats, lambda: t.column_history({"id": 1}, "name"), lambda: t.restore({"id": 1}, T0), session.run_due_policies):
            with pytest.raises(TemporalError):
                call()
    session.require_user = True
    with session.as_user(""), pytest.raises(NotAllowed):
        t.insert(row(session, 9, "q", None))
    clock.t = T0 - timedelta(seconds=1)
    with pytest.raises(StaleWriter):
        t.update({"name": F.lit("late")})
    with pytest.raises(UnknownTable):
        session.table("other")
    a = TemporalSession(session.spark, session.store.path, user_id="x", clock=clock)
    clock.t = T0 + timedelta(seconds=5)
    with pytest.raises(StaleWriter), a.transaction():
        a.table("items").update({"name": F.lit("mine")})
        t.update({"name": F.lit("theirs")})


def test_enable_refusals(session):
    df = session.spark.createDataFrame([(1, "a")], "id int, name string")
    for config in (TableConfig(key=()), TableConfig(key=("no",)), TableConfig(key=("id",), excluded=("id",)), TableConfig(key=("id",), excluded=("no",)), TableConfig(key=("id",), combine_interval=timedelta(seconds=-1))):
        with pytest.raises(TemporalError):
            session.enable("bad", df, config)
    with pytest.raises(TemporalError):
        session.enable("bad", df.withColumn("valid_to", F.lit(1)), TableConfig(key=("id",)))
    with pytest.raises(TemporalError):
        session.enable("bad", df.withColumn("valid_from", F.lit("x")), TableConfig(key=("id",)))
    session.enable("t", df, TableConfig(key=("id",)))
    with pytest.raises(TemporalError):
        session.enable("t", df, TableConfig(key=("id",)))


def test_sql(session, clock):
    t = items(session)
    roles = session.enable("ns.roles", session.spark.createDataFrame([(1, "Admin")], "id int, title string"), TableConfig(key=("id",)))
    clock.move(10)
    t.update({"name": F.lit("b")})
    roles.update({"title": F.lit("Owner")})
    q = "SELECT i.name, r.title FROM items i JOIN ns.roles r ON r.id = i.id"
    assert rows(session.sql(q), "*") == [("b", "Owner")]
    assert rows(session.sql(q + " WHERE temporal.as_of('2024-01-01 00:00:05')"), "*") == [("a", "Admin")]
    assert rows(session.sql(q + " WHERE temporal.as_of(:t) AND i.id = :n", t=T0, n=1), "*") == [("a", "Admin")]
    with session.as_of("2024-01-01T00:00:05Z"):
        pinned = session.sql(q)
        assert rows(session.sql("WITH x AS (SELECT * FROM items) SELECT name, (SELECT max(title) FROM ns.roles) AS m FROM x"), "*") == [("a", "Admin")]
        with pytest.raises(NotSupported):
            session.sql("SELECT * FROM items TABLESAMPLE (10 PERCENT)")
        with pytest.raises(ReadOnlyAsOf):
            session.sql("DELETE FROM items")
    assert rows(pinned, "*") == [("a", "Admin")]
    assert "Union" in session.sql("SELECT * FROM items WHERE temporal.as_of('2024-01-01')")._jdf.queryExecution().toString()
    session.create_view("past", "SELECT name FROM items WHERE temporal.as_of('2024-01-01')")
    session.create_view("now_or_then", "SELECT name FROM items")
    assert rows(session.sql("SELECT * FROM past"), "*") == [("a",)] and rows(session.sql("SELECT * FROM now_or_then"), "*") == [("b",)]
    with session.as_of(T0):
        assert rows(session.sql("SELECT * FROM now_or_then"), "*") == [("a",)]
    for bad, error in (("temporal.as_of(NULL)", NullInstant), ("temporal.as_of(now_ts)", NotSupported), ("temporal.as_of('2024-01-01') AND temporal.as_of('2024-01-02')", NotSupported), ("temporal.as_of('soon')", InvalidInstant)):
        with pytest.raises(error):
            session.sql(f"SELECT * FROM items WHERE {bad}")
    assert session.sql("SELECT * FROM items WHERE temporal.as_of('2024-01-01') AND temporal.as_of('2024-01-01')").count() == 1
    assert session.sql("SELECT * FROM items__versions").count() == 2


def test_maintenance_and_policies(session, clock):
    t = items(session)
    for k in range(3):
        clock.move(10)
        t.update({"note": F.lit(f"n{k}")})
    assert t.history().count() == 3
    t.drop_column("note")
    assert t.compact_history() == 2 and t.history().count() == 1
    assert rows(t.history(), "valid_from", "valid_to") == [(T0.replace(tzinfo=None), (T0 + timedelta(seconds=30)).replace(tzinfo=None))]
    assert t.prune(T0 + timedelta(seconds=30)) == 0 and t.prune(T0 + timedelta(seconds=31)) == 1
    session.add_policy("items", "retention", timedelta(0), timedelta(days=1))
    session.add_policy("items", "compaction")
    assert session.run_due_policies() == 2 and session.run_due_policies() == 0
    clock.move(86_400)
    assert session.run_due_policies() == 2
    with pytest.raises(TemporalError):
        session.add_policy("items", "retention", timedelta(seconds=-1))
    session.disable("items")
    assert session.policies().count() == 0
    again = session.enable("items2", row(session, 1, "n", None).drop("note"), TableConfig(key=("id",)), history="items")
    assert again.history().columns[-2:] == ["valid_to", "deleted_by"]


def test_schema_evolution(session, clock):
    t = items(session)
    clock.move(10)
    t.update({"name": F.lit("b")})
    t.add_column("score", "int", default=7)
    clock.move(10)
    t.rename_column("name", "label")
    t.alter_column_type("score", "bigint")
    assert rows(t.current(), "label", "score") == [("b", 7)] and rows(t.as_of(T0), "label", "score") == [("a", None)]
    assert dict(t.history().dtypes)["score"] == "bigint"
    for call in (lambda: t.rename_column("valid_from", "x"), lambda: t.drop_column("id"), lambda: t.add_column("valid_to", "int"), lambda: t.set_excluded_columns(["id"])):
        with pytest.raises(TemporalError):
            call()
    session.rename_table("items", "archive.items")
    assert session.table("archive.items").history().count() == 1


def test_lineage(session, clock):
    t = items(session, lineage=True)
    for k, user in ((2, "b"), (99, "c")):
        clock.move(10)
        with session.as_user(user):
            t.update({"id": F.lit(k)})
    found = t.changes(pk={"id": 99}).collect()
    assert [(r.operation, r.changed_columns) for r in found] == [("INSERT", None), ("UPDATE", ["id"]), ("UPDATE", ["id"])]
    assert t.versions().select("temporal_row_id").distinct().count() == 1


def test_drop_history_before(session, clock):
    t = items(session)
    for k in range(4):
        clock.move(10)
        t.update({"name": F.lit(f"n{k}")}, F.col("id") == 1)
    assert t.history().count() == 4
    ends = lambda: [int((r[0] - T0.replace(tzinfo=None)).total_seconds()) for r in rows(t.history(), "valid_to")]
    t.drop_history_before(T0 + timedelta(seconds=20))  # the version that ends at the cutoff stays
    assert ends() == [20, 30, 40] and t.current().count() == 1
    t.drop_history_before(T0 + timedelta(seconds=41))
    assert ends() == [] and rows(t.current(), "name") == [("n3",)]


def test_markers_in_texts_and_comments_are_none(session, clock):
    items(session)
    clock.move(10)
    session.table("items").update({"name": F.lit("b")}, F.col("id") == 1)
    q = "SELECT name, 'temporal.as_of(NULL)' AS said, \"DELETE FROM items\" AS more FROM items -- temporal.as_of('2024-01-01')\n/* TABLESAMPLE temporal.as_of('x') */ WHERE note <> 'it''s temporal.as_of(1)'"
    assert rows(session.sql(q), "*") == [("b", "temporal.as_of(NULL)", "DELETE FROM items")]
    assert rows(session.sql(q + " AND temporal.as_of('2024-01-01')"), "name") == [("a",)]


def test_views_over_views_travel(session, clock):
    items(session)
    clock.move(10)
    session.table("items").update({"name": F.lit("b")}, F.col("id") == 1)
    session.create_view("inner_view", "SELECT id, name FROM items")
    session.create_view("outer_view", "WITH x AS (SELECT * FROM inner_view) SELECT upper(name) AS loud FROM x")
    assert rows(session.sql("SELECT * FROM outer_view"), "*") == [("B",)]
    assert rows(session.sql("SELECT * FROM outer_view WHERE temporal.as_of('2024-01-01 00:00:05')"), "*") == [("A",)]
    session.create_view("marked", "SELECT * FROM outer_view WHERE temporal.as_of('2024-01-01 00:00:05')")
    assert rows(session.sql("SELECT m.loud, i.name FROM marked m, items i"), "*") == [("A", "a")]
    session.create_view("loop", "SELECT * FROM loop")
    with pytest.raises(TemporalError):
        session.sql("SELECT * FROM loop")


def test_sql_sees_the_users_session(session, clock, spark):
    items(session)
    spark.createDataFrame([(1, "mine")], "id int, tag string").createOrReplaceTempView("my_tags")
    spark.udf.register("shout", lambda x: x + "!", "string")
    assert rows(session.sql("SELECT items.name, tag, shout(tag) AS s FROM items JOIN my_tags ON my_tags.id = items.id"), "*") == [("a", "mine", "mine!")]
    assert rows(session.sql("WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 3) SELECT k, name FROM n, `items`"), "*") == [(1, "a"), (2, "a"), (3, "a")]
    session.sql("CREATE OR REPLACE TEMPORARY VIEW frozen AS SELECT name FROM my_tags JOIN VALUES ('z') AS v(name)")
    assert rows(spark.table("frozen"), "*") == [("z",)]
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("_chronolake")]
    for bad in ("INSERT INTO `items` SELECT 1", "/* x */ DELETE FROM items", "WITH a AS (SELECT 1) INSERT INTO items SELECT * FROM a"):
        with pytest.raises(NotSupported):
            session.sql(bad)


def test_a_commit_is_whole_or_absent(session, clock, spark):
    items(session)
    store = session.store
    version, state = store.latest()
    # a writer that died left a draft
    fs, draft = store._fs(f"{store.path}/_log/_draft-dead")
    fs.create(draft, False).close()
    assert store.latest() == (version, state)
    assert store.commit(version, state) == version + 1
    with pytest.raises(StaleWriter):
        store.commit(version, state)
    assert store.latest()[0] == version + 1


def test_clone_shares_data_and_no_commits(session, clock, tmp_path):
    items(session)
    other = session.clone(f"file://{tmp_path}/clone")
    clock.move(10)
    other.table("items").delete(F.col("id") == 1)
    assert session.table("items").current().count() == 1 and other.table("items").current().count() == 0
    assert not session.pins


def test_a_statement_is_few_jobs_and_leaves_no_scratch_rows(session, clock):
    t = items(session, [(k, "a", "x") for k in range(20)])
    clock.move(10)
    source = session.spark.createDataFrame([(k, "b", "y") for k in range(10, 30)], "id int, name string, note string")
    context = session.spark.sparkContext
    context.setJobGroup("statement", "an upsert")
    assert t.upsert(source) == 20
    context.setJobGroup("none", "")
    assert len(context.statusTracker().getJobIdsForGroup("statement")) <= 14
    assert rows(t.current().groupBy("name").count(), "name", "count") == [("a", 10), ("b", 20)]
    assert (t.history().count(), sorted(t.state["base"])) == (10, ["0", "1"])
    with pytest.raises(UniqueViolation):
        t.upsert(source.unionByName(source))
    assert session.pins == []


def test_keys_that_move_onto_others_are_refused_and_may_swap(session, clock):
    t = items(session, [(k, "a", "x") for k in range(4)])
    clock.move(10)
    with pytest.raises(UniqueViolation):
        t.update({"id": F.lit(3)}, F.col("id") == 1)
    with pytest.raises(UniqueViolation):
        t.update({"id": F.lit(9)}, F.col("id") < 2)
    with pytest.raises(UniqueViolation):  # 1.4 has no match, but arrives as 1
        t.upsert(session.spark.createDataFrame([(1.4, "b")], "id double, name string"))
    assert t.update({"id": 3 - F.col("id")}) == 4
    assert rows(t.versions(), "id", "is_current") == [(k, now) for k in range(4) for now in (False, True)]
