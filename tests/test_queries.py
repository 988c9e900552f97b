"""A selection of the driver's queries on its smallest tables against DuckDB."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from chronolake import queries

SF = "/root/testdata/sf0.001"
NAMES = ["asof_join", "asof_full_join", "changes_all", "compact_history", "combine_replay", "column_history", "same_tx_collapse", "heatmap_bin", "asof_rollup", "asof_recursive"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    columns = sorted(got.columns)
    plain = lambda rows: sorted(str(tuple(round(x, 4) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(zip(*(want[c].to_pylist() for c in columns)))


def test_every_query_has_its_sql_or_a_reason():
    left = set(entry.queries()) - set(entry.oracle_sql())
    assert all(n == "pipeline" or n.startswith("op") for n in left)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_left_join_and_recursion_cover_the_whole_table(spark):
    table = "/root/testdata/sf0.01"
    customers = {r.c_custkey for r in spark.read.parquet(f"{table}/customer.parquet").select("c_custkey").collect()}
    left = [r.c_custkey for r in entry.queries()["asof_left_join"](spark, table).select("c_custkey").collect()]
    assert len(left) == len(customers) and set(left) == customers
    users = {r.user_id for r in entry.queries()["asof_scan"](spark, table).select("user_id").collect()}
    hops = [(r.root, r.depth, r.user_id) for r in entry.queries()["asof_recursive"](spark, table).collect()]
    want = []
    for user in users:
        root, depth = user, 0
        want.append((root, depth, user))
        while root // 2 < root and root // 2 in users:
            root, depth = root // 2, depth + 1
            want.append((root, depth, user))
    assert sorted(hops) == sorted(want) and max(depth for _, depth, _ in want) > 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_updates_of_excluded_columns_make_no_version(spark):
    log = queries.props_log(spark, SF)
    events, left = spark.read.parquet(f"{SF}/events.parquet"), queries.event_log(spark, SF).filter("not gone")
    assert log.count() == events.count() + left.count()
    found = queries.replay.by_lead(log, queries.KEY, queries.VALUES, "ts", "who", "gone", ["props"]).collect()
    assert len(found) == left.count() and all(r.props.startswith("later than ") and r.changed_by != "props" for r in found)
    # without the rule for excluded columns each such update is a version of its own
    assert queries.replay.by_lead(log, queries.KEY, [*queries.VALUES, "props"], "ts", "who", "gone").count() == 2 * left.count()
    test_query_equals_its_sql(spark, "excluded_only")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_drop_history_before(spark):
    test_query_equals_its_sql(spark, "drop_history_before")


REPEATED = ["asof_cube", "asof_date_math", "asof_grouping_sets", "asof_ordered_aggregate", "asof_rollup", "asof_scan", "asof_unnest", "changes_all", "changes_columns", "changes_composed", "changes_key_split", "changes_lineage", "changes_range", "changes_window", "temporal_all", "excluded_only", "asof_json"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """events of three users in which most repeat type and value of the user's event before."""
    folder, first = tmp_path_factory.mktemp("repeated"), datetime(2024, 1, 8)
    kinds = [("click", 5.0), ("click", 5.0), ("click", 5.0), ("view", 5.0), ("view", 5.0), ("error", 5.0), ("error", 5.0), ("view", 5.0), ("view", 5.0)]
    rows = [(3 * k + (u + k) % 3, first + timedelta(hours=20 * k + u), u, *kinds[(k + u) % len(kinds)], '{"k": 1}') for k in range(18) for u in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", REPEATED)
def test_an_event_that_repeats_the_values_is_a_version(spark, repeated, name):
    con = duckdb.connect()
    for file in ("events", "orders"):
        con.execute(f"CREATE VIEW {file} AS SELECT * FROM '{repeated}/{file}.parquet/*.parquet'")
    got = entry.queries()[name](spark, repeated)
    columns = sorted(got.columns)
    plain = lambda rows: sorted(str(tuple(tuple(x) if isinstance(x, list) else x for x in r)) for r in rows)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want and plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want)


@pytest.fixture(scope="module")
def odd(spark, repeated, tmp_path_factory):
    """The events of ``repeated`` for 30 users, some values null and NaN, one event of every other user at no time."""
    folder = tmp_path_factory.mktemp("odd")
    found = spark.read.parquet(f"{repeated}/events.parquet").crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    value = "CASE copy WHEN 3 THEN NULL WHEN 5 THEN double('NaN') WHEN 7 THEN NULL ELSE value + copy END AS value"
    found.selectExpr("event_id + 54 * copy AS event_id", "CASE WHEN copy % 2 = 0 AND event_id IN (9, 19, 53) THEN NULL ELSE ts END AS ts", "user_id + 3 * copy AS user_id", "event_type", value, "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{repeated}/orders.parquet").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_null_values_come_last_in_an_ordered_aggregate(spark, odd):
    test_an_event_that_repeats_the_values_is_a_version(spark, odd, "asof_ordered_aggregate")


def test_days_are_the_same_in_every_time_zone(spark, repeated):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_an_event_that_repeats_the_values_is_a_version(spark, repeated, "asof_date_math")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["changes_all", "changes_columns", "changes_composed", "changes_key_split", "changes_lineage", "changes_range", "column_history"])
def test_an_event_at_no_time_comes_last(spark, odd, name):
    test_an_event_that_repeats_the_values_is_a_version(spark, odd, name)


def test_recursion_has_no_limit_of_rows(spark, repeated):
    whole = entry.queries()["asof_recursive"](spark, repeated).count()
    spark.conf.set("spark.sql.cteRecursionRowLimit", 1)
    try:
        assert whole > 1 and entry.queries()["asof_recursive"](spark, repeated).count() == whole
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
