from datetime import date

import pytest
from pyspark.sql import functions as F

from chronolake.functions import compat as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).head().x


def test_ranges(spark):
    r = lambda a, b, hi=False: X.make_range(F.lit(a), F.lit(b), True, hi)
    assert one(spark, X.range_contains(r(1, 5), F.lit(1))) and not one(spark, X.range_contains(r(1, 5), F.lit(5)))
    assert one(spark, X.range_contains(r(1, 5, True), F.lit(5)))
    assert not one(spark, X.range_overlaps(r(1, 5), r(5, 9))) and one(spark, X.range_overlaps(r(1, 5, True), r(5, 9)))
    m = F.array(F.struct(F.lit(1).alias("lower"), F.lit(3).alias("upper")), F.struct(F.lit(7).alias("lower"), F.lit(9).alias("upper")))
    assert one(spark, X.multirange_contains(m, F.lit(8))) and not one(spark, X.multirange_contains(m, F.lit(3)))
    assert one(spark, X.multirange_overlaps(m, F.array(F.struct(F.lit(2).alias("lower"), F.lit(4).alias("upper")))))


def test_portion_of(spark):
    df = spark.createDataFrame([("s", date(2024, 1, 1), date(2024, 2, 1), 100)], "sku string, a date, b date, cents int")
    out = X.portion_of(df, "a", "b", date(2024, 1, 10), date(2024, 1, 20), {"cents": F.lit(120)})
    assert sorted((r.a.day, r.b.day, r.cents) for r in out.collect()) == [(1, 10, 100), (10, 20, 120), (20, 1, 100)]


def test_json_maps_trees(spark):
    assert one(spark, X.json_contains(F.lit('{"a": 1, "b": true}'), {"a": 1, "b": True})) and not one(spark, X.json_contains(F.lit('{"a": 1}'), {"c": 1}))
    assert one(spark, F.get_json_object(X.json_set(F.lit('{"a": "1"}'), "a", F.lit(2)), "$.a")) == "2"
    assert one(spark, X.json_path_exists(F.lit('{"a": {"b": 1}}'), "$.a.b"))
    assert one(spark, X.map_contains(F.create_map(F.lit("k"), F.lit("v"), F.lit("l"), F.lit("w")), F.create_map(F.lit("k"), F.lit("v"))))
    assert one(spark, X.array_contains_all(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) and one(spark, X.path_under(F.lit("a.b.c"), "a.b")) and not one(spark, X.path_under(F.lit("a.bc"), "a.b"))


def test_text_net_vector(spark):
    assert one(spark, X.similarity(F.lit("word"), F.lit("word"))) == 1.0 and abs(one(spark, X.similarity(F.lit("word"), F.lit("two words"))) - 4 / 11) < 1e-9
    assert one(spark, X.matches_words(F.lit("The quick fox."), "fox quick")) and not one(spark, X.matches_words(F.lit("The fox."), "foxes"))
    assert one(spark, X.within_subnet(F.lit("10.1.2.3"), F.lit("10.1.0.0/16"))) and not one(spark, X.within_subnet(F.lit("10.2.2.3"), F.lit("10.1.0.0/16")))
    assert one(spark, X.bits(F.lit("1010")).bitwiseAND(X.bits(F.lit("0110")))) == 2
    assert one(spark, X.l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0


def test_walk_marks_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p int, c int")
    found = [(r.node, r.depth, r.cycle) for r in X.walk(edges, "p", "c", F.col("p") == 1).collect()]
    assert found == [(1, 0, False), (2, 1, False), (3, 2, False), (1, 3, True)]


def test_walk_has_no_limit_of_its_own(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(25)], "p int, c int")
    assert [r.depth for r in X.walk(edges, "p", "c", F.col("p") == 0).collect()] == list(range(26))
    assert X.walk(edges, "p", "c", F.col("p") == 20, most=5).count() == 6
    with pytest.raises(ValueError):
        X.walk(edges, "p", "c", F.col("p") == 20, most=4)


def test_portion_of_keeps_open_periods(spark):
    df = spark.createDataFrame([("u", None, date(2024, 1, 15), 1), ("v", date(2024, 1, 15), None, 2), ("w", None, None, 3), ("x", None, date(2024, 1, 5), 4)], "sku string, a date, b date, cents int")
    out = X.portion_of(df, "a", "b", date(2024, 1, 10), date(2024, 1, 20), {"cents": F.lit(9)}).collect()
    day = lambda t: t and t.day
    assert sorted((r.sku, day(r.a) or 0, day(r.b) or 0, r.cents) for r in out) == [
        ("u", 0, 10, 1), ("u", 10, 15, 9), ("v", 15, 20, 9), ("v", 20, 0, 2), ("w", 0, 10, 3), ("w", 10, 20, 9), ("w", 20, 0, 3), ("x", 0, 5, 4)
    ]
    out = X.portion_of(df, "a", "b", date(2024, 1, 10), F.lit(None).cast("date"), {"cents": F.lit(9)}).collect()
    assert sorted((r.sku, day(r.a) or 0, day(r.b) or 0, r.cents) for r in out) == [("u", 0, 10, 1), ("u", 10, 15, 9), ("v", 15, 0, 9), ("w", 0, 10, 3), ("w", 10, 0, 9), ("x", 0, 5, 4)]
