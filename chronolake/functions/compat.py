"""Column helpers for operators that Spark SQL has no function for; all run in the JVM."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# vectors


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers."""
    part = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x))


# ranges: struct<lower, upper, lower_inc, upper_inc>; a null bound is open


def make_range(lower: Column, upper: Column, lower_inc: bool = True, upper_inc: bool = False) -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(lower_inc).alias("lower_inc"), F.lit(upper_inc).alias("upper_inc"))


def range_contains(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (r["lower"] < x) | (r["lower_inc"] & (r["lower"] == x))
    high = r["upper"].isNull() | (r["upper"] > x) | (r["upper_inc"] & (r["upper"] == x))
    return low & high


def range_overlaps(a: Column, b: Column) -> Column:
    def below(x: Column, y: Column) -> Column:
        return x["lower"].isNull() | y["upper"].isNull() | (x["lower"] < y["upper"]) | ((x["lower"] == y["upper"]) & x["lower_inc"] & y["upper_inc"])

    return below(a, b) & below(b, a)


# multiranges: array<struct<lower, upper>>, half-open


def multirange_contains(m: Column, x: Column) -> Column:
    return F.exists(m, lambda r: (r["lower"] <= x) & (r["upper"] > x))


def multirange_overlaps(m: Column, n: Column) -> Column:
    return F.exists(m, lambda r: F.exists(n, lambda s: (r["lower"] < s["upper"]) & (s["lower"] < r["upper"])))


def portion_of(df: DataFrame, start: str, end: str, a, b, changed: dict[str, Column]) -> DataFrame:
    """Rows with application time [start, end): the part in [a, b) with other values, the parts before and after as they were.

    A null bound, of a row or of the portion, is open.
    """
    a, b = (F.lit(x) if not isinstance(x, Column) else x for x in (a, b))
    either = lambda x: F.coalesce(x, F.lit(True))
    hit = either(F.col(start) < b) & either(F.col(end) > a)
    inside = df.filter(hit).withColumns({start: F.greatest(F.col(start), a), end: F.least(F.col(end), b)} | changed).select(*df.columns)
    before = df.filter(hit & a.isNotNull() & either(F.col(start) < a)).withColumn(end, a.cast(df.schema[end].dataType))
    after = df.filter(hit & b.isNotNull() & either(F.col(end) > b)).withColumn(start, b.cast(df.schema[start].dataType))
    return df.filter(~hit).unionByName(inside).unionByName(before).unionByName(after)


# JSON as text


def json_contains(text: Column, flat: dict) -> Column:
    """Whether a JSON object has these scalar members."""
    found = F.lit(True)
    for k, v in flat.items():
        wanted = str(v).lower() if isinstance(v, bool) else str(v)
        found = found & (F.get_json_object(text, f"$.{k}") == F.lit(wanted))
    return F.coalesce(found, F.lit(False))


def json_set(text: Column, key: str, value: Column) -> Column:
    """A JSON object with one member set; members become texts."""
    members = F.from_json(text, "map<string,string>")
    return F.to_json(F.map_concat(F.map_filter(members, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string"))))


def json_path_exists(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).isNotNull()


# maps, arrays, trees


def map_contains(m: Column, part: Column) -> Column:
    """Whether every entry of part is one of m."""
    return F.forall(F.map_entries(part), lambda e: F.coalesce(F.element_at(m, e["key"]) == e["value"], F.lit(False)))


def array_contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def path_under(path: Column, ancestor: str) -> Column:
    """Whether a dotted path is ancestor or lies below it."""
    return (path == ancestor) | path.startswith(f"{ancestor}.")


# text


def trigrams(text: Column) -> Column:
    """The distinct runs of three letters of each word, words padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def matches_words(text: Column, query: str) -> Column:
    """Whether text has all words of query, without stemming."""
    return array_contains_all(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*(F.lit(w) for w in query.lower().split())))


# addresses and bits


def ipv4(text: Column) -> Column:
    """An address, without its prefix length, as a number."""
    part = lambda k: F.split(F.split(text, "/")[0], r"\.")[k].cast("bigint")
    return ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)


def within_subnet(address: Column, subnet: Column) -> Column:
    """Whether an IPv4 address lies in a subnet a.b.c.d/n."""
    span = F.pow(F.lit(2.0), 32 - F.coalesce(F.split(subnet, "/")[1].cast("int"), F.lit(32))).cast("bigint")
    return F.floor(ipv4(address) / span) == F.floor(ipv4(subnet) / span)


def bits(text: Column) -> Column:
    """A text of 0 and 1 as a number, for & and |."""
    return F.conv(text, 2, 10).cast("bigint")


# recursion


def walk(edges: DataFrame, parent: str, child: str, start: Column, most: int | None = None) -> DataFrame:
    """node, depth, path and cycle, depth first in order of path: each step a join, nodes on the path end it.

    With most, a walk of more steps is an error.
    """
    step = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c"))
    level = edges.filter(start).select(F.col(parent).alias("node")).distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("cycle"))
    found = level
    for depth in count(1):
        nxt = level.filter(~F.col("cycle")).join(step, F.col("node") == F.col("_p")).select(F.col("_c").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("_c")).alias("path"), F.array_contains("path", F.col("_c")).alias("cycle"))
        # written, so that a deep walk doesn't do all steps again for each step
        nxt = written(nxt, f"level{depth}")
        if nxt.isEmpty():
            break
        if most is not None and depth > most:
            raise ValueError(f"the walk has more than {most} steps")
        level, found = nxt, found.unionByName(nxt)
    return found.orderBy("path")
