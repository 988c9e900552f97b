"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ``window`` words (an item of fewer is one
window).  A document holds a window exactly when it holds all its shingles of
``shingle`` words, so it is enough to join on one of them, the necessary prefix: the
rarest, by its count in the whole corpus.  A match fixes where the window would start;
starts outside the document are dropped (length and position), and the words of the
document at that place are compared with the window's.

The join is a broadcast one up to ``BROADCAST_ROWS`` shingles of windows that take
``BROADCAST_BYTES`` with their items, both summed beforehand; larger benchmarks are joined by a shuffle of (shingle hash, document, position) first and
verified after a second join with the documents.

Null and empty texts have no words: no document of them is hit and no item of them has
a window.  Items that repeat an id count once; windows of an item with a null id mark
words but add no item.  Documents that repeat an id are told apart by their text, and
every row is returned.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: What parts words, once A-Z are lower case: ASCII without digits and small letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), lambda x: x != "")


def windows_of(benchmark: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """win (the words), size, items (sorted ids) of each distinct window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item", F.explode(starts).alias("at"), "w").select("item", F.slice("w", F.col("at") + 1, window).alias("win"))
    return each.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """win, items, size and, for each of its shingles, k (words), h (hash) and off (place in the window)."""
    sized = windows.withColumn("size", F.size("win")).withColumn("k", F.least("size", F.lit(shingle)))
    each = sized.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
    return each.withColumn("h", F.xxhash64(F.array_join(F.slice("win", F.col("off") + 1, F.col("k")), " ")))


def positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Each word position of docs with the hashes of the shingles that begin there, and one sentinel for each document."""
    spread = docs.select("*", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "_word"))
    part = lambda k: F.struct(F.lit(k).alias("k"), F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(F.concat_ws(" ", *(F.get("w", F.col("pos") + i) for i in range(k))))).alias("h"))
    if len(sizes) == 1:
        return spread.drop("_word").withColumn("s", part(sizes[0])).select("*", "s.k", "s.h").drop("s")
    return spread.drop("_word").select("*", F.inline(F.array(*(part(k) for k in sizes))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parted = rows.select("doc_id", F.xxhash64("t").alias("th"), words(F.col("t")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    windows = windows_of(benchmark, window, shingle, item_col, item_text_col)
    shingles = materialize(shingles_of(windows, shingle), "shingles")
    sizes = sorted(x[0] for x in shingles.select("k").distinct().collect())  # 1 to shingle
    if not sizes:
        sizes = [shingle]
    held = F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 32
    size = shingles.agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).head()
    small = size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda x: x

    # rarity over the whole corpus: how often each shingle of the benchmark occurs
    known = shingles.select("k", "h").distinct()
    spread = positions(parted, sizes)
    occurring = spread.select("k", "h").filter("h is not null").join(hint(known), ["k", "h"])
    counts = occurring.groupBy("k", "h").agg(F.count("*").alias("often"))
    # a shingle that occurs nowhere rules its window out
    ranked = shingles.join(counts, ["k", "h"], "left").groupBy("win", "items", "size").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "off", "k", "h")).alias("p"))
    prefix = materialize(ranked.filter("p.often > 0").select("win", "items", "size", F.col("p.k").alias("pk"), F.col("p.h").alias("ph"), F.col("p.off").alias("off")), "prefix")

    place = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("size") <= F.col("n_words"))
    same = F.slice("w", F.greatest(F.col("pos") - F.col("off") + 1, F.lit(1)), F.col("size")) == F.col("win")
    key = (F.col("h") == F.col("ph")) & (F.col("k") == F.col("pk"))
    start = F.struct((F.col("pos") - F.col("off")).alias("a"), (F.col("pos") - F.col("off") + F.col("size")).alias("b"))
    if small:
        found = spread.join(F.broadcast(prefix), key & place & same, "left").filter("pos = n_words or win is not null")
        marks = found.select("doc_id", "th", "n_words", F.when(F.col("win").isNotNull(), start).alias("hit"), "items", ((F.col("pos") == F.col("n_words")) & (F.col("k") == sizes[0])).alias("row"))
    else:
        lean = spread.select("doc_id", "th", "n_words", "pos", "k", "h").filter("h is not null")
        near = lean.join(prefix, key & place).select("doc_id", "th", "pos", "off", "size", "win", "items")
        sure = near.alias("n").join(parted.dropDuplicates(["doc_id", "th"]).alias("p"), F.col("n.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("n.th") == F.col("p.th"))).select("p.doc_id", "p.th", "p.n_words", "p.w", "n.pos", "n.off", "n.size", "n.win", "n.items").filter(same)
        marks = sure.select("doc_id", "th", "n_words", start.alias("hit"), "items", F.lit(False).alias("row")).unionByName(
            parted.select("doc_id", "th", "n_words", F.lit(None).cast("struct<a:int,b:int>").alias("hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(True).alias("row"))
        )
    # a document's own hits only: no more than its words
    by_doc = marks.groupBy("doc_id", "th", "n_words").agg(F.sort_array(F.collect_set("hit")).alias("hits"), F.collect_set("items").alias("lists"), F.count_if("row").alias("copies"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"))
    ids = F.sort_array(F.array_distinct(F.flatten("lists")))
    out = by_doc.select("doc_id", "th", "n_words", F.aggregate("hits", zero, step, lambda acc: acc["n"]).cast("long").alias("n_hit"), ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return out.select("doc_id", F.col("th").alias("text_hash"), "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without a word in a window of the benchmark."""
    hit = decontaminate(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("_cl_id"), F.col("text_hash").alias("_cl_th")).distinct()
    key = F.col("doc_id").eqNullSafe(F.col("_cl_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_cl_th"))
    return docs.join(hit, key, "left_anti")
