"""Log replay against a row-by-row simulation of the write rules, and properties of versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import maintain as M
from chronolake.operators import versions as V
from chronolake.plans import replay

T0 = datetime(2024, 1, 1)


def simulate(log, interval):
    """Versions by applying one operation after another."""
    out = []
    for key in sorted({x[0] for x in log}):
        cur, hist = None, []
        for _, _, sec, who, gone, v in sorted(x for x in log if x[0] == key):
            if cur is None:
                cur = None if gone else [v, sec, who]
            elif gone:
                if cur[1] != sec:
                    hist.append([*cur, sec, who])
                cur = None
            elif cur[0] != v:
                near = cur[1] == sec or interval > 0 and who is not None and cur[2] == who and sec - cur[1] <= interval
                chain = next((h for h in hist if h[3] == cur[1]), None)
                if near and chain:
                    chain[3] = sec
                    cur = [v, sec, who]
                elif near:
                    cur = [v, cur[1], who]
                else:
                    hist.append([*cur, sec, None])
                    cur = [v, sec, who]
        out += [(key, *h, False) for h in hist] + ([(key, *cur, None, None, True)] if cur else [])
    return sorted(out, key=str)


def as_frame(spark, log):
    rows = [(k, n, T0 + timedelta(seconds=s), who, gone, v) for k, n, s, who, gone, v in log]
    return spark.createDataFrame(rows, "k int, n int, ts timestamp_ntz, who string, gone boolean, v int")


def folded(spark, log, interval):
    found = replay.fold(as_frame(spark, log), ["k"], ["v"], "ts", "who", "gone", ["n"], interval * 1_000_000)
    second = lambda t: None if t is None else int((t - T0).total_seconds())
    return sorted(((r.k, r.v, second(r.valid_from), r.changed_by, second(r.valid_to), r.deleted_by, r.is_current) for r in found.collect()), key=str)


def random_log(seed, keys=40, ops=14):
    rng = random.Random(seed)
    log = []
    for k in range(keys):
        sec = 0
        for n in range(ops):
            sec += rng.choice((0, 0, 1, 2, 4, 5, 6, 9))
            log.append((k, n, sec, rng.choice(("a", "a", "a", "b", None)), rng.random() < 0.2, rng.randrange(4)))
    return log


@pytest.mark.parametrize("interval", [0, 5])
def test_fold_follows_the_write_rules(spark, interval):
    log = random_log(interval + 1)
    assert folded(spark, log, interval) == simulate(log, interval)


def test_worked_examples(spark):
    log = [(1, n, s, w, False, n) for n, (s, w) in enumerate([(0, "a"), (10, "b"), (14, "b"), (18, "b"), (24, "b")])]
    log += [(2, 0, 0, "a", False, 0), (2, 1, 4, "a", False, 1), (2, 2, 8, "a", False, 2)]
    log += [(3, 0, 0, "a", False, 0), (3, 1, 10, "b", False, 1), (3, 2, 10, "b", True, 0)]
    log += [(4, 0, 0, "a", False, 0), (4, 1, 10, "b", True, 0), (4, 2, 10, "b", False, 1)]
    assert folded(spark, log, 5) == sorted([
        (1, 0, 0, "a", 18, None, False), (1, 3, 18, "b", 24, None, False), (1, 4, 24, "b", None, None, True),
        (2, 1, 0, "a", 8, None, False), (2, 2, 8, "a", None, None, True), (3, 0, 0, "a", 10, None, False),
        (4, 0, 0, "a", 10, "b", False), (4, 1, 10, "b", None, None, True),
    ], key=str)


def test_properties(spark):
    log = as_frame(spark, random_log(9))
    found = replay.fold(log, ["k"], ["v"], "ts", "who", "gone", ["n"]).cache()
    overlap = found.alias("x").join(found.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.valid_from") < F.col("y.valid_from")) & (F.col("x.valid_to").isNull() | (F.col("x.valid_to") > F.col("y.valid_from"))))
    assert overlap.isEmpty()
    base, history = V.split(found)
    latest = found.agg(F.max(F.greatest("valid_from", F.coalesce("valid_to", "valid_from")))).head()[0]
    assert V.as_of(base, history, F.lit(latest)).exceptAll(base).isEmpty() and base.exceptAll(V.as_of(base, history, F.lit(latest))).isEmpty()
    merged = M.compact(history, ["k"], ["k", "v"])
    for s in range(0, 60, 7):
        t = F.lit(T0 + timedelta(seconds=s)).cast("timestamp_ntz")
        before, after = (V.as_of(base, h, t).select("k", "v") for h in (history, merged))
        assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_by_transaction_equals_fold(spark):
    log = as_frame(spark, [x for x in random_log(5) if not x[4]])
    whole = replay.fold(log, ["k"], ["v"], "ts", "who", "gone", ["n"])
    plain = replay.by_transaction(log, ["k"], ["v"], "ts", "who", ["n"])
    assert whole.exceptAll(plain.select(*whole.columns)).isEmpty() and plain.select(*whole.columns).exceptAll(whole).isEmpty()
