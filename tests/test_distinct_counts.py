"""Distinct counts from bitmaps that roll up, against counting the rows."""

import random

from pyspark.sql import functions as F

from tessera.operators import measures as B


def test_states_roll_up_exactly(spark):
    rng = random.Random(1)
    keys = [None, 0, 1, 32767, 32768, -1, -40000, 2**40, *range(200)]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice(keys)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, k bigint").repartition(5)
    states = B.key_states(df, ["g", "h"], "k")
    got = {(r.cut, r.cut_key): r.n for r in B.distinct_counts(states, ["g", "h"], "n").collect()}

    def n(keep):
        return len({k for g, h, k in rows if k is not None and keep(g, h)})
    want = {("total", None): n(lambda g, h: True)}
    want |= {("g", x): n(lambda g, h, x=x: g == x) for x in ("a", "b", None)}
    want |= {("h", None if x is None else str(x)): n(lambda g, h, x=x: h == x) for x in (1, 2, None)}
    assert got == want


def test_states_of_two_batches_merge(spark):
    one, two = (spark.range(n).select(F.lit("x").alias("g"), (F.col("id") * 7 % 50).alias("k")) for n in (30, 60))
    states = B.key_states(one, ["g"], "k").unionByName(B.key_states(two, ["g"], "k"))
    assert {r.cut: r.n for r in B.distinct_counts(states, ["g"], "n").collect()} == {"total": 50, "g": 50}


def test_no_rows(spark):
    states = B.key_states(spark.createDataFrame([], "g string, k bigint"), ["g"], "k")
    assert B.distinct_counts(states, ["g"], "n").count() == 0
