import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


def test_matrix_adds_up_and_follows_the_law():
    counts, sizes = [5, 0, 7, 3], [4, 4, 4, 3]
    draws = [sharding.communication_matrix(counts, sizes, s) for s in range(400)]
    for m in draws:
        assert [sum(r) for r in m] == counts
        assert [sum(c) for c in zip(*m)] == sizes
    # the first cell is hypergeometric: 4 of 15 places, 5 picks
    cell = np.array([m[0][0] for m in draws])
    assert abs(cell.mean() - 5 * 4 / 15) < 0.15


def test_large_populations_stay_exact():
    counts, sizes = [3 * 10**12, 10**12], sharding.shard_sizes(4 * 10**12, 3)
    m = sharding.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes


@pytest.mark.parametrize("good, bad, picks", [
    (4 * 10**8, 96 * 10**8, 1), (4 * 10**8, 96 * 10**8, 5), (10**9, 3 * 10**9, 10**9), (10**6, 10**13, 10**6),
    (5 * 10**6, 10**13, 10**7), (3 * 10**12, 10**12, 2 * 10**12), (10**13, 7, 10**12), (9 * 10**9, 10**9, 10**10 - 3)])
def test_moments_of_large_draws(good, bad, picks):
    rng, n = np.random.default_rng(3), 4_000
    found = [sharding.draw(rng, good, bad, picks) for _ in range(n)]
    total = good + bad
    assert all(max(0, picks - bad) <= x <= min(good, picks) for x in found)
    mean = picks * good // total + (picks * good % total) / total
    var = picks * (good / total) * (bad / total) * ((total - picks) / (total - 1))
    away = np.array([x - picks * good // total for x in found], float)
    assert abs(away.mean() - (mean - picks * good // total)) < 5 * (var / n) ** 0.5 + 1e-9
    fourth = 3 * var ** 2 + var  # of a nearly normal or Poisson law
    assert abs(away.var() - var) < 5 * ((fourth - var ** 2 if var < 1 else 2 * var ** 2 + var) / n) ** 0.5 + 1e-9


@pytest.mark.parametrize("good, bad, picks", [(4, 11, 5), (60, 40, 50), (3_000, 5_000, 2_500), (2_000, 90_000, 1_500)])
def test_large_draws_have_the_exact_law(good, bad, picks):
    """On small populations, where every probability can be counted."""
    rng, n = np.random.default_rng(5), 20_000
    found = collections.Counter(sharding.draw_large(rng, good, bad, picks) for _ in range(n))
    from math import comb
    whole = comb(good + bad, picks)
    chi, cells = 0.0, 0
    for k in range(max(0, picks - bad), min(good, picks) + 1):
        expected = n * comb(good, k) * comb(bad, picks - k) / whole
        if expected > 8:
            chi += (found[k] - expected) ** 2 / expected
            cells += 1
    assert chi < cells + 5 * (2 * cells) ** 0.5


@pytest.mark.parametrize("rows", [0, 3, 1000])
def test_shards_are_exact_and_slots_gapless(spark, rows):
    df = spark.range(rows).withColumn("shard", F.lit("old")).withColumn("_rid", F.col("id") % 2)
    out = sharding.hypergeometric_shuffle(df.repartition(5), 7).collect()
    assert sorted(r["id"] for r in out) == list(range(rows))
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["_rid"] == r["id"] % 2
    assert [len(by[j]) for j in range(7)] == sharding.shard_sizes(rows, 7)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_nulls_and_repeated_rows_are_rows(spark):
    df = spark.createDataFrame([(None, None)] * 4 + [(1, "a")] * 5, "doc_id long, text string")
    out = sharding.hypergeometric_shuffle(df, 2).collect()
    assert sorted(r["text"] is None for r in out) == [False] * 5 + [True] * 4
    assert collections.Counter(r["shard"] for r in out) == {0: 5, 1: 4}


def test_places_are_uniform(spark):
    """Rows of one input partition reach every shard, and neighbours don't stay together."""
    out = sharding.hypergeometric_shuffle(spark.range(4000).coalesce(1), 4).collect()
    low = collections.Counter(r["shard"] for r in out if r["id"] < 1000)
    assert all(180 < low[j] < 320 for j in range(4))
    order = [r["id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.1


def test_write_shards(spark, tmp_path):
    out = sharding.hypergeometric_shuffle(spark.range(50), 3)
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().orderBy("shard").collect() == [(0, 17), (1, 17), (2, 16)]
