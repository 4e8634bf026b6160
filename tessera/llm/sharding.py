"""Uniform shuffle into shards of exact size by a hypergeometric matrix.

Every input partition ``i`` with ``n_i`` rows must send some rows to every
shard ``j`` of size ``m_j``.  In a uniform shuffle these counts follow a
multivariate hypergeometric law, so the matrix of counts is drawn first, one
row per partition and without replacement from what the shards still lack.
Its rows and columns add up exactly, hence shard sizes are exact by
construction.  The law of every count is the exact one at any size: small
populations by numpy, others by urn draws, inversion or ratio of uniforms on
probabilities relative to the mode (``draw``).  Then each partition permutes its rows and deals them out by its
row of the matrix, the rows are exchanged, and every shard is permuted again.

Both permutations are sorts on a seeded hash of the row's id.  The second is a
range sort over (shard, hash), so that a shard is never one task: its rows are
spread over as many partitions as the data need, and the slot is the position
in the order minus the rows of earlier shards.

Defined cases: an empty table gives no rows; null ids and texts are rows like
any other; repeated rows are dealt one by one; with fewer rows than shards the
first shards get one row each.  Columns called ``shard`` or ``slot`` are
replaced, others pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ROW_BITS, if_small, number_rows, stage, whole_row

#: numpy's draw covers populations up to this size.
NUMPY_POPULATION = 999_999_999
#: Draws one by one up to this many picks; inversion up to this mode.
URN_PICKS, SMALL_MODE = 1_000, 20


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart, the larger ones first."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _log_factorials(x: int, y: int) -> float:
    """log(x!) - log(y!), without the cancellation of two large logarithms."""
    if min(x, y) < 1_000:
        return math.lgamma(x + 1) - math.lgamma(y + 1)
    d = x - y
    return ((x + 0.5) * math.log1p(d / y) + d * math.log(y) - d
            + (1 / x - 1 / y) / 12 - (1 / x ** 3 - 1 / y ** 3) / 360)


def draw(rng: np.random.Generator, good: int, bad: int, picks: int) -> int:
    """Good ones among ``picks`` drawn without replacement: a hypergeometric number."""
    if max(0, picks - bad) == min(good, picks):
        return min(good, picks)
    if good + bad <= NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, picks))
    return draw_large(rng, good, bad, picks)


def draw_large(rng: np.random.Generator, good: int, bad: int, picks: int) -> int:
    """The same for any population below 2**63, in whole numbers."""
    total = good + bad
    if 2 * picks > total:  # those left behind
        return good - draw_large(rng, good, bad, total - picks)
    if good > bad:
        return picks - draw_large(rng, bad, good, picks)
    good, picks = sorted((good, picks), reverse=True)  # the law has them in either order
    if picks <= URN_PICKS:
        got = 0
        for i in range(picks):
            got += int(rng.integers(total - i)) < good - got
        return got
    bad = total - good
    mode = (picks + 1) * (good + 1) // (total + 2)
    if mode <= SMALL_MODE:
        p = math.exp(_log_factorials(bad, bad - picks) - _log_factorials(total, total - picks))
        u, k = rng.random(), 0
        while u > p and k < picks:
            u -= p
            p *= (picks - k) * (good - k) / ((k + 1) * (bad - picks + k + 1))
            k += 1
        return k
    mean = picks * (good / total)
    deviation = math.sqrt((total - picks) * mean * (bad / total) / (total - 1) + 0.5)
    # hat of the ratio of uniforms for a discrete unimodal law
    width = 2 * math.sqrt(2 / math.e) * deviation + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u else -1
        if 0 <= k <= picks:
            ratio = -(_log_factorials(k, mode) + _log_factorials(good - k, good - mode)
                      + _log_factorials(picks - k, picks - mode)
                      + _log_factorials(bad - picks + k, bad - picks + mode))
            if 2 * math.log(u) <= ratio:
                return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows per partition and shard; rows sum to ``counts``, columns to ``sizes``."""
    rng = np.random.default_rng(seed)
    left, matrix = list(sizes), []
    for n in counts:
        pool, row = sum(left), []
        for j, room in enumerate(left):
            got = draw(rng, room, pool - room, n)
            pool -= room
            n -= got
            left[j] -= got
            row.append(got)
        matrix.append(row)
    return matrix


def hypergeometric_shuffle(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot``.

    ``slot`` is gapless from 0 in each shard.  The driver sees one count per
    input partition and the matrix, never a row.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    local = (df.select(whole_row(df).alias("_row"),
                       F.monotonically_increasing_id().alias("_rid"))
               .withColumn("_part", F.spark_partition_id())
               .withColumn("_key", F.xxhash64(F.lit(seed), F.lit("local"), F.col("_rid")))
               .sortWithinPartitions("_key", "_rid")
               .withColumn("_rank", F.monotonically_increasing_id()
                           .bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    rows = stage(local.drop("_key"), "shuffle-local")
    counts = sorted((r["_part"], r["n"]) for r in
                    rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = spark.createDataFrame(
        [(part, np.cumsum(row).tolist()) for (part, _), row in zip(counts, matrix)],
        T.StructType([T.StructField("_part", T.IntegerType()),
                      T.StructField("_ends", T.ArrayType(T.LongType()))]))
    ends = if_small(ends, len(counts) * (32 + 8 * shards))
    dealt = (rows.join(ends, "_part")
                 .withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
                 .select("_row", "_rid", "_shard",
                         F.xxhash64(F.lit(seed), F.lit("shard"), F.col("_rid")).alias("_key")))
    placed = number_rows(dealt, [F.col("_shard"), F.col("_key"), F.col("_rid")],
                         "_at", "shuffle-exchange")
    starts = F.array(*[F.lit(int(x)).cast("long") for x in np.cumsum([0, *sizes[:-1]])])
    kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.col("_shard").alias("shard"),
                         (F.col("_at") - F.get(starts, F.col("_shard"))).alias("slot"))


def write_shards(shuffled: DataFrame, path: str, sort_by_slot: bool = True) -> None:
    """Write the rows as one folder per shard (``shard=<j>``), slots in order per file."""
    out = shuffled.repartitionByRange(shuffled.sparkSession.sparkContext.defaultParallelism,
                                      "shard", "slot")
    if sort_by_slot:
        out = out.sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
