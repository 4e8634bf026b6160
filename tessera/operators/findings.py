"""Group C: cross-table findings computed from the measure tables.

Inputs here are *aggregates* (one row per state, month or category), so their
size is bounded by the group cardinality, not by the data.  Windows without a
partition (``over ()``) are used only on such inputs.  Money columns are
re-summed as decimal(38,4) so totals are exact and engine-independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,4)"


def _exact(c: str) -> Column:
    return F.col(c).cast(MONEY)


def share_of_total(df: DataFrame, value: str, name: str = "share",
                   within: list[str] | None = None) -> DataFrame:
    """C-01: value / total over all rows (or over the rows with the same
    ``within`` columns)."""
    total = F.sum(_exact(value)).over(Window.partitionBy(*(within or [])))
    return df.withColumn(name, F.round(F.col(value) / total.cast("double"), 6))


def top_k_concentration(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """C-02: the k largest groups with rank, share and cumulative share."""
    order = Window.orderBy(F.col(value).desc(), F.col(key))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(_exact(value)).over(Window.partitionBy()).cast("double")
    ranked = df.select(
        key, value,
        F.row_number().over(order).cast("bigint").alias("rank"),
        F.round(F.col(value) / total, 6).alias("share"),
        F.round(F.sum(_exact(value)).over(running).cast("double") / total, 6).alias("cum_share"),
    )
    return ranked.where(F.col("rank") <= k)


def benchmark_ratio(df: DataFrame, key: str, metric: str, size: str,
                    benchmark_key: str | None = None, average: bool = False) -> DataFrame:
    """C-03: metric / metric of a benchmark group: a named key, the largest
    group by ``size`` (default), or with ``average`` the mean over all
    groups (``benchmark`` is then null)."""
    everything = Window.partitionBy()
    if average:
        out = df.withColumn("benchmark", F.lit(None).cast("string"))
        bench_metric = F.avg(F.col(metric)).over(everything)
    else:
        if benchmark_key is None:
            bench_key = F.max_by(F.col(key), F.struct(F.col(size), F.col(key))).over(everything)
        else:
            bench_key = F.lit(benchmark_key)
        out = df.withColumn("benchmark", bench_key)
        bench_metric = F.max(F.when(F.col(key) == F.col("benchmark"), F.col(metric))).over(everything)
    return out.select(
        key, metric, "benchmark",
        bench_metric.alias("benchmark_value"),
        F.round(F.try_divide(F.col(metric), bench_metric), 6).alias("ratio"),
    )


def worst_k(df: DataFrame, key: str, metric: str, volume: str,
            k: int, min_volume: int, best: bool = False) -> DataFrame:
    """C-04: the k groups with the highest metric (``best``: the lowest)
    among those with enough volume."""
    order = Window.orderBy(F.col(metric).asc() if best else F.col(metric).desc(), F.col(key))
    eligible = df.where(F.col(volume) >= min_volume).where(F.col(metric).isNotNull())
    return (eligible.select(key, metric, volume,
                            F.row_number().over(order).cast("bigint").alias("rank"))
            .where(F.col("rank") <= k))


def cross_table_pattern(left: DataFrame, right: DataFrame, key: str,
                        left_metric: str, left_rate: str, right_metric: str) -> DataFrame:
    """C-05: join two cuts on a shared key and test a condition on each side:
    above-average ``left_metric`` and ``left_rate`` on the left, below-average
    ``right_metric`` on the right.  A group missing on the right has 0 there
    (the strongest case of a low value); keys match null-safe."""
    everything = Window.partitionBy()
    other = right.select(F.col(key).alias("_key"), F.col(right_metric))
    joined = left.select(key, left_metric, left_rate).join(
        other, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(
        right_metric, F.coalesce(right_metric, F.lit(0).cast(right.schema[right_metric].dataType)))
    flagged = joined.select(
        "*",
        (F.col(left_metric) >= F.avg(left_metric).over(everything)).alias("high_" + left_metric),
        (F.col(left_rate) >= F.avg(left_rate).over(everything)).alias("high_" + left_rate),
        (F.col(right_metric) < F.avg(right_metric).over(everything)).alias("low_" + right_metric),
    )
    return flagged.withColumn(
        "pattern",
        F.col("high_" + left_metric) & F.col("high_" + left_rate) & F.col("low_" + right_metric))


def value_at_risk(df: DataFrame, key: str, value: str, rate: str, threshold: float) -> DataFrame:
    """C-06: groups whose rate exceeds ``threshold``, with their value and the
    total value at risk."""
    risky = df.where(F.col(rate) > threshold).select(key, value, rate)
    total = F.sum(_exact(value)).over(Window.partitionBy()).cast("double")
    return risky.withColumn("value_at_risk", total)


def gaps_by_user(events: DataFrame, user: str, ts: str, gap_seconds: int,
                 partitions: int | None = None) -> DataFrame:
    """C-07 on an event stream: per user, the gaps between consecutive events
    (events, largest gap in microseconds, gaps longer than ``gap_seconds``).

    Skew-safe for any user size and any spread in time:

    1. events at the same instant are one point (their gaps are zero); the
       count per (user, instant) combines map-side, so a burst of identical
       timestamps collapses before it moves;
    2. the points are range-partitioned on (user, time) with bounds taken
       from a sample, so a user holding a third of all points spans many
       partitions, each a contiguous stretch of that user's time line,
       wherever the points cluster;
    3. gaps inside a stretch come from ``lag`` over (user, partition);
    4. each stretch is summarised to one row (first, last, counts); the gap
       across a stretch border is the first time of a stretch minus the last
       time of the previous stretch of the same user, ordered by time.  A
       user has at most one stretch per partition, so this window is
       bounded by the partition count, not by the data.

    The plan is linear (no branch re-reads the range exchange), so every
    row sees the same partition bounds, also when tasks are re-run.
    """
    limit = F.lit(gap_seconds * 1_000_000)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    points = events.groupBy(F.col(user).alias("user"), t.alias("t")).agg(
        F.count(F.lit(1)).alias("n"))
    ranged = (points.repartitionByRange(*([partitions] if partitions else []), "user", "t")
              .withColumn("part", F.spark_partition_id()))
    within = ranged.withColumn(
        "gap", F.col("t") - F.lag("t").over(Window.partitionBy("user", "part").orderBy("t")))
    stretches = within.groupBy("user", "part").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.sum("n").alias("events"), F.max("gap").alias("max_gap"),
        F.count(F.when(F.col("gap") > limit, 1)).alias("long_gaps"),
        # several events at one instant: a gap of zero
        F.max(F.when(F.col("t").isNotNull() & (F.col("n") > 1), F.lit(0).cast("bigint")))
        .alias("tie_gap"))
    border = F.col("first_t") - F.lag("last_t").over(Window.partitionBy("user").orderBy("first_t"))
    stretches = stretches.withColumn("border", border)
    return stretches.groupBy("user").agg(
        F.sum("events").cast("bigint").alias("events"),
        F.greatest(F.max("max_gap"), F.max("border"), F.max("tie_gap")).alias("max_gap_us"),
        (F.sum("long_gaps") + F.count(F.when(F.col("border") > limit, 1))).cast("bigint")
        .alias("long_gaps"),
    ).withColumnRenamed("user", user)


def monthly_interruptions(by_month: DataFrame, drop_ratio: float) -> DataFrame:
    """C-07 on the month spine: months absent, at zero revenue, or falling
    below ``drop_ratio`` of the previous month."""
    order = Window.orderBy("month")
    prev = F.lag("revenue").over(order)
    kinds = (F.when(F.col("orders").isNull(), F.lit("absent"))
             .when(F.col("revenue") == 0, F.lit("zero_revenue"))
             .when(F.col("revenue") < prev * drop_ratio, F.lit("drop")))
    flagged = by_month.where(F.col("month").isNotNull()).select(
        "month", "orders", "revenue", prev.alias("prev_revenue"), kinds.alias("kind"))
    return flagged.where(F.col("kind").isNotNull())


def growth(by_month: DataFrame) -> DataFrame:
    """C-08: month-on-month change and the length of the current run of rises
    (gaps and islands: a new island starts at every non-rise)."""
    order = Window.orderBy("month")
    base = by_month.where(F.col("month").isNotNull()).select(
        "month", "revenue", F.lag("revenue").over(order).alias("prev_revenue"))
    rise = (F.col("revenue") > F.col("prev_revenue")).cast("int")
    base = base.select(
        "*",
        F.round(F.col("revenue") - F.col("prev_revenue"), 4).alias("change"),
        F.round(F.try_divide(F.col("revenue") - F.col("prev_revenue"), F.col("prev_revenue")), 6).alias("pct_change"),
        F.coalesce(rise, F.lit(0)).alias("rise"),
    )
    island = F.sum(1 - F.col("rise")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("island", island)
    streak = F.sum("rise").over(Window.partitionBy("island").orderBy("month")
                                .rowsBetween(Window.unboundedPreceding, 0))
    return base.withColumn("rise_streak", streak.cast("bigint")).drop("island", "rise")


def impact_ranking(findings: list[DataFrame]) -> DataFrame:
    """C-09: findings of all kinds (columns kind, subject, impact) in one
    table, ranked by monetary impact overall and within their kind."""
    union = findings[0]
    for f in findings[1:]:
        union = union.unionByName(f)
    overall = Window.orderBy(F.col("impact").desc(), F.col("kind"), F.col("subject"))
    per_kind = Window.partitionBy("kind").orderBy(F.col("impact").desc(), F.col("subject"))
    return union.select(
        "kind", "subject", "impact",
        F.row_number().over(overall).cast("bigint").alias("rank"),
        F.row_number().over(per_kind).cast("bigint").alias("rank_in_kind"),
    )
