"""Gapless positions in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import staging_path

#: Bits of a row's place inside its partition in ``monotonically_increasing_id``.
PLACE_BITS = 33


def number_rows(df: DataFrame, order: list[Column], name: str, label: str = "numbered") -> DataFrame:
    """``df`` with ``name``: the position of each row, from 0, in the total order ``order``.

    Ranges of the order are sorted side by side and written once; a position is
    the place inside a range plus the rows of the ranges before it.  Only the
    ranges' counts, one for each shuffle partition, meet in one task."""
    spark = df.sparkSession
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id()))
    path = staging_path(spark, label)
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path).withColumn("_range", F.shiftright("_id", PLACE_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.join(starts, "_range").withColumn(name, F.col("_start") + place).drop("_id", "_range", "_start")
