"""Helpers shared by the operators: staging, row numbers, clash-free columns."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import BROADCAST_LIMIT_BYTES, staging_path

#: ``monotonically_increasing_id`` keeps the partition above this bit and the
#: row's position in the partition below it.
ROW_BITS = 33


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the cluster's shared folder and read it back.

    Cuts the lineage (a lost executor never re-runs what is above) and fixes
    non-deterministic columns such as row ids.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All input columns as one struct, so that no extra column can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def if_small(df: DataFrame, size_bytes: int) -> DataFrame:
    """Broadcast hint for a side of known size below the limit; beyond it a plain join."""
    return F.broadcast(df) if size_bytes <= BROADCAST_LIMIT_BYTES else df


class Shipped:
    """A broadcast object whose class executors need not have installed.

    A plain broadcast stores classes of this package by name; here they travel
    by value, and every task rebuilds the object when it first asks for it.
    """

    def __init__(self, spark, value):
        self._sent, self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get(self):
        if not self._held:
            self._held.append(pickle.loads(self._sent.value))
        return self._held[0]


def to_batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """An Arrow batch of Python rows; unlike pandas it keeps nulls beside whole numbers."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kind) for v, (_, kind) in zip(values, columns)],
        names=[name for name, _ in columns])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Add ``name``: the gapless position (from 0) in the total order ``order``.

    Range partitions are sorted and written once; positions are the row index
    inside a partition plus the rows of earlier partitions.  Only one count
    per partition is summed in one place, never the rows, and a value shared
    by many rows is split by the later order columns.
    """
    parts = max(1, shuffle_partitions(df))
    rows = stage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mid", ROW_BITS).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(part).agg(F.count("*").alias("_n"))
                  .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    at = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (rows.withColumn("_part", F.shiftright("_mid", ROW_BITS))
                .join(if_small(starts, 64 * parts), "_part")
                .withColumn(name, at).drop("_part", "_start", "_mid"))


#: Most bits of a key bitmap: 16 MB, the only thing of it that the driver and tasks hold.
BITMAP_BITS = 27


def key_bitmap(keys: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """(bytes, b): a bitmap over the first b bits of the 64-bit numbers ``keys(key)``.

    A number whose bit is not set is not among them.  Sixteen bits a key up to
    a fixed size, so it thins out what a join would drop, and beyond that size
    it only lets more through.
    """
    b = int(min(BITMAP_BITS, max(15, np.ceil(np.log2(16 * max(rows, 1))))))
    at = F.shiftrightunsigned("key", 64 - b)
    parts = (keys.groupBy(F.shiftright(at, 15).alias("bucket"))
                 .agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect())
    found = np.zeros(1 << (b - 3), np.uint8)
    for part in parts:
        found[part["bucket"] << 12:(part["bucket"] + 1) << 12] = np.frombuffer(part["bits"], np.uint8)
    return found, b


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray, b: int) -> np.ndarray:
    """Which of the unsigned ``keys`` may be among those of the bitmap."""
    at = keys >> np.uint64(64 - b)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
