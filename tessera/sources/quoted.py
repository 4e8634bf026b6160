"""A-03: CSV records with quoted line breaks, read by many tasks.

A task that starts in the middle of a file cannot know whether its first line
lies inside a quoted cell.  So a line is taken as a function of that state: is
a quoted cell open behind it, if none (one) was open before it.  Every block of
a file runs its lines from both states at once; the blocks' functions are then
composed along each file (a prefix scan over one row per block: a block sets
the state, keeps it or swaps it), which settles every line.  A line with no
open cell before and behind it is a record, without any shuffle; only lines of
longer records are grouped, by the block and number of the record's first line.

Lines and their functions are stored once, so that both passes see the same
blocks whatever the cluster's size.  A cell that is never closed makes the rest
of its file one record, as any reader has it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import staging_path


def open_behind(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted cell is open behind a line: if none was open before it, if one was.

    A quote opens a cell only at its start; doubled quotes belong to the cell;
    a quote inside a bare cell is text.
    """
    s = r"\Q" + sep + r"\E"
    inside = r'(?:[^"]++|"")*+'
    rest = f"(?:(?!{s}).)*+{s}"
    whole = f'(?:(?:"{inside}"{rest})|(?:(?!"){rest}))*+'
    opened = f'{whole}"{inside}$'
    quoted = line.contains('"')
    return (quoted & line.rlike(f"(?s)^{opened}"),
            ~quoted | line.rlike(f'(?s)^{inside}$') | line.rlike(f'(?s)^{inside}"{rest}{opened}'))


def _from_both_states(batches):
    """Per line its number in its block, the state before it for a block that starts outside and
    inside a quoted cell, and whether it is the first line of a file that is not blank."""
    block, at, out, inside, headed = None, 0, False, True, False
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("uri", "block", "f0", "f1", "blank")}
        number, if_out, if_in, head = [], [], [], []
        for uri, start, f0, f1, blank in zip(*columns.values()):
            if (uri, start) != block:
                block, at, out, inside, headed = (uri, start), 0, False, True, start > 0
            number.append(at)
            if_out.append(out)
            if_in.append(inside)
            head.append(not headed and not blank)
            headed = headed or not blank
            out, inside, at = (f1 if out else f0), (f1 if inside else f0), at + 1
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("uri", "block", "value", "f0", "f1")), pa.array(number, pa.int64()),
             pa.array(if_out, pa.bool_()), pa.array(if_in, pa.bool_()), pa.array(head, pa.bool_())],
            names=["uri", "block", "value", "f0", "f1", "at", "if_out", "if_in", "head"])


def _states(lines: DataFrame) -> DataFrame:
    """(uri, block, open): whether a quoted cell is open where a block starts."""
    def behind(state):
        return F.when(F.col(state), F.col("f1")).otherwise(F.col("f0"))
    blocks = lines.groupBy("uri", "block").agg(
        F.max_by(behind("if_out"), "at").alias("e0"), F.max_by(behind("if_in"), "at").alias("e1"))
    along = Window.partitionBy("uri").orderBy("block")
    sets = F.col("e0") == F.col("e1")
    swaps = (F.col("e0") & ~F.col("e1")).cast("int")
    run = blocks.withColumn("run", F.sum(sets.cast("int")).over(along))
    within = Window.partitionBy("uri", "run").orderBy("block")
    first = F.first(F.when(sets, F.col("e0")).otherwise(F.lit(False))).over(within).cast("int")
    after = run.withColumn("after", (first + F.sum(F.when(sets, 0).otherwise(swaps)).over(within)) % 2 == 1)
    return after.select("uri", "block", F.coalesce(F.lag("after").over(along), F.lit(False)).alias("open"))


def csv_records(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """``uri``, ``record`` (its lines joined by line feeds) and ``head`` (the first of its file)."""
    raw = (spark.read.option("lineSep", "\n").text(paths)
           .select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("uri"),
                   F.col("_metadata.file_block_start").alias("block")))
    f0, f1 = open_behind(F.regexp_replace("value", "^﻿", ""), sep)
    lines = raw.select("uri", "block", "value", f0.alias("f0"), f1.alias("f1"),
                       (F.trim(F.translate("value", "\r", "")) == "").alias("blank"))
    lines = lines.mapInArrow(_from_both_states, "uri string, block long, value string, f0 boolean, f1 boolean, "
                                                "at long, if_out boolean, if_in boolean, head boolean")
    path = staging_path(spark, "csv-lines")
    lines.write.parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    before = F.when(F.col("open"), F.col("if_in")).otherwise(F.col("if_out"))
    lines = (lines.join(_states(lines), ["uri", "block"]).withColumn("before", before)
                  .withColumn("behind", F.when(F.col("before"), F.col("f1")).otherwise(F.col("f0"))))
    alone = lines.where("NOT before AND NOT behind").select("uri", F.col("value").alias("record"), "head")
    # parts of longer records: numbered by first lines in a block, a part at a block's
    # start belongs to the last first line of an earlier block of its file
    parts = lines.where("before OR behind").withColumn(
        "nth", F.sum((~F.col("before")).cast("int")).over(Window.partitionBy("uri", "block").orderBy("at")))
    heads = parts.groupBy("uri", "block").agg(F.max("nth").alias("n"))
    earlier = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("uri", "block", F.last(F.when(F.col("n") > 0, F.struct("block", "n")),
                                                ignorenulls=True).over(earlier).alias("last"))
    own = F.when(F.col("nth") > 0, F.struct("block", F.col("nth").alias("n"))).otherwise(F.col("last"))
    joined = (parts.join(heads, ["uri", "block"]).groupBy("uri", own.alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"), F.max("head").alias("head"))
        .select("uri", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"), "head"))
    return (alone.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
                 .where(F.trim("record") != ""))
