"""Streaming form of the upload flow (A-05, A-06, A-07, A-16).

Files dropped into a folder are picked up by a Structured Streaming file
source (``binaryFile``, content never read), validated, de-duplicated by
(name, size, modification time) within a watermark, and every accepted CSV
file is profiled in ``foreachBatch``: one distributed CSV read of the new
files, row counts per upload.  Each micro-batch writes its own output folder
named by the batch id (overwrite), so a re-run batch replaces its output and
the sink stays exactly-once; progress lives in the checkpoint folder under
the shared folder.  Rejected uploads are written beside it in the same way.

The file source never emits a zero-length file, so each run also lists the
first level of the drop folder and writes its empty uploads anew: an upload
that is filled later leaves that list and arrives in the stream.

Later copies of an upload win in the place of the first one (A-06) by a
streaming aggregation, whose state is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import safe_name
from tessera.sources.files import (CSV_OPTIONS, decoded, dedupe_uploads, exists, first_level,
                                   has_quoted_breaks, validate)

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def upload_events(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New files under ``root`` as a stream: upload name (first folder level),
    part path, size, time; validated and de-duplicated within a watermark."""
    import re

    root_path = re.sub(_SCHEME, "", root.rstrip("/"))
    files = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
             .load(root).select("path", "modificationTime", "length"))
    upload = F.regexp_extract(F.regexp_replace("path", _SCHEME, ""),
                              r"^\Q" + root_path + r"\E/([^/]+)", 1)
    events = files.select("path", "modificationTime", "length", upload.alias("file_name"))
    deduped = (events.withWatermark("modificationTime", "1 hour")
               .dropDuplicatesWithinWatermark(["path", "length", "modificationTime"]))
    named = deduped.withColumn("table_name", safe_name(F.regexp_replace("file_name", r"\.[^.]+$", "")))
    # parts of an upload are judged by the upload's name and their own size
    return validate(named, name_col="file_name", size_col="length", limit_mb=None)


def _rejected(sink: str) -> str:
    return f"{sink.rstrip('/')}-rejected"


def _empty(sink: str) -> str:
    return f"{sink.rstrip('/')}-empty"


def profile_batch(sink: str):
    """foreachBatch body: count the rows of the accepted CSV parts of one
    micro-batch, per upload, and write them to ``sink/batch=<id>``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.where(~F.col("accepted"))
         .groupBy("file_name", "reason", "message").agg(F.sum("length").alias("bytes"))
         .write.mode("overwrite").parquet(f"{_rejected(sink)}/batch={batch_id}"))
        accepted = batch.where(F.col("accepted") & (F.col("extension") == ".csv")).persist()
        # the file list of one micro-batch is metadata bounded by maxFilesPerTrigger
        paths = [r.path for r in accepted.select("path").collect()]
        out = f"{sink.rstrip('/')}/batch={batch_id}"
        if not paths:
            spark.createDataFrame([], "table_name string, path string, rows long") \
                .write.mode("overwrite").parquet(out)
            accepted.unpersist()
            return
        reader = spark.read.options(**CSV_OPTIONS).option("multiLine", has_quoted_breaks(spark, paths))
        rows = (reader.csv(paths).select(F.input_file_name().alias("path"))
                .groupBy("path").agg(F.count(F.lit(1)).alias("rows")))
        # listing paths and input_file_name differ in scheme form and URI
        # encoding: compare decoded paths without the scheme
        names = accepted.select(F.regexp_replace("path", _SCHEME, "").alias("p"), "table_name")
        rows = rows.withColumn("p", F.regexp_replace(decoded(F.col("path")), _SCHEME, ""))
        # an upload with a header only has no row, and still is one
        (names.join(rows, "p", "left")
         .select("table_name", F.col("p").alias("path"), F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))
         .write.mode("overwrite").parquet(out))
        accepted.unpersist()

    return run


def run_upload_stream(spark: SparkSession, root: str, sink: str, checkpoint: str,
                      max_files: int = 1000) -> None:
    """Process every file present now (availableNow) and stop."""
    events = upload_events(spark, root, max_files).withColumn(
        "extension", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))
    query = (events.writeStream.foreachBatch(profile_batch(sink))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    empty = first_level(spark, root).where("NOT folder AND length = 0")
    (validate(empty.withColumnRenamed("entry", "file_name"))
     .select("file_name", "reason", "message", F.col("length").alias("bytes"))
     .write.mode("overwrite").parquet(_empty(sink)))


def rejected_uploads(spark: SparkSession, sink: str) -> DataFrame:
    """Rejected uploads with reason, message and bytes: those of all micro-batches and the
    empty ones of the last run."""
    schema = "file_name string, reason string, message string, bytes bigint"
    # a run without any new file has no micro-batch
    folders = [path for path in (_rejected(sink), _empty(sink)) if exists(spark, path)]
    return (spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
            .groupBy("file_name", "reason", "message").agg(F.sum("bytes").cast("bigint").alias("bytes")))


def run_dedupe_stream(uploads: DataFrame, key_cols: list[str], order_col: str,
                      payload_cols: list[str], sink: str, checkpoint: str) -> None:
    """A-06 over micro-batches: a stream of uploads, every one present now.

    The batch aggregation as a streaming one: first position, last position and
    last payload are minima and maxima, so the order in which files arrive does
    not matter.  Each micro-batch writes the rows that it changed to its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")

    query = (dedupe_uploads(uploads, key_cols, order_col, payload_cols).writeStream
             .outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def deduped_uploads(spark: SparkSession, sink: str, key_cols: list[str]) -> DataFrame:
    """The present row of every key: the one of the last micro-batch that changed it."""
    changed = spark.read.parquet(sink)
    rest = [c for c in changed.columns if c not in (*key_cols, "batch")]
    return (changed.groupBy(*key_cols).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
            .select(*key_cols, "_row.*"))


def uploaded_tables(spark: SparkSession, sink: str) -> DataFrame:
    """Rows per uploaded table over all micro-batches (parts of one upload
    may arrive in different batches)."""
    return (spark.read.parquet(sink).groupBy("table_name")
            .agg(F.sum("rows").cast("bigint").alias("rows")))
