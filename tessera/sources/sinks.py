"""A-31, A-32: Markdown text and JSON result envelope sinks.

Writes are distributed (one file per task and key folder); readers get the
key back from the folder name.  Paths come from the caller; in tests they are
new folders under the shared folder (``session.staging_path``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def write_markdown(df: DataFrame, text_col: str, path: str, key_col: str | None = None) -> None:
    """A-31: UTF-8 text, overwrite; one folder per key when ``key_col`` is set.
    Parent folders are created by the writer."""
    cols = [text_col] + ([key_col] if key_col else [])
    writer = df.select(*cols).write.mode("overwrite").option("encoding", "UTF-8")
    if key_col:
        writer = writer.partitionBy(key_col)
    writer.text(path)


def read_markdown(spark: SparkSession, path: str, text_col: str = "text",
                  key_col: str | None = None, key_type: str = "string") -> DataFrame:
    """Read written Markdown back: one row per file (whole text), the key
    recovered from the folder names with its declared type (a key such as
    "01" stays text); the writer's final newline removed."""
    schema = "value string" + (f", `{key_col}` {key_type}" if key_col else "")
    df = spark.read.schema(schema).text(path, wholetext=True)
    return df.withColumn(text_col, F.regexp_replace("value", "\n\\z", "")).drop("value")


def generated_at() -> Column:
    """UTC ISO-8601 timestamp with offset (the session runs in UTC)."""
    return F.date_format(F.current_timestamp(), ISO_UTC)


PROFILE_FIELDS = ("table_name", "source_file", "rows", "columns", "truncated_for_prompt")


def envelope(analysis: DataFrame, profile: DataFrame, text_col: str = "analysis") -> DataFrame:
    """A-32: {analysis, generated_at, table_count, tables[]} as one row.

    The analysis row and the profile rows are stacked and folded by one
    global aggregation (no join).  ``profile`` is bounded by the number of
    input tables, so gathering it into one array is safe; the analysis side
    is one row."""
    entry = F.struct(*PROFILE_FIELDS)
    entry_type = profile.select(entry.alias("t")).schema["t"].dataType
    stacked = analysis.select(F.col(text_col).cast("string").alias("analysis"),
                              F.lit(None).cast(entry_type).alias("t")).unionByName(
        profile.select(F.lit(None).cast("string").alias("analysis"), entry.alias("t")))
    return stacked.agg(
        F.max("analysis").alias("analysis"), generated_at().alias("generated_at"),
        F.count("t").alias("table_count"), F.sort_array(F.collect_list("t")).alias("tables"))


def error_envelope(message: Column, profile: DataFrame) -> DataFrame:
    """A-32, error form: the message with the profile so the caller still
    sees what was loaded."""
    tables = profile.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.sort_array(F.collect_list(F.struct(
            "table_name", "source_file", "rows", "columns", "truncated_for_prompt"))).alias("tables"))
    return tables.select(message.alias("message"), generated_at().alias("generated_at"),
                         "table_count", "tables")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, missing values as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
