"""A-16..A-18: table profile, dataset totals and column preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE_SCHEMA = ("table_name", "source_file", "rows", "columns", "truncated_for_prompt")


def table_profile(tables: list[tuple[str, str, DataFrame]], max_rows: int) -> DataFrame:
    """A-16: one row per (table name, source file, frame).

    Each row count is a partial+final aggregation on its own table; the
    column list is schema metadata.  The union is a handful of one-row
    frames, so nothing large is combined.
    """
    parts = []
    for name, source, df in tables:
        cols = F.array(*[F.lit(c) for c in df.columns]) if df.columns else F.array().cast("array<string>")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(source).alias("source_file"), "rows",
            cols.alias("columns"),
            (F.col("rows") > F.lit(max_rows)).alias("truncated_for_prompt"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_totals(profile: DataFrame) -> DataFrame:
    """A-17: number of tables and total rows."""
    return profile.agg(F.count(F.lit(1)).alias("table_count"),
                       F.sum("rows").cast("bigint").alias("total_rows"))


def column_preview(tables: list[tuple[str, DataFrame]], shown: int = 8) -> DataFrame:
    """A-18: per (name, frame) the first ``shown`` column names and a "+k"
    note for the rest.  Columns are schema metadata: no table is scanned."""
    listed = tables[0][1].sparkSession.createDataFrame(
        [(name, df.columns) for name, df in tables], "table_name string, columns array<string>")
    n = F.size("columns")
    return listed.select(
        "table_name",
        F.slice("columns", 1, shown).alias("preview"),
        F.when(n > shown, F.concat(F.lit("+"), (n - shown).cast("string"))).alias("more"),
        n.cast("bigint").alias("n_columns"),
    )


def column_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """A-16 extended: per column the row count, non-null and null cells and
    distinct values, from one aggregation pass over the table (one row per
    column out).  Distinct values are a HyperLogLog estimate by default,
    which combines map-side in fixed memory at any scale; ``exact`` counts
    them exactly (one more shuffle per column)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        distinct = F.count_distinct(col) if exact else F.approx_count_distinct(col)
        aggs += [F.count(col).alias(f"_n{i}"), distinct.alias(f"_d{i}")]
    row = df.agg(*aggs)
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("non_null"),
                                    F.col(f"_d{i}").cast("bigint").alias("distinct_values"))
                           for i, c in enumerate(df.columns)])
    return row.select("_rows", F.inline(per_column)).select(
        "column_name", F.col("_rows").alias("rows"), "non_null",
        (F.col("_rows") - F.col("non_null")).alias("nulls"), "distinct_values")
