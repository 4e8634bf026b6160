"""A-08..A-15: table cleaning, naming and record conversion.

Order as in the reference cleaning step: drop all-missing rows, then
all-missing columns, strip names, normalise missing values.  Column names are
metadata, so stripping and the duplicate check run in driver Python; the data
never leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import NULL_TOKENS, null_token, safe_name


class DuplicateColumnError(ValueError):
    pass


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """A-08: drop rows in which every cell is missing (null or NaN)."""
    return df.na.drop(how="all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """A-09: drop columns with no value at all (NaN is none).

    Eager by nature (the schema depends on the data): one distributed
    aggregation counts the non-null cells of every column in a single pass;
    only the per-column counts reach the driver.
    """
    if not df.columns:
        return df
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    values = [F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) if c in floats else F.col(f"`{c}`")
              for c in df.columns]
    counts = df.agg(*[F.count(v).alias(f"c{i}") for i, v in enumerate(values)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def strip_column_names(df: DataFrame) -> DataFrame:
    """A-12: strip white space around names; names that collide after the
    strip raise instead of silently losing a column."""
    stripped = [str(c).strip() for c in df.columns]
    seen, dupes = set(), []
    for name in stripped:
        if name in seen:
            dupes.append(name)
        seen.add(name)
    if dupes:
        raise DuplicateColumnError(f"columns equal after strip: {sorted(set(dupes))}")
    return df.toDF(*stripped)


def normalize_nulls(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """A-10: missing-value tokens in text columns and NaN in float columns
    become null."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = null_token(c, tokens)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def clean(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """The whole cleaning step.  Tokens are nulled first so a row or column
    made only of tokens is recognised as empty."""
    return drop_empty_columns(drop_empty_rows(normalize_nulls(strip_column_names(df), tokens)))


def resolve_name_collisions(files: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """A-14: several inputs with the same table name -> the last one (highest
    ``order_col``) wins; the others stay visible with ``superseded = true``.

    Skew-safe: the winner per name is a partial+final aggregation (no window
    over a possibly huge group), joined back on the name.
    """
    winners = files.groupBy(name_col).agg(F.max(order_col).alias("_winner"))
    return (files.join(winners, name_col, "left")
            .withColumn("superseded", F.col(order_col) != F.col("_winner"))
            .drop("_winner"))


def table_names(df: DataFrame, source_col: str, out_col: str = "table_name") -> DataFrame:
    """A-13 applied to a column of file or sheet names."""
    return df.withColumn(out_col, safe_name(F.col(source_col)))


def to_records(df: DataFrame) -> DataFrame:
    """A-15: each row as one JSON object; every key is kept, in column order,
    a missing value as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("record"))

