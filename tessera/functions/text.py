"""Column expressions for names, numbers and text (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's behaviour ----------------
# Characters kept in a table name; every run of other characters becomes "_".
SAFE_NAME_KEEP = "0-9A-Za-zÀ-ÿ"
# Name used when nothing is left of a table name.
SAFE_NAME_FALLBACK = "tabela"
# Cell texts read as missing (the pandas CSV reader defaults).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Accepted upload extensions (lower case).
SUPPORTED_EXTENSIONS = (".csv", ".xls", ".xlsx")
# ----------------------------------------------------------------------------


def safe_name(c: Column, fallback: str = SAFE_NAME_FALLBACK) -> Column:
    """A-13: each run outside the kept class -> "_", "_" trimmed at both ends,
    empty -> fallback."""
    slug = F.regexp_replace(c, f"[^{SAFE_NAME_KEEP}]+", "_")
    slug = F.btrim(slug, F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def null_token(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """A-10: cells holding a missing-value token become null."""
    return F.when(c.isin(*tokens), F.lit(None)).otherwise(c)


PLAIN_NUMBER = r"^\s*-?\d+(\.\d+)?\s*%?\s*$"
GROUPED_NUMBER = r"^\s*-?\d{1,3}(\.\d{3})+\s*$"


def locale_number(c: Column) -> Column:
    """A-11: "$1.234,5" -> 1234.5, "6,77%" -> 0.0677, as double.

    In locale text everything but digits, comma and minus is dropped (so "."
    thousands separators go), the decimal comma becomes a point, and a
    trailing "%" divides by 100.  A plain number such as "12.5" is no locale
    text and keeps its point, unless its points group thousands ("1.234").
    Unparseable text gives null (``locale_stats`` counts it).
    """
    plain = c.rlike(PLAIN_NUMBER) & ~c.rlike(GROUPED_NUMBER)
    digits = F.translate(F.regexp_replace(c, r"[^0-9,\-]", ""), ",", ".")
    value = F.when(plain, F.regexp_replace(c, r"[\s%]", "")).otherwise(digits).try_cast("decimal(18,4)")
    as_double = value.cast("double")
    return F.when(F.trim(c).endswith("%"), F.round(as_double / F.lit(100.0), 6)).otherwise(as_double)


def locale_stats(c: Column) -> list[Column]:
    """Counts for a column before it is parsed (A-11): its values, those that
    are plain numbers already, and those that no number can be read from."""
    return [F.count(c).alias("values"), F.count(F.when(c.rlike(PLAIN_NUMBER), 1)).alias("plain"),
            F.count(F.when(c.isNotNull() & locale_number(c).isNull(), 1)).alias("unparseable")]


def thousands_text(n: Column) -> Column:
    """A-25: integer with "." as thousands separator (pt-BR)."""
    return F.translate(F.format_number(n.cast("bigint"), 0), ",", ".")


def _tenths_text(tenths: Column) -> Column:
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."),
                    (tenths % 10).cast("bigint").cast("string"))


def bytes_text(n: Column) -> Column:
    """A-25: "512 B", "1.5 KB", "12.0 MB" with one decimal rounded half up,
    computed on integers so every engine agrees."""
    n = n.cast("bigint")
    kb_tenths = F.floor((n * 10 + 512) / 1024)
    mb_tenths = F.floor((n * 10 + 524288) / 1048576)
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1048576, F.concat(_tenths_text(kb_tenths), F.lit(" KB")))
            .otherwise(F.concat(_tenths_text(mb_tenths), F.lit(" MB"))))


def extension(path: Column) -> Column:
    """Lower-case extension with the dot, "" when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")
