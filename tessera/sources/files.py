"""A-01..A-03, A-05..A-07: file catalog, CSV scan, upload manifest, validation.

Names are resolved at the first level below a root, where an entry is a file
or a folder of part files written by Spark.  The driver asks the filesystem
only for that level (one status per table or upload); what lies inside the
folders is listed by the ``binaryFile`` source with its content pruned, so
part files never pass through the driver.

CSV files are read splittable; where a quoted line break is found in them (a
test on the executors) the records are cut by ``sources.quoted``, which reads a
file by many tasks, too.  Types are inferred after missing-value tokens became
null, from counts in one pass, and only numbers and booleans are inferred: a
text such as "2016-09" stays text.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SUPPORTED_EXTENSIONS, extension, null_token
from tessera.sources.quoted import csv_records

# ---- fixed values: the reference's upload limit and messages --------------
WEB_UPLOAD_MB = 12  # of the interactive form; the library's default is no limit
MSG_EMPTY = "O arquivo {file} está vazio."
MSG_TOO_LARGE = "O arquivo {file} tem {mb}MB. O limite atual é {limit}MB por arquivo."
MSG_UNSUPPORTED = "Formato não suportado em {file}. Use {accepted}."
MSG_NO_FILES = "Envie pelo menos um arquivo CSV ou Excel."
# Names for unnamed and repeated header cells: prefix and position; name,
# separator and number of earlier uses.
UNNAMED_PREFIX = "Unnamed: "
REPEATED_SEPARATOR = "."
# ---------------------------------------------------------------------------

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',         # doubled quotes are unescaped
    "mode": "PERMISSIVE",
    "encoding": "UTF-8",
}
CORRUPT = "_corrupt_record"
REPLACEMENT = "\ufffd"     # what bytes that are not UTF-8 become


class CatalogError(FileNotFoundError):
    pass


def _filesystem(spark: SparkSession, path: str):
    """Hadoop filesystem and path object of a location, by the session's configuration."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, where = _filesystem(spark, path)
    return filesystem.exists(where)


def first_level(spark: SparkSession, root: str) -> DataFrame:
    """Entries right below ``root``: path, name, folder flag, length, time."""
    filesystem, where = _filesystem(spark, root)
    listed, found = filesystem.listStatusIterator(where), []
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getPath().getName(), status.isDirectory(),
                      0 if status.isDirectory() else status.getLen()))
    return spark.createDataFrame(found, "path string, entry string, folder boolean, length bigint")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file under ``root`` (content never read).

    A zero-length file yields no scan split, so the ``binaryFile`` scan never
    emits it; empty files at the first level are added from their status, so
    empty uploads reach validation instead of vanishing."""
    scanned = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
               .select("path", "length"))
    empty = first_level(spark, root).where("NOT folder AND length = 0").select("path", "length")
    return scanned.unionByName(empty)


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def entry_of(path: Column, root: str) -> Column:
    """The first-level name below ``root`` of a path."""
    root_path = re.sub(_SCHEME, "", root.rstrip("/"))
    return F.regexp_extract(F.regexp_replace(path, _SCHEME, ""), r"^\Q" + root_path + r"\E/([^/]+)", 1)


def decoded(uri: Column) -> Column:
    """A path as the ``binaryFile`` source reports it, from a URI with escapes."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def entry_names(spark: SparkSession, root: str) -> DataFrame:
    """First-level names under ``root`` (a file or a folder of parts): number
    of files, their bytes, and the largest one's bytes."""
    inside = list_files(spark, root).select(entry_of(F.col("path"), root).alias("entry"), "length")
    listed = first_level(spark, root).select("entry", F.lit(None).cast("bigint").alias("length"))
    return (inside.unionByName(listed).groupBy("entry").agg(
        F.count("length").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("length"), F.lit(0)).alias("largest")))


def resolve_catalog(spark: SparkSession, root: str, catalog: dict[str, tuple[str, ...]],
                    strict: bool = True) -> DataFrame:
    """A-01: for every table, the first candidate name that exists under
    ``root``: one existence test per declared name, nothing is listed.  In
    strict mode a table without any candidate raises, naming the table,
    folder and candidates."""
    found = []
    for table, names in catalog.items():
        hit = next(((n, i) for i, n in enumerate(names) if exists(spark, f"{root.rstrip('/')}/{n}")), None)
        if hit:
            found.append((table, *hit))
        elif strict:
            raise CatalogError(f"file for table '{table}' not found in {root}; "
                               f"create or export one of: {' or '.join(names)}")
    return spark.createDataFrame(found, "table_name string, resolved_file string, candidate_rank bigint")


# ---- CSV -------------------------------------------------------------------

def odd_quotes(line: Column) -> Column:
    """A line with an odd number of quotes opens or closes a cell with a line break."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def has_quoted_breaks(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether a quoted cell goes over a line end (stops at the first one found)."""
    return not spark.read.text(paths).where(odd_quotes(F.col("value"))).isEmpty()


def header_names(cells: list[str | None]) -> list[str]:
    """Column names as a header row gives them: white space stripped, a blank
    cell named by its position, a repeated name numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(cells):
        name = (cell or "").lstrip("\ufeff") or f"{UNNAMED_PREFIX}{i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append((f"{name}{REPEATED_SEPARATOR}{n}" if n else name).strip())
    return out


def cell_count(record: Column, sep: str) -> Column:
    """Cells of a raw CSV record: separators outside quotes, plus one."""
    bare = F.regexp_replace(record, r'"(?:[^"]++|"")*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _text_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)]
                        + [T.StructField(CORRUPT, T.StringType())])


def _record_options(sep: str) -> dict[str, str]:
    return {**CSV_OPTIONS, "sep": sep, "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT}


def _header_cells(records: DataFrame, sep: str) -> list[str]:
    """Cells of the header record (every file has the same)."""
    head = records.where("head").select("record").head()
    return next(csv.reader([head.record.lstrip("\ufeff")], delimiter=sep), []) if head else []


def scan_csv(spark: SparkSession, path: str, sep: str = ",",
             multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """A-03: (rows, rejected) of a CSV file or folder of parts, all cells text.

    Names come from the header row (kept for a file without rows).  A record
    with more cells than the header is rejected (``record``, ``cells``,
    reason ``ragged``), and so is one with bytes that are not UTF-8
(``encoding``); shorter records end in nulls.  ``multiline``: whether
    cells may hold line breaks (default: tested)."""
    if multiline is None:
        multiline = has_quoted_breaks(spark, path)
    if multiline:
        records = csv_records(spark, path, sep)
        names = header_names(_header_cells(records, sep))
        raw = (records.where("NOT head")
               .select(F.from_csv("record", _text_schema(len(names)).simpleString()[len("struct<"):-1]
                                  .replace(":", " "), _record_options(sep)).alias("r")).select("r.*"))
    else:
        reader = spark.read.options(**CSV_OPTIONS).option("sep", sep)
        first = reader.option("header", "false").csv(path).head()
        names = header_names(list(first)) if first else []
        raw = (reader.option("header", "true").option("enforceSchema", "true")
               .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", "false")
               .schema(_text_schema(len(names))).csv(path))
    cells = [F.col(f"c{i}") for i in range(len(names))]
    n = F.when(F.col(CORRUPT).isNotNull(), cell_count(F.col(CORRUPT), sep))
    broken = F.lit(False)
    for c in cells:
        broken = broken | F.coalesce(c.contains(REPLACEMENT), F.lit(False))
    reason = F.when(n > len(names), F.lit("ragged")).when(broken, F.lit("encoding"))
    judged = raw.select(*cells, n.alias("cells"), F.coalesce(CORRUPT, F.concat_ws(sep, *cells)).alias("record"),
                        reason.alias("reason"))
    rows = judged.where("reason IS NULL").select(*[c.alias(name) for c, name in zip(cells, names)])
    rejected = judged.where("reason IS NOT NULL").select(
        "record", F.coalesce("cells", F.lit(len(names))).cast("int").alias("cells"), "reason")
    return rows, rejected


INTEGER, NUMBER = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BOOLEAN = r"^(true|True|TRUE|false|False|FALSE)$"


def type_counts(cell: Column) -> list[Column]:
    """Values of a column, and those that are whole numbers, numbers, booleans."""
    def n(condition):
        return F.count(F.when(condition, 1))
    whole = cell.rlike(INTEGER) & cell.try_cast("bigint").isNotNull()
    return [F.count(cell).alias("n"), n(whole).alias("n_long"), n(cell.rlike(NUMBER)).alias("n_double"),
            n(cell.rlike(BOOLEAN)).alias("n_boolean")]


def narrowest(n: Column, n_long: Column, n_double: Column, n_boolean: Column) -> Column:
    """The type that all values of a column have; text without any value."""
    return (F.when(n == 0, F.lit("string")).when(n_long == n, F.lit("bigint"))
            .when(n_double == n, F.lit("double")).when(n_boolean == n, F.lit("boolean"))
            .otherwise(F.lit("string")))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type of all their values, missing-value
    tokens being null.  One aggregation over the data; its counts, a few per
    column, reach the driver."""
    names = [f"`{c}`" for c in df.columns]
    cleaned = df.select(*[null_token(F.col(c)).alias(c.strip("`")) for c in names])
    if not names:
        return cleaned
    row = cleaned.agg(*[F.struct(*type_counts(F.col(c))).alias(f"t{i}") for i, c in enumerate(names)])
    kinds = row.select(*[narrowest(*[F.col(f"t{i}.{k}") for k in ("n", "n_long", "n_double", "n_boolean")])
                         .alias(f"k{i}") for i in range(len(names))]).first()
    return cleaned.select(*[
        (F.col(c) if kinds[i] == "string" else F.trim(F.col(c)).cast(kinds[i])).alias(c.strip("`"))
        for i, c in enumerate(names)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",", multiline: bool | None = None) -> DataFrame:
    """A-03: CSV table with header, quotes, quoted line breaks and doubled
    quotes.  A declared schema pins names and types and spares the inference
    pass; otherwise types are inferred and rejected records raise, as a
    strict reader does (``scan_csv`` returns them instead)."""
    if schema is None:
        rows, rejected = scan_csv(spark, path, sep, multiline)
        bad = rejected.select("reason", "cells").head()
        if bad:
            raise ValueError(f"{path}: record of {bad.cells} cells rejected ({bad.reason})")
        return infer_types(rows)
    if multiline is None:
        multiline = has_quoted_breaks(spark, path)
    if not multiline:
        return (spark.read.options(**CSV_OPTIONS).option("sep", sep)
                .schema(schema).option("enforceSchema", "false").csv(path))
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = csv_records(spark, path, sep)
    names = header_names(_header_cells(records, sep))
    if names and names != fields.names:
        raise ValueError(f"{path}: header {names} is not the declared one {fields.names}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return (records.where("NOT head").select(F.from_csv("record", ddl, _record_options(sep)).alias("r"))
            .select("r.*"))


def load_catalog(spark: SparkSession, root: str, catalog: dict[str, tuple[str, ...]],
                 schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """A-02: every declared table, in declared order; registered as temp
    views.  One missing table fails the whole load (strict resolution)."""
    resolved = {r["table_name"]: r["resolved_file"]
                for r in resolve_catalog(spark, root, catalog).collect()}
    frames = {}
    for table in catalog:
        df = read_csv(spark, f"{root.rstrip('/')}/{resolved[table]}", (schemas or {}).get(table))
        df.createOrReplaceTempView(table)
        frames[table] = df
    return frames


def validate(manifest_df: DataFrame, name_col: str = "file_name", size_col: str = "length",
             limit_mb: float | None = None,
             accepted: tuple[str, ...] = SUPPORTED_EXTENSIONS,
             largest_col: str | None = None) -> DataFrame:
    """A-07b-d: the first failing rule per file, in the reference's order
    (empty, too large, unsupported extension), with its message.

    The limit is for one file: a folder of parts is judged by its largest
    part, ``largest_col``, not by the sum in ``size_col``.  No limit by default."""
    size, single = F.col(size_col), F.col(largest_col or size_col)
    mb = single / F.lit(1048576.0)
    ext = extension(F.col(name_col))
    accepted_text = ", ".join(sorted(accepted))
    too_large = (mb > F.lit(limit_mb)) if limit_mb is not None else F.lit(False)
    reason = (F.when(size <= 0, F.lit("empty"))
              .when(too_large, F.lit("too_large"))
              .when(~ext.isin(*accepted), F.lit("unsupported")))
    f = F.col(name_col)
    e1, e2 = MSG_EMPTY.split("{file}")
    u1, u2 = MSG_UNSUPPORTED.split("{file}")
    u2 = u2.replace("{accepted}", accepted_text)
    t1, rest = MSG_TOO_LARGE.split("{file}")
    t2, t3 = rest.split("{mb}")
    t3 = t3.replace("{limit}", _limit_text(limit_mb))
    message = (F.when(reason == "empty", F.concat(F.lit(e1), f, F.lit(e2)))
               .when(reason == "too_large",
                     F.concat(F.lit(t1), f, F.lit(t2), mb_text(single), F.lit(t3)))
               .when(reason == "unsupported", F.concat(F.lit(u1), f, F.lit(u2))))
    return manifest_df.select("*", reason.alias("reason"), message.alias("message"),
                              reason.isNull().alias("accepted"))


def mb_text(size) -> "F.Column":
    """Size in MB with one decimal, rounded as Python's format does (ties to
    even on the exact value), computed on integers."""
    scaled = size.cast("bigint") * 10
    q = F.floor(scaled / 1048576).cast("bigint")
    r = scaled - q * 1048576
    up = (r > 524288) | ((r == 524288) & (q % 2 == 1))
    tenths = q + up.cast("bigint")
    return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))


def _limit_text(limit_mb) -> str:
    if limit_mb is None:
        return ""
    return str(int(limit_mb)) if float(limit_mb).is_integer() else str(limit_mb)


def require_files(manifest_df: DataFrame) -> DataFrame:
    """A-07a: at least one file must be present (one short job, no data
    moved to the driver)."""
    if manifest_df.isEmpty():
        raise ValueError(MSG_NO_FILES)
    return manifest_df


def requests_with_files(requests: DataFrame, manifest_df: DataFrame, key: str) -> DataFrame:
    """A-07a over many requests at once: per request the number of its files,
    and the message for one without any."""
    files = manifest_df.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    n = F.coalesce("files", F.lit(0).cast("bigint"))
    return requests.select(key).join(files, key, "left").select(
        key, n.alias("files"), F.when(n == 0, F.lit(MSG_NO_FILES)).alias("message"))


def first_rejection(validated: DataFrame, order_col: str) -> str | None:
    """Strict mode: the message of the first rejected file by position
    (a top-1 over the rejected rows; nothing else reaches the driver)."""
    row = (validated.where(~F.col("accepted")).orderBy(order_col)
           .select("message").limit(1).collect())
    return row[0]["message"] if row else None


def dedupe_uploads(files: DataFrame, key_cols: list[str], order_col: str,
                   payload_cols: list[str]) -> DataFrame:
    """A-06: uploads with the same key are one; the last one is kept, in the
    position of the first.  A partial+final aggregation per key (no window),
    so a key repeated a billion times still combines map-side."""
    aggs = [F.min(order_col).alias("position"), F.max(order_col).alias("kept"),
            F.count(F.lit(1)).alias("copies")]
    aggs += [F.max_by(c, order_col).alias(c) for c in payload_cols]
    return files.groupBy(*key_cols).agg(*aggs)
