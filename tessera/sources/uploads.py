"""A-05 in batch: a folder of uploaded files -> named, cleaned tables and
their profile (the upload step of the reference, as Spark work).

* The manifest is the folder listing (content never read), validated with
  the reference's rules (A-07) and no size limit unless one is given; strict
  mode raises the first rejection in name order, otherwise rejected files are
  returned with their reason.
* CSV uploads and workbook sheets become the same long rows (source, header,
  cells), written once under the shared folder, sorted by table within each
  file, so a table reads only the row groups that can hold it.  CSV
  uploads of similar width (within a factor of two) are read by one scan, two
  if some have quoted line breaks, which makes those unsplittable: a wide
  upload pads no narrow one, and the scans grow with the logarithm of the
  widest header.  All workbooks are read by one parse (one task per workbook):
  the number of jobs does not grow with the number of files.
* Header names are made once per table, in time that grows with the header as
  a sort does, and are not repeated in the rows.  A sheet or CSV with a header
  only is a table without rows that keeps its columns.
* Upload positions come from sorted ranges of the names, not from one task.
* Names, kept columns, types and row counts of all tables come from two
  aggregations over those rows: a stored catalog that is never collected.
* Records with more cells than their header, and CSV files with bytes that are
  not UTF-8, are rejected: strict mode raises, else they are counted and left
  out.
* Table names are the safe names of ``<file>`` or ``<file>_<sheet>``
  (A-13); a later table with the same name replaces an earlier one (last
  wins, A-14); the profile keeps both, the replaced one with
  ``superseded = true``.

Only metadata reaches the driver: the names of the CSV uploads and, on
access, the catalog row of the one table asked for.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import NULL_TOKENS, extension, safe_name, stem
from tessera.operators.clean import DuplicateColumnError, resolve_name_collisions
from tessera.operators.number import number_rows
from tessera.operators.render import CLI_ROWS
from tessera.session import staging_path
from tessera.sources.files import (_SCHEME, CSV_OPTIONS, MSG_NO_FILES, REPEATED_SEPARATOR, UNNAMED_PREFIX,
                                    decoded, entry_names, entry_of, first_rejection,
                                   narrowest, odd_quotes, type_counts, validate)
from tessera.sources.workbook import parse_workbooks

MSG_LEGACY = "O arquivo {file} usa o formato .xls antigo; salve-o como .xlsx."
MSG_RAGGED = "O arquivo {file} tem linhas com mais campos do que o cabeçalho."
MSG_ENCODING = "O arquivo {file} não está em UTF-8."

ROWS_SCHEMA = ("table_id string, source_file string, sheet string, sheet_no int, row bigint, "
               "header array<string>, cells array<string>, ragged boolean")


class UploadError(ValueError):
    pass


def header_columns(header: Column, width: Column) -> Column:
    """Column names as pandas makes them from a header row, as one array
    expression: a blank cell (or a position beyond the header) is
    ``Unnamed: i``, a repeated name gets ``.1``, ``.2``, ...; names are
    stripped of white space."""
    idx = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    raw = F.transform(idx, lambda i: F.struct(F.coalesce(
        F.nullif(F.try_element_at(header, i + 1), F.lit("")),
        F.concat(F.lit(UNNAMED_PREFIX), i.cast("string"))).alias("name"), i.alias("pos")))
    # sorted by name, a cell's number is how many equal ones stand right before it
    by_name = F.array_sort(raw)

    def count(acc, x):
        n = F.when(x["name"] == acc["name"], acc["n"] + 1).otherwise(F.lit(0))
        return F.struct(x["name"].alias("name"), n.alias("n"),
                        F.concat(acc["all"], n.cast("string"), F.lit(" ")).alias("all"))

    # gathered as text: appending to an array copies it element by element
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("n"), F.lit("").alias("all"))
    earlier = F.split(F.aggregate(by_name, start, count)["all"], " ")
    numbered = F.filter(F.arrays_zip(by_name.alias("cell"), earlier.alias("n")), lambda x: x["cell"].isNotNull())
    named = F.array_sort(F.transform(numbered, lambda x: F.struct(
        x["cell"]["pos"].alias("pos"),
        F.when(x["n"] != "0", F.concat(x["cell"]["name"], F.lit(REPEATED_SEPARATOR), x["n"]))
        .otherwise(x["cell"]["name"]).alias("name"))))
    return F.transform(named, lambda x: F.regexp_replace(x["name"], r"(?U)^\s+|\s+$", ""))


def _value(x):
    """A cell that holds a value (not null, not a missing-value token)."""
    return x.isNotNull() & ~x.isin(*NULL_TOKENS)


def _table_id() -> Column:
    return F.sha1(F.concat_ws("\t", F.col("source_file"), F.coalesce("sheet", F.lit(""))))


def workbook_rows(spark: SparkSession, root: str, limit_mb: float | None) -> DataFrame:
    """Long rows of the first-level ``.xlsx`` files that pass the size rules (a
    filter the ``binaryFile`` source applies before reading any content), with
    one row per sheet that holds its header and no cells."""
    size_ok = F.col("length") > 0
    if limit_mb is not None:
        size_ok = size_ok & (F.col("length") <= F.lit(int(limit_mb * 1048576)))
    first_level = F.regexp_replace(F.col("path"), _SCHEME, "").rlike(
        r"^\Q" + re.sub(_SCHEME, "", root) + r"\E/[^/]+$")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(root)
             .where(size_ok & first_level))
    return parse_workbooks(files, header_rows=True).select(
        entry_of(F.col("path"), root).alias("source_file"), "sheet", "sheet_no",
        F.col("row").cast("bigint").alias("row"), "header", "cells", F.lit(False).alias("ragged"))


def split_line(line: Column, sep: str = ",") -> Column:
    """Cells of a header line, quotes removed and doubled quotes single."""
    cell = r'((?:"(?:[^"]++|"")*+"|[^"' + sep + r"]++)*+)" + sep
    return F.transform(F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(cell), F.lit(1)), lambda x: F.replace(
        F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))


def csv_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """One stored row per CSV file (a part of a folder counts as one): its
    upload, header cells, whether a quoted cell goes over a line end, and
    whether its bytes are UTF-8.  One pass over the lines."""
    lines = spark.read.text([f"{root}/{n}" for n in names]).select(
        "value", F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    at = F.when(F.col("block") == 0, F.col("n"))
    files = lines.groupBy("uri").agg(
        F.min_by("value", at).alias("line"), F.max(odd_quotes(F.col("value"))).alias("breaks"),
        F.max(~F.is_valid_utf8("value")).alias("broken")).select(
        "uri", entry_of(decoded(F.col("uri")), root).alias("source_file"),
        split_line(F.regexp_replace("line", "^\ufeff", "")).alias("header"), "breaks", "broken")
    path = staging_path(spark, "csv-files")
    files.write.parquet(path)
    return spark.read.schema(files.schema).parquet(path)


def csv_rows(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Long rows of the CSV files described by ``files`` (see ``csv_files``),
    one scan per class of widths: a row is at most twice as wide as its file."""
    uploads = files.groupBy("source_file").agg(F.max("breaks").alias("breaks"),
                                               F.max(F.size("header")).alias("width")).collect()
    headers = files.select("uri", "source_file", F.size("header").alias("n"))
    out = None
    for breaks, bits in sorted({(u.breaks, u.width.bit_length()) for u in uploads}):
        mine = [u for u in uploads if (u.breaks, u.width.bit_length()) == (breaks, bits)]
        width = max(u.width for u in mine) + 1  # one more shows records longer than the header
        cells = F.array(*[F.col(f"c{i}") for i in range(width)])
        raw = (spark.read.options(**CSV_OPTIONS).option("multiLine", breaks).option("enforceSchema", "true")
               .schema(", ".join(f"c{i} string" for i in range(width)))
               .csv([f"{root}/{u.source_file}" for u in mine])
               .select(cells.alias("all"), F.col("_metadata.file_path").alias("uri"),
                       F.monotonically_increasing_id().alias("row")))
        n = F.col("n")
        part = raw.join(headers, "uri").select(
            "source_file", F.lit(None).cast("string").alias("sheet"), F.lit(0).alias("sheet_no"), "row",
            F.lit(None).cast("array<string>").alias("header"), F.slice("all", 1, n).alias("cells"),
            F.exists(F.slice("all", n + 1, F.greatest(F.lit(1), F.lit(width) - n)),
                     lambda x: x.isNotNull()).alias("ragged"))
        out = part if out is None else out.unionByName(part)
    return out


def table_catalog(spark: SparkSession, long_rows: DataFrame, headers: DataFrame | None,
                  positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store the long rows once and describe every table in them.

    The catalog (one row per table: names, kept column positions, types, row
    count, rejected records) comes from two aggregations over the stored rows
    and is stored too; it stays distributed however many tables there are.
    ``headers`` (source_file, header) has the headers of the CSV uploads, those
    of sheets are rows of their own, and ``positions`` gives each file its
    upload position.  Returns (rows, catalog)."""
    staged = staging_path(spark, "upload-rows")
    # one folder, each file sorted by table: a table lookup is a pushed filter
    # that skips row groups by their min/max (no folder per table, which would
    # mean millions of folders when uploads grow with the data)
    (long_rows.withColumn("table_id", _table_id()).sortWithinPartitions("table_id", "row")
     .write.parquet(staged))
    rows = spark.read.schema(ROWS_SCHEMA).parquet(staged)
    # tokens become null first, so rows and columns made of tokens count as empty
    cells = F.transform(F.col("cells"), lambda x: F.when(_value(x), x))
    rows = rows.withColumn("cells", cells)
    kept_rows = rows.where("NOT ragged")

    filled_row = F.exists(F.col("cells"), lambda x: x.isNotNull()) & ~F.col("ragged")
    described = rows.select("table_id", "source_file", "sheet", "sheet_no", "header", "cells", "ragged")
    if headers is not None:
        described = described.unionByName(headers.select(
            "source_file", "header", F.lit(None).cast("string").alias("sheet"), F.lit(0).alias("sheet_no"),
            F.array().cast("array<string>").alias("cells"), F.lit(False).alias("ragged"))
            .withColumn("table_id", _table_id()))
    tables = described.groupBy("table_id", "source_file", "sheet", "sheet_no").agg(
        F.coalesce(F.first("header", ignorenulls=True), F.array().cast("array<string>")).alias("header"),
        F.count(F.when(filled_row, 1)).alias("rows"),
        F.count(F.when(F.col("ragged"), 1)).alias("ragged_rows"),
        F.coalesce(F.greatest(F.max(F.size("cells")), F.max(F.size("header"))), F.lit(0)).alias("width"))
    # below the joins, so that names are made once per table and not once per kept column
    tables = tables.withColumn("names", header_columns(F.col("header"), F.col("width"))).drop("header")
    # positions holding a value somewhere in the table, with the narrowest
    # type of all their values (counts per (table, position), combined
    # map-side; then one array per table, bounded by its width)
    v = F.col("v")
    per_column = (kept_rows.select("table_id", F.posexplode("cells").alias("pos", "v")).where(v.isNotNull())
                  .groupBy("table_id", "pos").agg(*type_counts(v)))
    kind = narrowest(*[F.col(c) for c in ("n", "n_long", "n_double", "n_boolean")])
    filled = per_column.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", kind.alias("type")))).alias("kept"))
    # a table without rows keeps its columns; else columns without a value go
    every = F.transform(F.sequence(F.lit(0), F.col("width") - 1),
                        lambda i: F.struct(i.alias("pos"), F.lit("string").alias("type")))
    header_only = (F.col("rows") == 0) & (F.col("width") > 0)
    kept = F.coalesce(F.col("kept"), F.when(header_only, every),
                      F.array().cast("array<struct<pos:int,type:string>>"))
    keep = F.transform(kept, lambda c: c["pos"])
    file_stem = stem(F.col("source_file"))
    name = F.when(F.col("sheet").isNull(), file_stem).otherwise(F.concat(file_stem, F.lit("_"), F.col("sheet")))
    catalog = (tables.join(filled, "table_id", "left")
               .join(positions.select(F.col("file_name").alias("source_file"), "position"), "source_file")
               .select("table_id", "source_file", "sheet", "sheet_no", "position",
                       safe_name(name).alias("table_name"), "rows", "ragged_rows", keep.alias("positions"),
                       F.transform(keep, lambda p: F.element_at("names", p + 1)).alias("columns"),
                       F.transform(kept, lambda c: c["type"]).alias("types")))
    path = staging_path(spark, "table-catalog")
    catalog.write.parquet(path)
    catalog = spark.read.schema(catalog.schema).parquet(path)
    bad = (catalog.where(F.size(F.array_distinct("columns")) != F.size("columns"))
           .select("source_file", "sheet", "columns").limit(1).collect())
    if bad:
        raise DuplicateColumnError(f"columns equal after strip in {bad[0].source_file} / "
                                   f"{bad[0].sheet}: {bad[0].columns}")
    return kept_rows, catalog


class Dataset(Mapping):
    """Table name -> cleaned DataFrame, the last table of a name winning.

    A table is looked up in the stored catalog and defined on first access,
    so thousands of tables cost no plan building for those nobody reads.
    Iterating lists the winning names (metadata)."""

    def __init__(self, rows: DataFrame, winners: DataFrame, infer_types: bool = False):
        self._rows, self._winners, self._infer_types = rows, winners, infer_types

    def __getitem__(self, name: str) -> DataFrame:
        t = self._winners.where(F.col("table_name") == name).limit(1).collect()
        if not t:
            raise KeyError(name)
        (t,) = t
        filled = F.exists(F.col("cells"), lambda x: x.isNotNull())
        typed = self._infer_types or t.sheet is None

        def cell(p, kind):  # rows end at their last cell: later positions are null
            text = F.try_element_at(F.col("cells"), F.lit(p + 1))
            return F.trim(text).try_cast(kind) if typed and kind != "string" else text

        return (self._rows.where((F.col("table_id") == t.table_id) & filled)
                .select(*[cell(p, k).alias(c) for p, c, k in zip(t.positions, t.columns, t.types)]))

    def __iter__(self):
        names = self._winners.select("table_name").collect()
        return iter(sorted(r.table_name for r in names))

    def __len__(self) -> int:
        return self._winners.count()


def load_uploads(spark: SparkSession, root: str, limit_mb: float | None = None,
                 strict: bool = True, max_rows: int = CLI_ROWS,
                 infer_types: bool = False) -> tuple[Dataset, DataFrame, DataFrame]:
    """A-05: (dataset, profile, rejected) for the files under ``root``.

    ``profile`` has one row per table read (upload position in name order,
    sheet order), with ``superseded`` for tables replaced by a later one and
    ``ragged_rows`` for rejected records.  ``rejected`` has the files left out
    (file_name, reason, message); in strict mode the first one raises.  CSV
    columns get the narrowest type of their values; sheet cells are text, or
    typed the same way with ``infer_types``."""
    root = root.rstrip("/")
    entries = entry_names(spark, root).withColumnRenamed("entry", "file_name")
    checked = validate(entries, size_col="bytes", limit_mb=limit_mb, largest_col="largest")
    checked = checked.withColumn("ext", extension(F.col("file_name")))
    legacy = F.col("accepted") & (F.col("ext") == ".xls")
    checked = (checked.withColumn("message", F.when(legacy, _message(MSG_LEGACY)).otherwise(F.col("message")))
               .withColumn("reason", F.when(legacy, F.lit("legacy")).otherwise(F.col("reason")))
               .withColumn("accepted", F.col("accepted") & ~legacy))
    csv = [r.file_name for r in checked.where("accepted AND ext = '.csv'").select("file_name").collect()]
    files = csv_files(spark, root, csv) if csv else None
    if files is not None:
        broken = files.groupBy("source_file").agg(F.max("broken").alias("broken")).where("broken")
        hit = broken.select(F.col("source_file").alias("file_name"), F.lit(True).alias("broken"))
        wrong = F.col("accepted") & F.coalesce("broken", F.lit(False))
        checked = (checked.join(hit, "file_name", "left")
                   .withColumn("message", F.when(wrong, _message(MSG_ENCODING)).otherwise(F.col("message")))
                   .withColumn("reason", F.when(wrong, F.lit("encoding")).otherwise(F.col("reason")))
                   .withColumn("accepted", F.col("accepted") & ~wrong).drop("broken"))
        files = files.join(broken.select("source_file"), "source_file", "left_anti")
    path = staging_path(spark, "manifest")
    checked.write.parquet(path)
    checked = spark.read.schema(checked.schema).parquet(path)
    if strict:
        message = first_rejection(checked, "file_name")
        if message:
            raise UploadError(message)
    accepted = number_rows(checked.where("accepted").select("file_name", "ext"), [F.col("file_name")],
                           "position", "upload-positions").withColumn("position", F.col("position").cast("int"))
    kinds = {r.ext for r in accepted.select("ext").distinct().collect()}
    if not kinds:
        raise UploadError(MSG_NO_FILES)

    parts = []
    if ".csv" in kinds:
        parts.append(csv_rows(spark, root, files))
    if ".xlsx" in kinds:
        parts.append(workbook_rows(spark, root, limit_mb))
    long_rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows, catalog = table_catalog(spark, long_rows, files, accepted)
    if strict:
        bad = catalog.where("ragged_rows > 0").orderBy("source_file").select("source_file").head()
        if bad:
            raise UploadError(MSG_RAGGED.format(file=bad.source_file))

    order = (F.col("position").cast("bigint") * (1 << 20) + F.col("sheet_no")).alias("_order")
    ranked = resolve_name_collisions(catalog.select("*", order), "table_name", "_order").drop("_order")
    profile = ranked.select(
        "table_name", "source_file", "rows", "columns", (F.col("rows") > max_rows).alias("truncated_for_prompt"),
        "sheet", "sheet_no", "position", "ragged_rows", "superseded")
    rejected = checked.where("NOT accepted").select("file_name", "reason", "message")
    return Dataset(rows, ranked.where("NOT superseded"), infer_types), profile, rejected


def _message(template: str) -> Column:
    before, after = template.split("{file}")
    return F.concat(F.lit(before), F.col("file_name"), F.lit(after))
