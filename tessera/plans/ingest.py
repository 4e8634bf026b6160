"""Ingest, validation and cleaning operators (A-01..A-15) on the driver tables.

"Staged" queries first write driver rows to a new folder under the shared
folder (``spark.checkpoint.dir``) with a distributed write, then run the
operator on what was written; their oracle reads the original table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import locale_number, safe_name
from tessera.functions.text import locale_stats as locale_counts
from tessera.operators import clean as A
from tessera.session import staging_path
from tessera.sources import files as S
from tessera.sources import uploads as UP
from tessera.sources import workbook as W
from tessera.sources.tables import read_table
from tessera.streaming import uploads as U

CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "escapeQuotes": "true",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# catalog used by the staged catalog queries: table -> candidate names
CATALOG = {
    "nation": ("nations.csv", "nation.csv"),
    "customer": ("customer.csv", "clientes.csv"),
    "orders": ("orders.csv", "pedidos.csv"),
}
STAGED_AS = {"nation": "nation.csv", "customer": "clientes.csv", "orders": "orders.csv"}

UPLOAD_LIMIT_MB = 0.01


def stage_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_WRITE).csv(path)
    return path


def _stage_catalog(spark, sf_dir) -> str:
    root = staging_path(spark, "catalog")
    for table, name in STAGED_AS.items():
        stage_csv(read_table(spark, sf_dir, table), f"{root}/{name}")
    return root


def catalog_resolve(spark, sf_dir):
    """The resolved file of each table with the records it holds."""
    root = _stage_catalog(spark, sf_dir)
    resolved = S.resolve_catalog(spark, root, CATALOG)
    names = [r.resolved_file for r in resolved.collect()]
    records = (spark.read.options(**S.CSV_OPTIONS).schema("c0 string").csv([f"{root}/{n}" for n in names])
               .groupBy(S.entry_of(S.decoded(F.col("_metadata.file_path")), root).alias("resolved_file"))
               .agg(F.count(F.lit(1)).alias("records")))
    return resolved.join(records, "resolved_file", "left")


def catalog_load(spark, sf_dir):
    root = _stage_catalog(spark, sf_dir)
    schemas = {t: read_table(spark, sf_dir, t).schema for t in CATALOG}
    frames = S.load_catalog(spark, root, CATALOG, schemas)
    parts = []
    for table, df in frames.items():
        key = df.columns[0]
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"),
                            F.sum(F.col(key)).cast("bigint").alias("key_sum"))
                     .select(F.lit(table).alias("table_name"), "rows",
                             F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "key_sum"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_csv_roundtrip(spark, sf_dir):
    """Documents (multi-line text with quotes) through CSV and back."""
    docs = read_table(spark, sf_dir, "documents")
    path = stage_csv(docs, staging_path(spark, "documents-csv"))
    return S.read_csv(spark, path, docs.schema)


def scan_csv_split(spark, sf_dir):
    """A-03: documents in one CSV file, whose quoted cells hold line breaks, quotes and separators,
    cut into records by many tasks; all cells are text."""
    docs = read_table(spark, sf_dir, "documents")
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
              for c in docs.columns]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in quoted])
    path = _stage_lines(docs.withColumn("line", line), "line", ",".join(docs.columns), "documents-lines")
    rows, _ = S.scan_csv(spark, path)
    return rows.withColumn("size", F.length("text"))


def _stage_lines(df: DataFrame, line: str, header: str, label: str) -> str:
    """Text lines with a header line at the start of every part file."""
    path = staging_path(df.sparkSession, label)

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        for batch in batches:
            yield batch

    df.select(F.col(line).alias("value")).mapInPandas(with_header, "value string").write.text(path)
    return path


def scan_csv_ragged(spark, sf_dir):
    """A-03 on orders as text lines of two cells, where every tenth has one
    cell more (quoted separators don't count) and every seventh one less:
    the longer ones are rejected, the shorter ones end in a null."""
    orders = read_table(spark, sf_dir, "orders")
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    line = (F.when(k % 10 == 0, F.concat(key, F.lit(",a,b"))).when(k % 7 == 0, key)
            .otherwise(F.concat(key, F.lit(',"'), F.col("o_orderstatus"), F.lit(',""x"""'))))
    path = _stage_lines(orders.withColumn("line", line), "line", "id,status", "ragged")
    rows, rejected = S.scan_csv(spark, path)
    return rows.select("id", "status", F.lit(2).alias("cells"), F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select(F.col("record").alias("id"), F.lit(None).cast("string").alias("status"), "cells", "reason"))


def scan_csv_types(spark, sf_dir):
    """A-03 inference: whole numbers beside missing-value tokens, decimals, a
    month that stays text, booleans and a repeated header name."""
    orders = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 6 == 0, F.lit("NA")).otherwise((k * 2).cast("string")),
                       F.concat(k.cast("string"), F.lit(".5")), F.date_format("o_orderdate", "yyyy-MM"),
                       F.when(k % 2 == 0, F.lit("True")).otherwise(F.lit("False")))
    path = _stage_lines(orders.withColumn("line", line), "line", "id,n,n,month,even", "types")
    df = S.read_csv(spark, path)
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select("id", "n", F.col("`n.1`").alias("n_1"), "month", "even", F.lit(kinds).alias("kinds"))


def require_one_file(spark, sf_dir):
    """A-07a: nations as upload requests, suppliers with a large balance as
    their files; requests without a file get the message."""
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request"))
    files = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(
        F.col("s_nationkey").alias("request"), F.col("s_name").alias("file_name"))
    return S.requests_with_files(nation, files, "request")


WORKBOOK_CHUNK = 50000


def scan_workbook(spark, sf_dir):
    """Customers staged as workbooks (one per nation and block of customer
    keys, one sheet per market segment), then read back and typed."""
    customer = read_table(spark, sf_dir, "customer")
    root = staging_path(spark, "workbooks")
    name = F.concat(F.lit("clientes_"), F.col("c_nationkey").cast("string"), F.lit("_"),
                    F.floor(F.col("c_custkey") / WORKBOOK_CHUNK).cast("string"))
    W.write_workbooks(customer.withColumn("_file", name), "_file", "c_mktsegment", root,
                      customer.columns).write.format("noop").mode("overwrite").save()
    return W.sheet_table(W.read_workbooks(spark, root), customer.schema).drop("path", "sheet")


ORDERS_CHUNK = 5000


def scan_workbook_dates(spark, sf_dir):
    """Orders with their date, staged as workbooks of some thousand rows; odd
    ones use the 1904 date system and carry no cell references.  Dates come
    back as timestamps."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    block = F.floor(F.col("o_orderkey") / ORDERS_CHUNK)
    name = F.concat(F.when(block % 2 == 1, F.lit("odd")).otherwise(F.lit("even")), block.cast("string"))
    root = staging_path(spark, "workbook-dates")
    columns = ["o_orderkey", "o_orderdate", "o_orderstatus"]
    W.write_workbooks(orders.withColumn("_file", name).withColumn("_sheet", F.lit("p")), "_file", "_sheet", root,
                      columns, late="odd").write.format("noop").mode("overwrite").save()
    return W.sheet_table(W.read_workbooks(spark, root, limit_mb=64), orders.schema).select(*columns)


def _pages_as_uploads(spark, sf_dir) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    ext = (F.when(F.col("page_id") % 4 == 0, F.lit(".csv"))
           .when(F.col("page_id") % 4 == 1, F.lit(".XLSX"))
           .when(F.col("page_id") % 4 == 2, F.lit(".txt")).otherwise(F.lit("")))
    name = F.concat(F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1), ext)
    size = F.when(F.col("page_id") % 10 == 0, F.lit(0)).otherwise(F.octet_length("html"))
    return pages.select("page_id", name.alias("file_name"), size.cast("bigint").alias("length"))


def ingest_validate(spark, sf_dir):
    return S.validate(_pages_as_uploads(spark, sf_dir), limit_mb=UPLOAD_LIMIT_MB)


def ingest_manifest(spark, sf_dir):
    """Staged upload folder: CSV tables (orders and customers grow with the
    data), a text dump and an empty upload; one manifest row each with the
    validation outcome and the records of the accepted ones.  Byte sizes and
    part-file counts depend on the CSV writer, so they stay out of the result
    (``ingest_validate`` checks the size rule exactly)."""
    root = staging_path(spark, "uploads")
    stage_csv(read_table(spark, sf_dir, "orders"), f"{root}/pedidos.csv")
    stage_csv(read_table(spark, sf_dir, "customer"), f"{root}/clientes.csv")
    stage_csv(read_table(spark, sf_dir, "nation"), f"{root}/nation.csv")
    stage_csv(read_table(spark, sf_dir, "region"), f"{root}/Região Norte.CSV")
    read_table(spark, sf_dir, "benchmark").select("text").write.text(f"{root}/notes.txt")
    read_table(spark, sf_dir, "region").where("false").select("r_name").write.text(f"{root}/vazio.csv")
    entries = S.entry_names(spark, root).withColumnRenamed("entry", "file_name")
    named = entries.withColumn("table_name", safe_name(F.regexp_replace("file_name", r"\.[^.]+$", "")))
    checked = S.validate(named, size_col="bytes", largest_col="largest")
    names = [r.file_name for r in checked.where("accepted").select("file_name").collect()]
    records = (spark.read.options(**S.CSV_OPTIONS).schema("c0 string").csv([f"{root}/{n}" for n in names])
               .groupBy(S.entry_of(S.decoded(F.col("_metadata.file_path")), root).alias("file_name"))
               .agg(F.count(F.lit(1)).alias("records")))
    return checked.join(records, "file_name", "left").select(
        "file_name", "table_name", "reason", "message", "accepted", "records")


#: Columns of the wide upload.
WIDE = 300


def ingest_uploads(spark, sf_dir):
    """A-05 end to end, quarantine mode: an upload folder with orders and
    customers as CSV, suppliers as a CSV of many columns, the customers again
    as workbooks (one per nation and key block, one sheet per market segment
    and one with a header only), a text file and an empty one; the result is
    the profile of every table read, and every rejected file with its reason."""
    root = staging_path(spark, "upload-folder")
    stage_csv(read_table(spark, sf_dir, "orders"), f"{root}/pedidos.csv")
    customer = read_table(spark, sf_dir, "customer")
    stage_csv(customer, f"{root}/clientes.csv")
    stage_csv(read_table(spark, sf_dir, "supplier").select(
        "s_name", *[(F.col("s_suppkey") * i).alias(f"m{i}") for i in range(1, WIDE)]), f"{root}/largo.csv")
    name = F.concat(F.lit("clientes_"), F.col("c_nationkey").cast("string"), F.lit("_"),
                    F.floor(F.col("c_custkey") / WORKBOOK_CHUNK).cast("string"))
    W.write_workbooks(customer.withColumn("_file", name), "_file", "c_mktsegment", root,
                      customer.columns, header_only="Vazia").write.format("noop").mode("overwrite").save()
    read_table(spark, sf_dir, "benchmark").select("text").write.text(f"{root}/notes.txt")
    read_table(spark, sf_dir, "region").where("false").select("r_name").write.text(f"{root}/vazio.csv")
    _, profile, rejected = UP.load_uploads(spark, root, strict=False)
    return profile.select("table_name", "source_file", "rows",
                          F.size("columns").cast("bigint").alias("n_columns"),
                          "truncated_for_prompt", "position", "superseded").unionByName(
        rejected.select(F.col("file_name").alias("source_file"), "reason"), allowMissingColumns=True)


STREAM_TABLES = ("nation", "region", "customer", "orders")
HEADER_ONLY = "part"


def upload_stream(spark, sf_dir):
    """Streaming upload flow: CSV uploads (one with a header only, and a
    rejected text upload) in a drop folder, eight files per micro-batch, profiled per batch; the result
    is the row count per uploaded table over all batches."""
    root = staging_path(spark, "drop")
    for t in STREAM_TABLES:
        stage_csv(read_table(spark, sf_dir, t), f"{root}/{t}.csv")
    stage_csv(read_table(spark, sf_dir, HEADER_ONLY).where("false").coalesce(1), f"{root}/{HEADER_ONLY}.csv")
    read_table(spark, sf_dir, "benchmark").select("text").write.text(f"{root}/notes.txt")
    work = staging_path(spark, "stream")
    U.run_upload_stream(spark, root, f"{work}/sink", f"{work}/checkpoint", max_files=8)
    return U.uploaded_tables(spark, f"{work}/sink")


def upload_stream_rejected(spark, sf_dir):
    """Rejected uploads of the streaming flow: an empty file, which the file source never emits,
    and texts under an unsupported name, beside an accepted one."""
    root, work = staging_path(spark, "drop"), staging_path(spark, "stream")
    stage_csv(read_table(spark, sf_dir, "nation"), f"{root}/nation.csv")
    read_table(spark, sf_dir, "documents").select(F.md5("text").alias("value")).na.drop().write.text(f"{root}/notes.txt")
    filesystem, empty = S._filesystem(spark, f"{root}/empty.csv")
    filesystem.createNewFile(empty)
    U.run_upload_stream(spark, root, f"{work}/sink", f"{work}/checkpoint", max_files=8)
    return U.rejected_uploads(spark, f"{work}/sink").select("file_name", "reason", "bytes")


def manifest_dedupe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "n_chars", F.md5("text").alias("content_md5"), "lang")
    return S.dedupe_uploads(docs, ["source", "n_chars", "content_md5"], "doc_id", ["lang"])


def upload_stream_latest(spark, sf_dir):
    """``manifest_dedupe`` over micro-batches: the manifest arrives in eight files, latest rows first,
    two a batch."""
    keys = ["source", "n_chars", "content_md5"]
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "n_chars", F.md5("text").alias("content_md5"), "lang")
    root, work = staging_path(spark, "manifest"), staging_path(spark, "stream")
    docs.repartitionByRange(8, F.desc("doc_id")).write.parquet(root)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(root)
    U.run_dedupe_stream(stream, keys, "doc_id", ["lang"], f"{work}/sink", f"{work}/checkpoint")
    return U.deduped_uploads(spark, f"{work}/sink", keys)


def _events_with_gaps(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    blank = F.col("event_id") % 5 == 0
    return e.select(
        F.when(blank, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        F.when(blank, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(blank | (F.col("event_id") % 7 == 0), F.lit(None)).otherwise(F.col("value")).alias("value"),
    )


def drop_empty_rows(spark, sf_dir):
    return A.drop_empty_rows(_events_with_gaps(spark, sf_dir))


def drop_empty_columns(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    df = part.select("p_partkey", "p_name",
                     F.when(F.col("p_size") > 1000, F.col("p_brand")).alias("p_unused"), "p_type")
    return A.drop_empty_columns(A.drop_empty_rows(df))


TOKEN_CASES = ("NA", "null", "N/A", "None", "nan", "#N/A")


def _part_with_tokens(spark, sf_dir) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_size") % 8
    expr = None
    for i, tok in enumerate(TOKEN_CASES):
        expr = (F.when(k == i, F.lit(tok)) if expr is None else expr.when(k == i, F.lit(tok)))
    name = expr.otherwise(F.col("p_name"))
    price = F.when(F.col("p_size") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return part.select("p_partkey", name.alias("p_name"), price.alias("p_retailprice"))


def null_tokens(spark, sf_dir):
    return A.normalize_nulls(_part_with_tokens(spark, sf_dir))


def locale_numbers(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    money_text = F.concat(F.lit("$"), F.translate(
        F.col("p_retailprice").cast("decimal(12,2)").cast("string"), ".", ","))
    pct_text = F.concat(F.col("p_size").cast("string"), F.lit(","),
                        F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("%"))
    staged = part.select("p_partkey", money_text.alias("money_text"), pct_text.alias("pct_text"))
    return staged.select("p_partkey", "money_text", locale_number(F.col("money_text")).alias("money"),
                         "pct_text", locale_number(F.col("pct_text")).alias("ratio"))


def locale_stats(spark, sf_dir):
    """A-11 before parsing: a column that mixes locale text, plain numbers and
    text without any number, counted and parsed per part size."""
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit("$"), F.translate(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), ".", ",")))
            .when(k % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5")))
            .when(k % 4 == 2, F.lit("n/d")))
    return part.select("p_size", text.alias("t")).groupBy("p_size").agg(
        *locale_counts(F.col("t")), F.round(F.sum(locale_number(F.col("t"))), 4).alias("total"))


def strip_columns(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    padded = part.select(F.col("p_partkey").alias(" p_partkey "), F.col("p_name").alias("\tp_name"),
                         F.col("p_brand").alias("p_brand "))
    return A.strip_column_names(padded)


def safe_names(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_name", safe_name(F.col("p_name")).alias("table_name"))


def name_collision(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    upload = F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("-")),
                      F.col("lang"))
    named = docs.select("doc_id", upload.alias("upload_name")).withColumn(
        "table_name", safe_name(F.col("upload_name")))
    return A.resolve_name_collisions(named, "table_name", "doc_id")


def to_records(spark, sf_dir):
    """Every fifth customer has no name: its key stays, with a null."""
    customer = read_table(spark, sf_dir, "customer")
    return A.to_records(customer.withColumn("c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name"))))


QUERIES = {
    "catalog_resolve": catalog_resolve,
    "catalog_load": catalog_load,
    "scan_csv_roundtrip": scan_csv_roundtrip,
    "scan_csv_split": scan_csv_split,
    "scan_csv_ragged": scan_csv_ragged,
    "scan_csv_types": scan_csv_types,
    "scan_workbook_dates": scan_workbook_dates,
    "require_one_file": require_one_file,
    "locale_stats": locale_stats,
    "scan_workbook": scan_workbook,
    "ingest_manifest": ingest_manifest,
    "ingest_uploads": ingest_uploads,
    "manifest_dedupe": manifest_dedupe,
    "upload_stream": upload_stream,
    "upload_stream_latest": upload_stream_latest,
    "upload_stream_rejected": upload_stream_rejected,
    "ingest_validate": ingest_validate,
    "drop_empty_rows": drop_empty_rows,
    "drop_empty_columns": drop_empty_columns,
    "null_tokens": null_tokens,
    "locale_number": locale_numbers,
    "strip_columns": strip_columns,
    "safe_name": safe_names,
    "name_collision": name_collision,
    "to_records": to_records,
}

_SLUG = "coalesce(nullif(trim(regexp_replace({x}, '[^0-9A-Za-zÀ-ÿ]+', '_', 'g'), '_'), ''), 'tabela')"


def _mb_text(size: str) -> str:
    # one decimal, ties to even on the exact value (Python format rounding)
    return f"""(SELECT CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) FROM (
      SELECT q + CASE WHEN r > 524288 OR (r = 524288 AND q % 2 = 1) THEN 1 ELSE 0 END AS t FROM (
        SELECT ({size} * 10) // 1048576 AS q, ({size} * 10) % 1048576 AS r)))"""


SQL: dict[str, str] = {}

SQL["catalog_resolve"] = """
SELECT 'nation' AS table_name, 'nation.csv' AS resolved_file, CAST(1 AS BIGINT) AS candidate_rank,
       count(*) AS records FROM nation
UNION ALL SELECT 'customer', 'clientes.csv', 1, count(*) FROM customer
UNION ALL SELECT 'orders', 'orders.csv', 0, count(*) FROM orders"""

SQL["scan_csv_split"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars,
       CAST(length(text) AS INTEGER) AS size
FROM documents"""

SQL["scan_csv_ragged"] = """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey AS VARCHAR) || ',a,b' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
       CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus || ',"x"' END AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN 3 ELSE 2 END AS cells,
       CASE WHEN o_orderkey % 10 = 0 THEN 'ragged' END AS reason
FROM orders"""

SQL["scan_csv_types"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey * 2 END AS n,
       CAST(CAST(o_orderkey AS VARCHAR) || '.5' AS DOUBLE) AS n_1,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, o_orderkey % 2 = 0 AS even,
       'id:bigint,n:bigint,n.1:double,month:string,even:boolean' AS kinds
FROM orders"""

SQL["scan_workbook_dates"] = "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders"

SQL["require_one_file"] = """
SELECT n_nationkey AS request, count(s_name) AS files,
       CASE WHEN count(s_name) = 0 THEN 'Envie pelo menos um arquivo CSV ou Excel.' END AS message
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000
GROUP BY n_nationkey"""

SQL["locale_stats"] = """
SELECT p_size, count(CASE WHEN p_partkey % 4 < 3 THEN 1 END) AS values,
       count(CASE WHEN p_partkey % 4 = 1 THEN 1 END) AS plain,
       count(CASE WHEN p_partkey % 4 = 2 THEN 1 END) AS unparseable,
       round(CAST(sum(CASE p_partkey % 4 WHEN 0 THEN CAST(p_retailprice AS DECIMAL(12,2))
                           WHEN 1 THEN p_size + CAST(0.5 AS DECIMAL(12,2)) END) AS DOUBLE), 4) AS total
FROM part GROUP BY p_size"""

SQL["catalog_load"] = """
SELECT 'nation' AS table_name, count(*) AS rows, CAST(3 AS BIGINT) AS n_columns,
       CAST(sum(n_nationkey) AS BIGINT) AS key_sum FROM nation
UNION ALL SELECT 'customer', count(*), 5, CAST(sum(c_custkey) AS BIGINT) FROM customer
UNION ALL SELECT 'orders', count(*), 6, CAST(sum(o_orderkey) AS BIGINT) FROM orders"""

SQL["scan_csv_roundtrip"] = "SELECT * FROM documents"

SQL["scan_workbook"] = f"""
SELECT {_SLUG.format(x="'clientes_' || CAST(c_nationkey AS VARCHAR) || '_' || "
                       f"CAST(CAST(floor(c_custkey / {WORKBOOK_CHUNK}) AS BIGINT) AS VARCHAR) || '_' || c_mktsegment")}
         AS table_name, *
FROM customer"""

SQL["ingest_manifest"] = """
SELECT 'pedidos.csv' AS file_name, 'pedidos' AS table_name, NULL AS reason, NULL AS message, true AS accepted,
       (SELECT count(*) FROM orders) AS records
UNION ALL SELECT 'clientes.csv', 'clientes', NULL, NULL, true, (SELECT count(*) FROM customer)
UNION ALL SELECT 'nation.csv', 'nation', NULL, NULL, true, (SELECT count(*) FROM nation)
UNION ALL SELECT 'Região Norte.CSV', 'Região_Norte', NULL, NULL, true, (SELECT count(*) FROM region)
UNION ALL SELECT 'notes.txt', 'notes', 'unsupported', 'Formato não suportado em notes.txt. Use .csv, .xls, .xlsx.',
       false, NULL
UNION ALL SELECT 'vazio.csv', 'vazio', 'empty', 'O arquivo vazio.csv está vazio.', false, NULL"""

SQL["ingest_uploads"] = f"""
WITH books AS (
  SELECT 'clientes_' || CAST(c_nationkey AS VARCHAR) || '_'
           || CAST(CAST(floor(c_custkey / {WORKBOOK_CHUNK}) AS BIGINT) AS VARCHAR) AS stem,
         c_mktsegment AS sheet, count(*) AS rows
  FROM customer GROUP BY ALL),
sheets AS (SELECT stem, sheet, rows FROM books UNION ALL SELECT DISTINCT stem, 'Vazia', 0 FROM books),
tables AS (
  SELECT 'pedidos' AS table_name, 'pedidos.csv' AS source_file, (SELECT count(*) FROM orders) AS rows,
         CAST(6 AS BIGINT) AS n_columns
  UNION ALL
  SELECT 'clientes', 'clientes.csv', (SELECT count(*) FROM customer), 5
  UNION ALL
  SELECT 'largo', 'largo.csv', (SELECT count(*) FROM supplier), {WIDE}
  UNION ALL
  SELECT {_SLUG.format(x="stem || '_' || sheet")}, stem || '.xlsx', rows, 5 FROM sheets),
files AS (
  SELECT source_file, CAST(row_number() OVER (ORDER BY source_file) - 1 AS INTEGER) AS position
  FROM (SELECT DISTINCT source_file FROM tables))
SELECT table_name, source_file, rows, n_columns, rows > 120 AS truncated_for_prompt, position,
       false AS superseded, NULL AS reason
FROM tables JOIN files USING (source_file)
UNION ALL SELECT NULL, 'notes.txt', NULL, NULL, NULL, NULL, NULL, 'unsupported'
UNION ALL SELECT NULL, 'vazio.csv', NULL, NULL, NULL, NULL, NULL, 'empty'"""

_PAGES = """
pages_up AS (
  SELECT page_id,
         regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) ||
           CASE page_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.txt' ELSE '' END
           AS file_name,
         CAST(CASE WHEN page_id % 10 = 0 THEN 0 ELSE strlen(html) END AS BIGINT) AS length
  FROM pages),
ext AS (SELECT *, lower(regexp_extract(file_name, '.(\\.[^.]+)$', 1)) AS extension FROM pages_up),
v AS (SELECT *, CASE WHEN length <= 0 THEN 'empty'
                     WHEN length / 1048576.0 > {limit} THEN 'too_large'
                     WHEN extension NOT IN ('.csv', '.xls', '.xlsx') THEN 'unsupported' END AS reason
      FROM ext)"""

VALIDATED_SQL = f"""WITH {_PAGES.format(limit=UPLOAD_LIMIT_MB)}
SELECT page_id, file_name, length, reason,
       CASE reason
         WHEN 'empty' THEN 'O arquivo ' || file_name || ' está vazio.'
         WHEN 'too_large' THEN 'O arquivo ' || file_name || ' tem ' || {_mb_text('length')}
                               || 'MB. O limite atual é {UPLOAD_LIMIT_MB}MB por arquivo.'
         WHEN 'unsupported' THEN 'Formato não suportado em ' || file_name || '. Use .csv, .xls, .xlsx.'
       END AS message,
       reason IS NULL AS accepted
FROM v"""

SQL["ingest_validate"] = VALIDATED_SQL

SQL["upload_stream"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in STREAM_TABLES) + (
    f" UNION ALL SELECT '{HEADER_ONLY}', 0")

SQL["manifest_dedupe"] = """
SELECT source, n_chars, md5(text) AS content_md5, min(doc_id) AS position, max(doc_id) AS kept,
       count(*) AS copies, arg_max(lang, doc_id) AS lang
FROM documents GROUP BY source, n_chars, md5(text)"""

SQL["upload_stream_latest"] = SQL["manifest_dedupe"]

SQL["upload_stream_rejected"] = """
SELECT 'notes.txt' AS file_name, 'unsupported' AS reason, CAST(sum(strlen(md5(text)) + 1) AS BIGINT) AS bytes
FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'empty.csv', 'empty', 0"""

_EVENTS_GAPS = """
eg AS (
  SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value
  FROM events)"""

SQL["drop_empty_rows"] = f"""WITH {_EVENTS_GAPS}
SELECT * FROM eg WHERE NOT (user_id IS NULL AND event_type IS NULL AND value IS NULL)"""

SQL["drop_empty_columns"] = "SELECT p_partkey, p_name, p_type FROM part"

SQL["null_tokens"] = f"""
WITH t AS (
  SELECT p_partkey,
         CASE p_size % 8 {' '.join(f"WHEN {i} THEN '{tok}'" for i, tok in enumerate(TOKEN_CASES))}
           ELSE p_name END AS p_name,
         CASE WHEN p_size % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS p_retailprice
  FROM part)
SELECT p_partkey,
       CASE WHEN p_name IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan',
                            '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a',
                            'nan', 'null') THEN NULL ELSE p_name END AS p_name,
       CASE WHEN isnan(p_retailprice) THEN NULL ELSE p_retailprice END AS p_retailprice
FROM t"""

SQL["locale_number"] = """
WITH t AS (
  SELECT p_partkey,
         '$' || replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS money_text,
         CAST(p_size AS VARCHAR) || ',' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '%'
           AS pct_text
  FROM part),
p AS (
  SELECT *,
    CAST(TRY_CAST(replace(regexp_replace(money_text, '[^0-9,\\-]', '', 'g'), ',', '.') AS DECIMAL(18,4))
         AS DOUBLE) AS m,
    CAST(TRY_CAST(replace(regexp_replace(pct_text, '[^0-9,\\-]', '', 'g'), ',', '.') AS DECIMAL(18,4))
         AS DOUBLE) AS r
  FROM t)
SELECT p_partkey, money_text, m AS money, pct_text, round(r / 100.0, 6) AS ratio FROM p"""

SQL["strip_columns"] = "SELECT p_partkey, p_name, p_brand FROM part"

SQL["safe_name"] = f"SELECT p_partkey, p_name, {_SLUG.format(x='p_name')} AS table_name FROM part"

SQL["name_collision"] = f"""
WITH n AS (
  SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '-' END || lang AS upload_name
  FROM documents),
s AS (SELECT doc_id, upload_name, {_SLUG.format(x='upload_name')} AS table_name FROM n)
SELECT table_name, doc_id, upload_name,
       doc_id <> max(doc_id) OVER (PARTITION BY table_name) AS superseded
FROM s"""

SQL["to_records"] = """
SELECT to_json({'c_custkey': c_custkey, 'c_name': CASE WHEN c_custkey % 5 > 0 THEN c_name END, 'c_nationkey': c_nationkey,
                'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS record
FROM customer"""
