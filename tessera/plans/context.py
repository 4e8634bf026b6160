"""Profile, rendering, generation, error and sink operators (A-16..A-32)
bound to the driver tables, with their oracle SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import errors as ERR
from tessera.functions.text import bytes_text, thousands_text
from tessera.operators import generate as G
from tessera.operators import profile as PR
from tessera.operators import render as R
from tessera.plans.driver import with_unknown_customers
from tessera.plans.oracle import UNKNOWN_CUSTOMERS
from tessera.session import staging_path
from tessera.sources import sinks as K
from tessera.sources.tables import read_table

# declared schemas of the profiled driver tables (metadata, column order kept)
PROFILED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
ORDER_COLS = PROFILED["orders"]

SYSTEM_TEXT = "Analista de dados: use somente os números fornecidos."
USER_TEMPLATE = "Dados agregados:\n{context}\n\nEscreva a análise executiva em Markdown."

PRIMARY_FALLBACKS = ("retired-model", "digest-model")


def profile(spark, sf_dir) -> DataFrame:
    tables = [(t, f"{t}.parquet", read_table(spark, sf_dir, t)) for t in PROFILED]
    return PR.table_profile(tables, R.CLI_ROWS)


def table_profile(spark, sf_dir):
    return profile(spark, sf_dir)


def column_stats(spark, sf_dir):
    """A-16 extended on the customer table, with exact distinct counts."""
    return PR.column_stats(read_table(spark, sf_dir, "customer"), exact=True)


def dataset_totals(spark, sf_dir):
    return PR.dataset_totals(profile(spark, sf_dir))


def column_preview(spark, sf_dir):
    return PR.column_preview([(t, read_table(spark, sf_dir, t)) for t in PROFILED])


def orders_by_state(spark, sf_dir, orders: DataFrame | None = None) -> DataFrame:
    """Orders with their customer's state; the state of an unknown customer
    is null.  Every order stays."""
    orders = read_table(spark, sf_dir, "orders") if orders is None else orders
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return (orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("state", *ORDER_COLS))


def orders_per_state(spark, sf_dir, orders: DataFrame | None = None) -> DataFrame:
    """Number of orders by state from the customer key alone: counted per
    customer before the join, so no other column of the orders is read."""
    orders = read_table(spark, sf_dir, "orders") if orders is None else orders
    counted = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return (counted.join(customer, counted["o_custkey"] == customer["c_custkey"], "left")
            .groupBy("c_nationkey").agg(F.sum("n").alias("n"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .groupBy("state").agg(F.sum("n").alias("_total")))


def stored_orders_by_state(spark, sf_dir, orders: DataFrame | None = None) -> DataFrame:
    """Orders with their state, joined once and written to the shared folder,
    for queries that read it twice (totals and lines)."""
    joined = orders_by_state(spark, sf_dir, orders)
    path = staging_path(spark, "orders-by-state")
    joined.write.parquet(path)
    return spark.read.schema(joined.schema).parquet(path)


def first_n_per_group(spark, sf_dir):
    return R.first_n_per_group(orders_by_state(spark, sf_dir), ["state"], ["o_orderkey"],
                               R.WEB_ROWS).select("state", "o_orderkey", "pos")


def sample_note(spark, sf_dir):
    totals = orders_by_state(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("rows"))
    return totals.select("state", "rows", R.sample_note(F.col("rows"), R.WEB_ROWS).alias("note"))


def context_per_group(spark, sf_dir):
    return R.context_blocks(stored_orders_by_state(spark, sf_dir), ["state"], F.col("state"),
                            ["o_orderkey"], R.WEB_ROWS, ORDER_COLS)


def context_per_state(spark, sf_dir):
    """A-21 per state without a stored copy of the orders: totals from the
    customer key alone, lines from the join below a limit per group."""
    return R.context_blocks(orders_by_state(spark, sf_dir), ["state"], F.col("state"), ["o_orderkey"],
                            R.WEB_ROWS, ORDER_COLS, totals=orders_per_state(spark, sf_dir))


def context_null_group(spark, sf_dir):
    """A-21 where the orders of unknown customers form the null group."""
    orders = with_unknown_customers(read_table(spark, sf_dir, "orders"))
    return R.context_blocks(stored_orders_by_state(spark, sf_dir, orders), ["state"], F.col("state"),
                            ["o_orderkey"], R.WEB_ROWS, ORDER_COLS)


def _blocks(spark, sf_dir) -> DataFrame:
    specs = [("region", ["r_regionkey"]), ("nation", ["n_nationkey"]), ("orders", ["o_orderkey"])]
    out = None
    for i, (t, key) in enumerate(specs):
        b = R.table_block(read_table(spark, sf_dir, t), t, key, R.CLI_ROWS).withColumn(
            "table_order", F.lit(i))
        out = b if out is None else out.unionByName(b)
    return out


def context_table(spark, sf_dir):
    return _blocks(spark, sf_dir).drop("table_order")


def context_dataset(spark, sf_dir):
    return R.dataset_context(_blocks(spark, sf_dir))


def prompts(spark, sf_dir) -> DataFrame:
    ctx = context_per_group(spark, sf_dir)
    user = R.fill_template(USER_TEMPLATE, F.col("context"))
    return ctx.select("state", user.alias("user_prompt"),
                      R.full_prompt(SYSTEM_TEXT, user).alias("prompt"))


def prompt_fill(spark, sf_dir):
    return prompts(spark, sf_dir).select("state", "user_prompt")


def prompt_full(spark, sf_dir):
    return prompts(spark, sf_dir).select("state", "prompt")


def number_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", thousands_text(F.col("n_chars")).alias("n_chars_text"),
                       bytes_text(F.octet_length("text")).alias("size_text"))


def candidate_list(spark, sf_dir):
    """A-26 per customer: the primary candidate is the (padded) market
    segment; the fallback text lists the customer name, a blank entry, the
    segment again and the nation code, with spaces and tabs around them."""
    customer = read_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    fallbacks = F.concat(F.lit(" "), F.col("c_name"), F.lit(" , ,"), seg, F.lit(",\tN"),
                         F.col("c_nationkey").cast("string"), F.lit("\t, "), seg, F.lit(" ,"))
    return customer.select(
        "c_custkey",
        G.candidate_list(F.concat(F.lit(" "), seg, F.lit("\t")), fallbacks).alias("candidates"))


class NotFound(Exception):
    """Stand-in for a client's "model not found" error."""


def _clients() -> dict:
    def retired(prompt):
        raise NotFound("404 model retired-model is not found")

    def digest(prompt):
        return hashlib.md5(prompt.encode("utf-8")).hexdigest()

    return {"retired-model": retired, "digest-model": digest}


def generate_fallback(spark, sf_dir):
    out = G.generate(prompts(spark, sf_dir), "prompt", ["state"], list(PRIMARY_FALLBACKS), _clients)
    return out.select("state", "text", "candidate", "tried", "attempts", "error_kind")


def _failing_clients() -> dict:
    def broken(prompt):
        raise ValueError("bad request")

    return {"digest-model": broken}


def generate_store(spark, sf_dir):
    """A-27 resumable, every prompt twice in the batch: a run whose client
    fails, one that works, and one whose client fails again.  The failures of
    the first stay pending, the results of the second are final, and each
    prompt is generated once a run."""
    store = staging_path(spark, "generated")
    path = staging_path(spark, "asked")
    ask = prompts(spark, sf_dir).select("state", "prompt", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    ask.write.parquet(path)
    ask = spark.read.schema(ask.schema).parquet(path)
    for clients in (_failing_clients, _clients, _failing_clients):
        out = G.generate_into(ask, "prompt", ["state", "copy"], list(PRIMARY_FALLBACKS), clients, store)
    stored = spark.read.parquet(store).groupBy("prompt_key").agg(F.count(F.lit(1)).alias("stored"))
    return out.join(stored, "prompt_key").select(
        "state", "copy", "prompt_key", "text", "candidate", "attempts", "error_kind", "stored")


def generate_failures(spark, sf_dir):
    """A-27, A-30: a client that always fails for a passing reason; attempts
    and waits of the failing path are reported (deadline by elapsed time)."""
    def factory():
        def busy(prompt):
            raise G.TransientError("503 try again")
        return {"digest-model": busy}

    out = G.generate(prompts(spark, sf_dir), "prompt", ["state"], list(PRIMARY_FALLBACKS), factory,
                     G.RetryPolicy(initial=0.001, multiplier=1.0, maximum=0.001, deadline=0.0015),
                     partitions=4)
    return out.select("state", "text", "candidate", "error_kind", "error",
                      (F.col("attempts") >= 2).alias("retried"))


def _flaky_clients() -> dict:
    """Fails with a transient error (len(state line) % 4) times per prompt."""
    seen: dict[str, int] = {}

    def flaky(prompt):
        state = prompt.split("### Tabela: ", 1)[1].split("\n", 1)[0]
        n = seen.get(prompt, 0)
        if n < len(state) % 4:
            seen[prompt] = n + 1
            raise G.TransientError("503 try again")
        return hashlib.md5(prompt.encode("utf-8")).hexdigest()

    return {"flaky-model": flaky}


def _no_sleep(seconds: float) -> None:
    return None


def generate_retry(spark, sf_dir):
    out = G.generate(prompts(spark, sf_dir), "prompt", ["state"], ["flaky-model"], _flaky_clients,
                     G.RetryPolicy(), sleep=_no_sleep)
    return out.select("state", "text", "attempts", "waited_seconds")


def _errors(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    t = F.col("event_type")
    etype = (F.when(t == "error", F.lit("SSLError")).when(t == "click", F.lit("ReadTimeout"))
             .when(t == "view", F.lit("OSError")).when(t == "signup", F.lit("NotFound"))
             .otherwise(F.lit("ServiceUnavailable")))
    base = (F.when(t == "error", F.lit("[SSL: CERTIFICATE_VERIFY_FAILED] certificate verify failed"))
            .when(t == "click", F.lit("Read timed out."))
            .when(t == "view", F.lit("[WinError 10013] access forbidden"))
            .when(t == "signup", F.lit("404 models/m is not found for API version v1beta"))
            .otherwise(F.lit("503 The service is currently unavailable")))
    msg = F.when(F.col("event_id") % 4 == 0, F.concat(base, F.lit(" (timeout=120)"))).otherwise(base)
    return e.select("event_id", etype.alias("error_type"), msg.alias("message"))


def unavailable_errors(spark, sf_dir):
    e = _errors(spark, sf_dir)
    return e.withColumn("unavailable", ERR.unavailable(F.col("error_type"), F.col("message")))


def error_kinds(spark, sf_dir):
    e = _errors(spark, sf_dir)
    typ, msg = F.col("error_type"), F.col("message")
    return (e.select(ERR.client_kind(typ, msg).alias("client_kind"),
                     ERR.public_kind(typ, msg).alias("public_kind"),
                     ERR.status_code(typ, msg).alias("status"),
                     ERR.browser_kind(msg).alias("browser_kind"))
            .groupBy("client_kind", "public_kind", "status", "browser_kind")
            .agg(F.count(F.lit(1)).alias("errors")))


def write_text(spark, sf_dir):
    path = staging_path(spark, "markdown")
    K.write_markdown(context_per_group(spark, sf_dir), "context", path, key_col="state")
    return K.read_markdown(spark, path, "context", "state").select("state", "context")


def write_text_keys(spark, sf_dir):
    """A-31 with keys that look like numbers: two-digit nation codes stay text."""
    path = staging_path(spark, "markdown-keys")
    nation = read_table(spark, sf_dir, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_name").alias("text"))
    K.write_markdown(nation, "text", path, key_col="code")
    return K.read_markdown(spark, path, "text", "code").select("code", "text")


def write_envelope(spark, sf_dir):
    path = staging_path(spark, "envelope")
    analysis = read_table(spark, sf_dir, "region").agg(
        F.expr("listagg(r_name, ', ') WITHIN GROUP (ORDER BY r_regionkey)").alias("analysis"))
    K.write_json(K.envelope(analysis, profile(spark, sf_dir)), path)
    back = spark.read.json(path)
    return back.select("analysis", "table_count", F.explode("tables").alias("t")).select(
        "analysis", "table_count", F.col("t.table_name").alias("table_name"),
        F.col("t.rows").alias("rows"), F.size("t.columns").cast("bigint").alias("n_columns"),
        F.col("t.truncated_for_prompt").alias("truncated_for_prompt"))


def error_responses(spark, sf_dir):
    """A-29: status and text for the caller, by the stage that failed."""
    e = _errors(spark, sf_dir).withColumn("stage", F.element_at(
        F.array(F.lit("upload"), F.lit("generation"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")))
    r = ERR.response(F.col("stage"), F.col("error_type"), F.col("message"))
    return e.select("stage", r.alias("r")).groupBy("stage", "r.status", "r.detail").agg(
        F.count(F.lit(1)).alias("errors"))


def write_error_envelope(spark, sf_dir):
    """A-32, error form: a generation fails; the caller gets the public text
    of its error with the profile of the tables that were loaded, written as
    JSON and read back.  (A rejected upload is a plain 400, see
    ``error_responses``.)"""
    failed = _errors(spark, sf_dir).where("error_type = 'ReadTimeout'").orderBy("event_id").limit(1)
    message = failed.select(ERR.public_text(F.col("error_type"), F.col("message")).alias("m")).first().m
    path = staging_path(spark, "error-envelope")
    K.write_json(K.error_envelope(F.lit(message), profile(spark, sf_dir)), path)
    back = spark.read.json(path)
    return back.select("message", "table_count", F.explode("tables").alias("t")).select(
        "message", "table_count", F.col("t.table_name").alias("table_name"),
        F.col("t.rows").alias("rows"), F.size("t.columns").cast("bigint").alias("n_columns"),
        F.col("t.truncated_for_prompt").alias("truncated_for_prompt"))


QUERIES = {
    "table_profile": table_profile,
    "dataset_totals": dataset_totals,
    "column_stats": column_stats,
    "column_preview": column_preview,
    "first_n_per_group": first_n_per_group,
    "sample_note": sample_note,
    "context_table": context_table,
    "context_per_group": context_per_group,
    "context_per_state": context_per_state,
    "context_null_group": context_null_group,
    "context_dataset": context_dataset,
    "prompt_fill": prompt_fill,
    "prompt_full": prompt_full,
    "number_text": number_text,
    "candidate_list": candidate_list,
    "generate_fallback": generate_fallback,
    "generate_retry": generate_retry,
    "generate_store": generate_store,
    "generate_failures": generate_failures,
    "unavailable_errors": unavailable_errors,
    "error_kinds": error_kinds,
    "error_responses": error_responses,
    "write_text": write_text,
    "write_text_keys": write_text_keys,
    "write_envelope": write_envelope,
    "write_error_envelope": write_error_envelope,
}

# ---- oracle SQL -------------------------------------------------------------

NL = "chr(10)"


def _profile_sql() -> str:
    parts = []
    for t, cols in PROFILED.items():
        arr = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
        parts.append(f"SELECT '{t}' AS table_name, '{t}.parquet' AS source_file, count(*) AS rows, "
                     f"{arr} AS columns, count(*) > {R.CLI_ROWS} AS truncated_for_prompt FROM {t}")
    return "\nUNION ALL ".join(parts)


def _line(cols: list[str]) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in cols)
    return f"concat_ws(' | ', {cells}) || {NL}"


def _head(name_sql: str, cols: list[str]) -> str:
    names = " | ".join(cols)
    rule = " | ".join(["---"] * len(cols))
    return f"{NL} || '### Tabela: ' || {name_sql} || {NL} || '{names}' || {NL} || '{rule}' || {NL}"


def _note(total: str, n: int) -> str:
    return (f"CASE WHEN {total} > {n} THEN {NL} || 'Observação: tabela com ' || CAST({total} AS VARCHAR)"
            f" || ' linhas; amostra limitada às primeiras {n}.' || {NL} ELSE '' END")


OBS = """
obs AS (SELECT n.n_name AS state, o.* FROM orders o
        LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

CTX_GROUP = f"""{OBS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY o_orderkey) AS pos,
                  count(*) OVER (PARTITION BY state) AS total FROM obs),
lines AS (SELECT state, total, string_agg({_line(ORDER_COLS)}, '' ORDER BY pos) AS rows_text
          FROM ranked WHERE pos <= {R.WEB_ROWS} GROUP BY state, total),
ctx AS (SELECT state, {_head("coalesce(state, 'None')", ORDER_COLS)} || {_note('total', R.WEB_ROWS)} || rows_text
               AS context, total AS rows FROM lines)"""


def _table_block_sql(t: str, key: str, order: int) -> str:
    cols = PROFILED[t]
    return f"""SELECT '{t}' AS table_name, {order} AS table_order,
  {_head(f"'{t}'", cols)} || {_note('(SELECT count(*) FROM ' + t + ')', R.CLI_ROWS)} ||
  (SELECT string_agg(line, '' ORDER BY k) FROM (
     SELECT {_line(cols)} AS line, {key} AS k FROM {t} ORDER BY {key} LIMIT {R.CLI_ROWS})) AS context,
  (SELECT count(*) FROM {t}) AS rows"""


BLOCKS = f"""blocks AS (
{_table_block_sql('region', 'r_regionkey', 0)}
UNION ALL {_table_block_sql('nation', 'n_nationkey', 1)}
UNION ALL {_table_block_sql('orders', 'o_orderkey', 2)})"""

PROMPTS = f"""{CTX_GROUP},
pr AS (SELECT state, replace('{USER_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{context}}', context)
              AS user_prompt FROM ctx),
pf AS (SELECT state, user_prompt,
              '{SYSTEM_TEXT}' || {NL} || {NL} || '---' || {NL} || {NL} || user_prompt AS prompt FROM pr)"""

ERRORS = """
errs AS (
  SELECT event_id,
         CASE event_type WHEN 'error' THEN 'SSLError' WHEN 'click' THEN 'ReadTimeout'
              WHEN 'view' THEN 'OSError' WHEN 'signup' THEN 'NotFound'
              ELSE 'ServiceUnavailable' END AS error_type,
         CASE event_type
              WHEN 'error' THEN '[SSL: CERTIFICATE_VERIFY_FAILED] certificate verify failed'
              WHEN 'click' THEN 'Read timed out.'
              WHEN 'view' THEN '[WinError 10013] access forbidden'
              WHEN 'signup' THEN '404 models/m is not found for API version v1beta'
              ELSE '503 The service is currently unavailable' END
         || CASE WHEN event_id % 4 = 0 THEN ' (timeout=120)' ELSE '' END AS message
  FROM events),
ed AS (SELECT *, lower(error_type || ': ' || message) AS detail, lower(message) AS lm FROM errs),
ck AS (SELECT *, CASE WHEN detail LIKE '%read timed out%' OR detail LIKE '%timeout%' THEN 'timeout'
                      WHEN detail LIKE '%certificate_verify_failed%' OR detail LIKE '%self signed certificate%'
                        THEN 'certificate'
                      WHEN detail LIKE '%10013%' OR detail LIKE '%permission denied%' THEN 'blocked'
                      ELSE 'other' END AS client_kind FROM ed)"""

SQL: dict[str, str] = {}

SQL["table_profile"] = _profile_sql()

SQL["column_stats"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null, "
    f"count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM customer"
    for c in PROFILED["customer"])

SQL["dataset_totals"] = f"""WITH p AS ({_profile_sql()})
SELECT count(*) AS table_count, CAST(sum(rows) AS BIGINT) AS total_rows FROM p"""

SQL["column_preview"] = f"""WITH p AS ({_profile_sql()})
SELECT table_name, columns[1:8] AS preview,
       CASE WHEN len(columns) > 8 THEN '+' || CAST(len(columns) - 8 AS VARCHAR) END AS more,
       CAST(len(columns) AS BIGINT) AS n_columns
FROM p"""

SQL["first_n_per_group"] = f"""WITH {OBS},
r AS (SELECT state, o_orderkey, row_number() OVER (PARTITION BY state ORDER BY o_orderkey) AS pos FROM obs)
SELECT * FROM r WHERE pos <= {R.WEB_ROWS}"""

SQL["sample_note"] = f"""WITH {OBS}, t AS (SELECT state, count(*) AS rows FROM obs GROUP BY state)
SELECT state, rows,
       CASE WHEN rows > {R.WEB_ROWS} THEN {NL} || 'Observação: tabela com ' || CAST(rows AS VARCHAR)
            || ' linhas; amostra limitada às primeiras {R.WEB_ROWS}.' || {NL} END AS note
FROM t"""

SQL["context_per_group"] = f"WITH {CTX_GROUP} SELECT * FROM ctx"

SQL["context_per_state"] = SQL["context_per_group"]

SQL["context_null_group"] = SQL["context_per_group"].replace("FROM orders o", f"FROM {UNKNOWN_CUSTOMERS} o")

SQL["write_text_keys"] = "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, n_name AS text FROM nation"

SQL["context_table"] = f"WITH {BLOCKS} SELECT table_name, context, rows FROM blocks"

SQL["context_dataset"] = f"WITH {BLOCKS} SELECT string_agg(context, '' ORDER BY table_order) AS context FROM blocks"

SQL["prompt_fill"] = f"WITH {PROMPTS} SELECT state, user_prompt FROM pf"

SQL["prompt_full"] = f"WITH {PROMPTS} SELECT state, prompt FROM pf"

SQL["number_text"] = """
WITH d AS (SELECT doc_id, n_chars, strlen(text) AS b FROM documents),
t AS (SELECT *, (b * 10 + 512) // 1024 AS kb, (b * 10 + 524288) // 1048576 AS mb FROM d)
SELECT doc_id, replace(format('{:,}', n_chars), ',', '.') AS n_chars_text,
       CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B'
            WHEN b < 1048576 THEN CAST(kb // 10 AS VARCHAR) || '.' || CAST(kb % 10 AS VARCHAR) || ' KB'
            ELSE CAST(mb // 10 AS VARCHAR) || '.' || CAST(mb % 10 AS VARCHAR) || ' MB' END AS size_text
FROM t"""

SQL["candidate_list"] = r"""
WITH c AS (
  SELECT c_custkey,
         list_concat([regexp_replace(' ' || c_mktsegment || chr(9), '^\s+|\s+$', '', 'g')],
                     list_filter(list_transform(
                         string_split(' ' || c_name || ' , ,' || c_mktsegment || ',' || chr(9) || 'N'
                                      || CAST(c_nationkey AS VARCHAR) || chr(9) || ', '
                                      || c_mktsegment || ' ,', ','),
                         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
                       lambda x: x <> '')) AS l
  FROM customer)
SELECT c_custkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS candidates FROM c"""

SQL["generate_fallback"] = f"""WITH {PROMPTS}
SELECT state, md5(prompt) AS text, 'digest-model' AS candidate,
       ['retired-model', 'digest-model'] AS tried, 2 AS attempts, CAST(NULL AS VARCHAR) AS error_kind
FROM pf"""

SQL["generate_store"] = f"""WITH {PROMPTS}
SELECT state, copy, sha256(prompt) AS prompt_key, md5(prompt) AS text, 'digest-model' AS candidate,
       2 AS attempts, CAST(NULL AS VARCHAR) AS error_kind, 2 AS stored
FROM pf, (SELECT unnest([1, 2]) AS copy)"""

SQL["generate_failures"] = f"""WITH {PROMPTS}
SELECT state, CAST(NULL AS VARCHAR) AS text, 'digest-model' AS candidate, 'transient' AS error_kind,
       'TransientError: 503 try again' AS error, true AS retried
FROM pf"""

SQL["generate_retry"] = f"""WITH {PROMPTS}
SELECT state, md5(prompt) AS text, length(state) % 4 + 1 AS attempts,
       CAST(CASE length(state) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 7 END AS DOUBLE)
         AS waited_seconds
FROM pf"""

SQL["unavailable_errors"] = f"""WITH {ERRORS}
SELECT event_id, error_type, message,
       lower(error_type) LIKE '%notfound%' OR lm LIKE '%404%' OR lm LIKE '%is no longer available%'
       OR lm LIKE '%is not found%' OR lm LIKE '%not supported for generatecontent%' AS unavailable
FROM ck"""

KINDS = """
k0 AS (SELECT *,
              CASE WHEN client_kind = 'certificate' OR detail LIKE '%certificate_verify_failed%'
                        OR detail LIKE '%certificado ssl%' THEN 'certificate'
                   WHEN client_kind = 'timeout' OR detail LIKE '%tempo limite excedido%'
                        OR detail LIKE '%read timed out%' OR detail LIKE '%timeout%' THEN 'timeout'
                   WHEN detail LIKE '%10013%' OR detail LIKE '%permission denied%' THEN 'blocked'
                   ELSE 'other' END AS public_kind,
              CASE WHEN client_kind = 'timeout' OR detail LIKE '%tempo limite excedido%'
                        OR detail LIKE '%read timed out%' OR detail LIKE '%timeout%' THEN 504 ELSE 502 END
                AS status,
              CASE WHEN lm LIKE '%certificado%' OR lm LIKE '%certificate_verify_failed%' THEN 'certificate'
                   WHEN lm LIKE '%tempo limite%' OR lm LIKE '%read timed out%' OR lm LIKE '%timeout%'
                     THEN 'timeout'
                   WHEN lm LIKE '%10013%' OR lm LIKE '%permission denied%' THEN 'blocked'
                   ELSE 'other' END AS browser_kind
       FROM ck)"""

SQL["error_kinds"] = f"""WITH {ERRORS}, {KINDS}
SELECT client_kind, public_kind, status, browser_kind, count(*) AS errors FROM k0
GROUP BY ALL"""

SQL["write_text"] = f"WITH {CTX_GROUP} SELECT state, context FROM ctx"

SQL["write_envelope"] = f"""WITH p AS ({_profile_sql()})
SELECT (SELECT string_agg(r_name, ', ' ORDER BY r_regionkey) FROM region) AS analysis,
       (SELECT count(*) FROM p) AS table_count, table_name, rows,
       CAST(len(columns) AS BIGINT) AS n_columns, truncated_for_prompt
FROM p"""

def _public_sql(kind: str, message: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in ERR.PUBLIC_TEXT.items())
    return f"CASE {kind} {whens} ELSE {message} END"


SQL["error_responses"] = f"""WITH {ERRORS}, {KINDS},
s AS (SELECT *, ['upload', 'generation', 'other'][event_id % 3 + 1] AS stage FROM k0)
SELECT stage,
       CASE stage WHEN 'upload' THEN 400 WHEN 'generation' THEN status ELSE 500 END AS status,
       CASE stage WHEN 'upload' THEN message WHEN 'generation' THEN {_public_sql('public_kind', 'message')}
            ELSE 'Erro inesperado ao processar os arquivos: ' || message END AS detail,
       count(*) AS errors
FROM s GROUP BY ALL"""

SQL["write_error_envelope"] = f"""WITH {ERRORS}, {KINDS}, p AS ({_profile_sql()})
SELECT (SELECT {_public_sql('public_kind', 'message')} FROM k0 WHERE error_type = 'ReadTimeout'
        ORDER BY event_id LIMIT 1) AS message,
       (SELECT count(*) FROM p) AS table_count, table_name, rows,
       CAST(len(columns) AS BIGINT) AS n_columns, truncated_for_prompt
FROM p"""
