"""Markdown parsing (A-33), report checks (D-01..D-04) and the report built
from findings (C-10), bound to the driver tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import findings as C
from tessera.operators import measures as B
from tessera.operators import report as RP
from tessera.plans import driver as P
from tessera.plans import oracle as O
from tessera.sources.tables import read_table

REPORT_STATES = 5
REPORT_RISKS = 4


def _docs(spark, sf_dir, partitions: int | None = None) -> DataFrame:
    """Documents; ``partitions`` spreads a table of one row group over so many
    tasks (a table of many row groups starts wide by itself)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.repartition(partitions) if partitions else docs


def markdown_blocks(spark, sf_dir, partitions: int | None = None):
    return RP.markdown_blocks(_docs(spark, sf_dir, partitions), "doc_id", "text")


def section_check(spark, sf_dir):
    return RP.section_check(_docs(spark, sf_dir), "doc_id", "text")


def misplaced_sections(spark, sf_dir):
    """D-01 on one text per order: its sections in an order that follows from
    the order's key, some left out, some twice."""
    k = F.col("o_orderkey")
    sections = []
    for j, name in enumerate(RP.CLI_SECTIONS):
        part = F.struct(((k * (2 * j + 3) + 5 * j) % 11).alias("key"), F.lit(j).alias("j"), F.lit(name).alias("name"))
        sections += [F.when((k + j) % 9 != 0, part),
                     F.when((k + 3 * j) % 31 == 0, F.struct(F.lit(20).cast("bigint").alias("key"), part["j"].alias("j"),
                                                            part["name"].alias("name")))]
    ordered = F.array_sort(F.filter(F.array(*sections), lambda s: s.isNotNull()))
    text = F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n\nText.\n"))), "\n")
    docs = read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return RP.misplaced_sections(docs, "o_orderkey", "text")


def completeness_check(spark, sf_dir):
    return RP.completeness_check(_docs(spark, sf_dir), "doc_id", "text")


def _part_keys(spark, sf_dir) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    values = part.select(F.col("p_retailprice").alias("v")).unionByName(
        part.select(F.col("p_size").cast("double").alias("v")))
    return RP.grounding_keys(values, "v")


def number_grounding(spark, sf_dir):
    return RP.number_grounding(_docs(spark, sf_dir), "doc_id", "text", _part_keys(spark, sf_dir))


def grounding_derived(spark, sf_dir):
    """D-03 on texts about groups: per state the share of it and the next two
    (one decimal, truncated) and its ratio to the next one; the same share said
    of another list of groups must not be grounded."""
    money = (P.facts_with_state(spark, sf_dir).where("state IS NOT NULL").groupBy("state")
             .agg(F.sum("order_units").cast("decimal(30,0)").alias("units")))
    by_name = Window.partitionBy().orderBy("state")  # one row per state
    all_ = F.sum("units").over(Window.partitionBy())
    near = money.select("state", "units", all_.alias("total"), *[
        c for i in (1, 2, 3) for c in (F.lead("state", i).over(by_name).alias(f"s{i}"),
                                       F.lead("units", i).over(by_name).alias(f"u{i}"))]).where("s3 IS NOT NULL")
    tenths = F.expr("(units + u1 + u2) * 1000 div total")
    hundredths = F.expr("units * 100 div u1")
    share = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"))
    times = F.concat(F.floor(hundredths / 100).cast("string"), F.lit(","), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    docs = near.select("state", F.concat(
        F.col("state"), F.lit(", "), F.col("s1"), F.lit(" and "), F.col("s2"), F.lit(" hold "), share,
        F.lit("% of it. "), F.col("state"), F.lit(" has "), times, F.lit(" times "), F.col("s1"),
        F.lit(".\n"), F.col("state"), F.lit(" and "), F.col("s3"), F.lit(" hold "), share, F.lit("%.")).alias("text"))
    return RP.derived_grounding(docs, "state", "text", money, "state", "units")


def grounding_scaled(spark, sf_dir):
    """D-03 on texts that scale and cut their numbers: per state "R$ x,xx mi"
    (truncated) and the late rate with one decimal (truncated), and a made-up
    amount that must not be grounded."""
    facts = P.stored_facts(spark, sf_dir)
    sp = B.state_performance(facts).where("state IS NOT NULL")
    cents = F.floor(F.col("revenue") / 10000).cast("bigint")
    tenth = F.floor(F.col("late_rate").cast("decimal(38,6)") * 1000).cast("bigint")

    def text(n, base):
        return F.concat(F.floor(n / base).cast("bigint").cast("string"), F.lit(","),
                        F.lpad((n % base).cast("string"), len(str(base)) - 1, "0"))

    docs = sp.select("state", F.concat(F.lit("R$ "), text(cents, 100), F.lit(" mi, atraso de "), text(tenth, 10),
                                       F.lit("%; meta de 987654321,5 mil.")).alias("text"))
    return RP.number_grounding(docs, "state", "text", _measure_keys(facts))


def report(spark, sf_dir):
    """C-10: the four required sections; every number is a formatted column."""
    return report_from(P.facts_with_state(spark, sf_dir))


UNKNOWN_STATE = "(sem estado)"


def report_from(facts: DataFrame, unknown: str = UNKNOWN_STATE) -> DataFrame:
    """C-10 over the per-order fact as one linear plan: one GROUPING SETS
    aggregation gives the general row and the state rows; the section ranks
    are windows over those few rows; each row emits the lines of the
    sections it belongs to (``explode``) and the ordered ``listagg`` joins
    them.  Nothing branches, so the facts are computed once, whatever
    columns each section uses.  Orders without a state are a group like any
    other, under the label ``unknown``."""
    rows = C.share_of_total(B.kpi_cut_rows(facts, "state"), "revenue", "revenue_share", ["is_total"])
    risky = F.col("late_rate") > P.RISK_THRESHOLD
    eligible = (F.col("delivered_orders") >= P.MIN_VOLUME) & F.col("late_rate").isNotNull()

    def rank(cond, *order):
        w = Window.partitionBy(*(["is_total"] + ([cond] if cond is not None else []))).orderBy(*order)
        return F.row_number().over(w).cast("bigint")

    rows = rows.select(
        "*",
        rank(None, F.col("revenue").desc(), F.col("state")).alias("by_revenue"),
        rank(risky, F.col("revenue").desc(), F.col("state")).alias("by_risk"),
        rank(eligible, F.col("late_rate").desc(), F.col("state")).alias("by_lateness"))
    state, label = ~F.col("is_total"), F.coalesce("state", F.lit(unknown))

    def line(sec, pos, when, *parts):
        return F.when(when, F.struct(F.lit(sec).alias("sec"), pos.alias("pos"),
                                     F.concat(*parts).alias("line")))

    money, pct = RP.money_text, RP.percent_text
    lines = F.array(
        line(0, F.lit(0).cast("bigint"), F.col("is_total"),
             F.lit("Receita de "), money(F.col("revenue")), F.lit(" em "),
             F.col("orders").cast("string"), F.lit(" pedidos; ticket médio "),
             money(F.col("ticket")), F.lit("; "), pct(F.col("late_rate")),
             F.lit(" das entregas com atraso.")),
        line(1, F.col("by_revenue"), state & (F.col("by_revenue") <= REPORT_STATES),
             F.lit("- **"), label, F.lit("**: "), money(F.col("revenue")), F.lit(" ("),
             pct(F.col("revenue_share")), F.lit(" da receita), atraso de "),
             pct(F.col("late_rate")), F.lit(".")),
        line(2, F.col("by_risk"), state & risky & (F.col("by_risk") <= REPORT_RISKS),
             F.lit("- **"), label, F.lit("**: atraso de "), pct(F.col("late_rate")),
             F.lit(" acima do limite; "), money(F.col("revenue")), F.lit(" em risco.")),
        line(3, F.col("by_lateness"), state & eligible & (F.col("by_lateness") <= P.WORST_K),
             F.lit("- Reduzir o atraso em **"), label, F.lit("** ("),
             pct(F.col("late_rate")), F.lit(") nos "), F.col("delivered_orders").cast("string"),
             F.lit(" pedidos entregues.")),
    )
    body = rows.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("l.*")
    return RP.build_report(body, RP.CLI_SECTIONS)


def report_unknown_state(spark, sf_dir):
    """C-10 with orders of unknown customers: their group is in the report."""
    orders = P.with_unknown_customers(read_table(spark, sf_dir, "orders"))
    facts = B.with_state(B.order_facts(orders, read_table(spark, sf_dir, "lineitem")),
                         read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation"))
    return report_from(facts)


INDICATORS = 4
WEB_FINDINGS, WEB_RISKS, NEXT_STEPS = 4, 3, 3


def report_web(spark, sf_dir):
    """C-10 in the web form: five sections of bounded lists, each number a column."""
    return report_web_from(P.facts_with_state(spark, sf_dir))


def report_web_from(facts: DataFrame, unknown: str = UNKNOWN_STATE) -> DataFrame:
    """The web form over the per-order fact, as one linear plan like
    ``report_from``: summary and indicators from the general row, findings by
    revenue, risks by late rate, and the next steps for the worst groups."""
    rows = C.share_of_total(B.kpi_cut_rows(facts, "state"), "revenue", "revenue_share", ["is_total"])
    rated = F.col("late_rate").isNotNull()
    state, label = ~F.col("is_total"), F.coalesce("state", F.lit(unknown))

    def rank(cond, *order):
        w = Window.partitionBy(*(["is_total"] + ([cond] if cond is not None else []))).orderBy(*order)
        return F.row_number().over(w).cast("bigint")

    rows = rows.select("*", rank(None, F.col("revenue").desc(), F.col("state")).alias("by_revenue"),
                       rank(rated, F.col("late_rate").desc(), F.col("state")).alias("by_lateness"),
                       F.count("*").over(Window.partitionBy("is_total")).alias("groups"))
    money, pct, total = RP.money_text, RP.percent_text, F.col("is_total")

    def line(sec, pos, when, *parts):
        pos = F.lit(pos).cast("bigint") if isinstance(pos, int) else pos
        return F.when(when, F.struct(F.lit(sec).alias("sec"), pos.alias("pos"), F.concat(*parts).alias("line")))

    lines = F.array(
        line(0, 0, total, F.lit("A receita foi de "), money(F.col("revenue")), F.lit(" em "),
             F.col("orders").cast("string"), F.lit(" pedidos. O ticket médio foi de "), money(F.col("ticket")),
             F.lit(". O atraso atingiu "), pct(F.col("late_rate")), F.lit(" das entregas.")),
        line(1, 0, total, F.lit("- **Receita**: "), money(F.col("revenue")), F.lit(" entregues.")),
        line(1, 1, total, F.lit("- **Pedidos**: "), F.col("orders").cast("string"), F.lit(" no período.")),
        line(1, 2, total, F.lit("- **Ticket médio**: "), money(F.col("ticket")), F.lit(" por pedido entregue.")),
        line(1, 3, total, F.lit("- **Atraso**: "), pct(F.col("late_rate")), F.lit(" das entregas.")),
        line(2, F.col("by_revenue"), state & (F.col("by_revenue") <= WEB_FINDINGS),
             F.lit("- **"), label, F.lit("**: "), money(F.col("revenue")), F.lit(", "),
             pct(F.col("revenue_share")), F.lit(" da receita, com atraso de "), pct(F.col("late_rate")), F.lit(".")),
        line(3, F.col("by_lateness"), state & rated & (F.col("by_lateness") <= WEB_RISKS),
             F.lit("- **"), label, F.lit("**: atraso de "), pct(F.col("late_rate")), F.lit("; "),
             money(F.col("revenue")), F.lit(" em risco.")),
        line(4, F.col("by_lateness"), state & rated & (F.col("by_lateness") <= NEXT_STEPS),
             F.lit("- Reduzir o atraso em **"), label, F.lit("**: dono logística, métrica atraso abaixo de "),
             pct(F.col("late_rate")), F.lit(", horizonte de um trimestre.")),
    )
    body = rows.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("l.*")
    return RP.build_report(body, RP.WEB_SECTIONS)


def report_web_checks(spark, sf_dir):
    """D-01 and D-02 on the web form: its sections, its words, and the items
    of every section against their range, one row per section."""
    doc = report_web(spark, sf_dir).select(F.lit(1).cast("bigint").alias("doc_id"), F.col("report").alias("text"))
    items = RP.item_ranges(doc, "doc_id", "text", RP.WEB_ITEM_RANGES)
    found = RP.section_check(doc, "doc_id", "text", RP.WEB_SECTIONS).select("doc_id", "exact")
    words = RP.completeness_check(doc, "doc_id", "text").select("doc_id", "words", "within_word_range",
                                                                "ends_sentence")
    return items.join(found, "doc_id").join(words, "doc_id")


def _report_doc(facts: DataFrame) -> DataFrame:
    return report_from(facts).select(F.lit(1).cast("bigint").alias("doc_id"),
                                     F.col("report").alias("text"))


def report_sections(spark, sf_dir):
    return RP.section_check(_report_doc(P.facts_with_state(spark, sf_dir)), "doc_id", "text")


def report_items(spark, sf_dir):
    doc = _report_doc(P.facts_with_state(spark, sf_dir))
    return RP.section_items(RP.markdown_blocks(doc, "doc_id", "text"), "doc_id")


def item_ranges(spark, sf_dir):
    """D-02 on every document: items per required section against its range."""
    return RP.item_ranges(_docs(spark, sf_dir), "doc_id", "text")


def report_item_ranges(spark, sf_dir):
    """D-02 on the generated report."""
    return RP.item_ranges(_report_doc(P.facts_with_state(spark, sf_dir)), "doc_id", "text")


def _measure_keys(facts: DataFrame) -> DataFrame:
    """Accepted numbers for the report: measure values as they are, and
    rates and shares also as percentages (one pass over the cut rows)."""
    rows = C.share_of_total(B.kpi_cut_rows(facts, "state"), "revenue", "revenue_share", ["is_total"])
    total = F.col("is_total")

    def dec(c):
        return c.cast("decimal(38,6)")

    def pct(c):
        return dec(F.col(c)) * 100

    values = F.array(
        dec(F.col("revenue")),
        dec(F.when(total, F.col("ticket"))),
        dec(F.when(total, F.col("orders").cast("double"))),
        dec(F.when(~total, F.col("delivered_orders").cast("double"))),
        dec(pct("late_rate")),
        dec(F.when(~total, pct("revenue_share"))))
    return RP.grounding_keys(rows.select(F.explode(values).alias("v")), "v")


def report_grounding(spark, sf_dir, facts: DataFrame | None = None):
    """D-03 on the generated report: every number must come from a measure.
    The report and its accepted numbers are two reads of one stored fact,
    ``facts`` if the caller has it already."""
    facts = P.stored_facts(spark, sf_dir) if facts is None else facts
    return RP.number_grounding(_report_doc(facts), "doc_id", "text", _measure_keys(facts))


def data_limits(spark, sf_dir, facts: DataFrame | None = None):
    """D-04: cut totals that disagree with the general KPI, constant columns
    and blank keys, as one long table (check, subject, value, flag).

    Each cut table is aggregated once, all its checks in one row, and that
    row is unpivoted with ``stack``; the order cuts are aggregates of the
    stored per-order fact, so the line items are read once for them and
    once for the category cut."""
    def total(col):
        return F.sum(F.col(col).cast("decimal(38,4)")).cast("double")

    def nulls(key):
        return F.count(F.when(F.col(key).isNull(), 1)).cast("double")

    def checks(df, measures):
        """measures: (check, subject, aggregate) triples, one output row each."""
        row = df.agg(*[m.alias(f"m{i}") for i, (_, _, m) in enumerate(measures)])
        args = ", ".join(f"'{c}', '{subj}', m{i}" for i, (c, subj, _) in enumerate(measures))
        return row.select(F.expr(f"stack({len(measures)}, {args})").alias("check", "subject", "value"))

    if facts is None:
        facts = P.stored_facts(spark, sf_dir)  # every order cut aggregates the stored fact
    sc = P.sales_by_category(spark, sf_dir)
    parts = [
        checks(B.kpi_general(facts), [("cut_total", "kpi", total("revenue")),
                                      ("order_total", "kpi", total("orders"))]),
        checks(B.state_performance(facts), [("cut_total", "state", total("revenue")),
                                            ("order_total", "state", total("orders")),
                                            ("null_keys", "state_performance", nulls("state"))]),
        checks(B.sales_by_month(facts), [("cut_total", "month", total("revenue")),
                                         ("order_total", "month", total("orders")),
                                         ("null_keys", "sales_by_month", nulls("month"))]),
        checks(sc, [("cut_total", "category", total("revenue"))]
               + [("distinct_values", f"sales_by_category.{c}", F.count_distinct(c).cast("double"))
                  for c in ("orders", "delivered_orders", "revenue", "ticket")]
               + [("null_keys", "sales_by_category", nulls("category"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    reference = F.max(F.when(F.col("subject") == "kpi", F.col("value"))).over(Window.partitionBy("check"))
    flag = (F.when(F.col("check").isin("cut_total", "order_total"),
                   F.abs(F.col("value") - reference) > 0.005)
            .when(F.col("check") == "distinct_values", F.col("value") <= 1)
            .otherwise(F.col("value") > 0))
    return out.withColumn("flag", flag)


QUERIES = {
    "markdown_blocks": markdown_blocks,
    "section_check": section_check,
    "misplaced_sections": misplaced_sections,
    "grounding_derived": grounding_derived,
    "completeness_check": completeness_check,
    "number_grounding": number_grounding,
    "grounding_scaled": grounding_scaled,
    "report": report,
    "report_unknown_state": report_unknown_state,
    "report_web": report_web,
    "report_web_checks": report_web_checks,
    "report_sections": report_sections,
    "report_items": report_items,
    "item_ranges": item_ranges,
    "report_item_ranges": report_item_ranges,
    "report_grounding": report_grounding,
    "data_limits": data_limits,
}

# ---- oracle SQL -------------------------------------------------------------

SQL_TRIM = r"[ \t\r\f\v\x{a0}\x{feff}]"

BLOCKS = rf"""
lines0 AS (
  SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM src),
lines AS (
  SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS line_no, unnest(parts) AS line
  FROM lines0),
kinds AS (
  SELECT doc_id, line_no, line,
         CASE WHEN starts_with(line, '## ') THEN 'heading'
              WHEN regexp_matches(line, '^{SQL_TRIM}*(---|\*\*\*){SQL_TRIM}*\z') THEN 'rule'
              WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'item'
              WHEN length(regexp_replace(line, '{SQL_TRIM}|\n', '', 'g')) > 0 THEN 'paragraph'
         END AS kind
  FROM lines),
prev AS (
  SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_kind FROM kinds),
lists AS (
  SELECT *, CASE WHEN kind = 'item' THEN prev_kind IS NULL OR prev_kind <> 'item' END AS list_start
  FROM prev),
content AS (
  SELECT doc_id, line_no, kind,
         CASE WHEN kind = 'heading' THEN substr(line, 4) WHEN kind = 'item' THEN substr(line, 3)
              WHEN kind = 'rule' THEN '' ELSE line END AS content,
         list_start
  FROM lists WHERE kind IS NOT NULL),
blocks AS (
  SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, kind, content,
         CASE WHEN kind IN ('item', 'paragraph')
              THEN regexp_extract_all(content, '\*\*([^\n]*?)\*\*', 1)
              ELSE CAST([] AS VARCHAR[]) END AS bold, list_start
  FROM content)"""

DOCS = "src AS (SELECT doc_id, text FROM documents)"

REQ = "[" + ", ".join(f"'{s}'" for s in RP.CLI_SECTIONS) + "]"

SECTIONS = f"""
found AS (SELECT doc_id, list(content ORDER BY line_no) AS found FROM blocks
          WHERE kind = 'heading' GROUP BY doc_id),
withf AS (SELECT s.doc_id, coalesce(f.found, CAST([] AS VARCHAR[])) AS found
          FROM src s LEFT JOIN found f ON s.doc_id = f.doc_id)
SELECT doc_id, found,
       list_filter({REQ}, lambda x: NOT list_contains(found, x)) AS missing,
       list_filter(found, lambda x: NOT list_contains({REQ}, x)) AS extra,
       list_filter(found, lambda x: list_contains({REQ}, x))
         = list_filter({REQ}, lambda x: list_contains(found, x)) AS in_order,
       found = {REQ} AS exact
FROM withf"""

_SCALE_SQL = "CASE word " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in RP.SCALES.items()) + " ELSE 1 END"
_WORDS = "|".join(sorted(RP.SCALES, key=len, reverse=True))
_NUMBER_SQL = (r"(^|[^\w])(\d+(?:[.,]\d+)*)(?:[ \x{a0}](" + _WORDS + r")(?:[^\p{L}\p{N}_]|$))?")


def _forms(scale: int) -> str:
    x = f"CAST(v / {scale} AS DECIMAL(38,9))" if scale == 1 else (
        f"CAST(round(CAST(v AS DECIMAL(38,6)) / {scale}, 9) AS DECIMAL(38,9))")
    return ", ".join(
        f"{{'scale': CAST({scale} AS BIGINT), 'key': CAST({y} AS DECIMAL(38,6))}}" for p in (0, 1, 2)
        for y in (f"round({x}, {p})", f"CAST(floor({x} * {10 ** p}) AS DECIMAL(38,6)) / {10 ** p}"))


GROUNDING = rf"""
nums0 AS (SELECT doc_id, regexp_extract_all(text, '{_NUMBER_SQL}', 2) AS l,
                 regexp_extract_all(text, '{_NUMBER_SQL}', 3) AS w FROM src),
nums AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS number_text,
                unnest(w) AS word FROM nums0),
normed AS (
  SELECT *, {_SCALE_SQL} AS scale,
         TRY_CAST(CASE WHEN contains(number_text, ',')
                            THEN replace(replace(number_text, '.', ''), ',', '.')
                          WHEN regexp_matches(number_text, '^\d{{1,3}}(\.\d{{3}})+$')
                            THEN replace(number_text, '.', '')
                          ELSE number_text END AS DECIMAL(38,6)) AS value
  FROM nums),
keys AS (
  SELECT DISTINCT k.scale AS scale, k.key AS key FROM (
    SELECT unnest([{{'scale': CAST(1 AS BIGINT), 'key': CAST(v AS DECIMAL(38,6))}},
                   {", ".join(_forms(s) for s in sorted({1, *RP.SCALES.values()}))}]) AS k
    FROM vals) WHERE k.key IS NOT NULL)
SELECT n.doc_id, CAST(n.pos AS BIGINT) AS pos, n.number_text, CAST(n.value AS DOUBLE) AS value,
       CAST(n.scale AS BIGINT) AS scale, k.key IS NOT NULL AS grounded
FROM normed n LEFT JOIN keys k ON n.value = k.key AND n.scale = k.scale"""

PART_VALS = """vals AS (
  SELECT CAST(p_retailprice AS DECIMAL(38,6)) AS v FROM part
  UNION ALL SELECT CAST(CAST(p_size AS DOUBLE) AS DECIMAL(38,6)) FROM part)"""


def _money(x: str) -> str:
    c = f"CAST(round(CAST({x} AS DECIMAL(38,4)), 2) * 100 AS BIGINT)"
    return (f"('R$ ' || CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(abs({c}) // 100 AS VARCHAR)"
            f" || ',' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))")


def _pct(x: str) -> str:
    b = f"CAST(round(CAST({x} AS DECIMAL(38,6)) * 100, 2) * 100 AS BIGINT)"
    return f"(CAST({b} // 100 AS VARCHAR) || ',' || lpad(CAST({b} % 100 AS VARCHAR), 2, '0') || '%')"


NL = "chr(10)"

KPI = f"""
kpi0 AS (SELECT {O.KPI_COLS} FROM facts),
kpi AS (SELECT *, {O.TICKET} FROM kpi0)"""

REPORT = f"""{O.STATE_PERF}, {KPI},
shr AS (SELECT *, round(revenue / {O.EXACT_TOTAL}, 6) AS revenue_share FROM sp),
risk AS (SELECT * FROM sp WHERE late_rate > {P.RISK_THRESHOLD}),
worst AS (SELECT * FROM (
  SELECT state, late_rate, delivered_orders, row_number() OVER (ORDER BY late_rate DESC, state) AS pos
  FROM sp WHERE delivered_orders >= {P.MIN_VOLUME} AND late_rate IS NOT NULL) WHERE pos <= {P.WORST_K}),
rlines AS (
  SELECT 0 AS sec, 0 AS pos,
         'Receita de ' || {_money('revenue')} || ' em ' || CAST(orders AS VARCHAR) || ' pedidos; ticket médio '
         || {_money('ticket')} || '; ' || {_pct('late_rate')} || ' das entregas com atraso.' AS line
  FROM kpi
  UNION ALL
  SELECT 1, pos, '- **' || coalesce(state, '{UNKNOWN_STATE}') || '**: ' || {_money('revenue')} || ' (' || {_pct('revenue_share')}
         || ' da receita), atraso de ' || {_pct('late_rate')} || '.'
  FROM (SELECT *, row_number() OVER (ORDER BY revenue DESC, state) AS pos FROM shr)
  WHERE pos <= {REPORT_STATES}
  UNION ALL
  SELECT 2, pos, '- **' || coalesce(state, '{UNKNOWN_STATE}') || '**: atraso de ' || {_pct('late_rate')} || ' acima do limite; '
         || {_money('revenue')} || ' em risco.'
  FROM (SELECT *, row_number() OVER (ORDER BY revenue DESC, state) AS pos FROM risk)
  WHERE pos <= {REPORT_RISKS}
  UNION ALL
  SELECT 3, pos, '- Reduzir o atraso em **' || coalesce(state, '{UNKNOWN_STATE}') || '** (' || {_pct('late_rate')} || ') nos '
         || CAST(delivered_orders AS VARCHAR) || ' pedidos entregues.'
  FROM worst),
heads AS (
  SELECT * FROM (VALUES {", ".join(
      f"({i}, -1, {'chr(10) || ' if i else ''}'## {h}' || {NL} || {NL})"
      for i, h in enumerate(RP.CLI_SECTIONS))}) AS t(sec, pos, line)),
rep AS (
  SELECT string_agg(line, '' ORDER BY sec, pos) AS report FROM (
    SELECT sec, pos, line || {NL} AS line FROM rlines UNION ALL SELECT * FROM heads))"""

SQL: dict[str, str] = {}

SQL["markdown_blocks"] = f"WITH {DOCS}, {BLOCKS} SELECT * FROM blocks"

SQL["section_check"] = f"WITH {DOCS}, {BLOCKS}, {SECTIONS}"

_NAMES = ", ".join(f"({j}, '{name}')" for j, name in enumerate(RP.CLI_SECTIONS))

# all increasing subsequences are listed; the longest one that starts earliest may stay
SQL["misplaced_sections"] = f"""
WITH RECURSIVE names(j, name) AS (VALUES {_NAMES}),
placed AS (
  SELECT o_orderkey, j, name, (o_orderkey * (2 * j + 3) + 5 * j) % 11 AS key FROM orders, names
  WHERE (o_orderkey + j) % 9 <> 0
  UNION ALL
  SELECT o_orderkey, j, name, 20 AS key FROM orders, names WHERE (o_orderkey + 3 * j) % 31 = 0),
found AS (
  SELECT o_orderkey, j, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY key, j) - 1 AS place FROM placed),
paths AS (
  SELECT o_orderkey, j, place, [place] AS path FROM found
  UNION ALL
  SELECT f.o_orderkey, f.j, f.place, list_append(p.path, f.place) AS path
  FROM paths p JOIN found f ON f.o_orderkey = p.o_orderkey AND f.place > p.place AND f.j > p.j),
stay AS (
  SELECT o_orderkey, path FROM paths
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY len(path) DESC, path) = 1),
moved AS (
  SELECT f.o_orderkey, list(f.name ORDER BY f.place) AS misplaced
  FROM found f JOIN stay s ON f.o_orderkey = s.o_orderkey AND NOT list_contains(s.path, f.place)
  GROUP BY f.o_orderkey)
SELECT o.o_orderkey, coalesce(m.misplaced, CAST([] AS VARCHAR[])) AS misplaced
FROM orders o LEFT JOIN moved m ON o.o_orderkey = m.o_orderkey"""

SQL["grounding_derived"] = f"""WITH {O.FACTS},
money AS (SELECT state, CAST(sum(order_units) AS HUGEINT) AS units FROM fs WHERE state IS NOT NULL GROUP BY state),
near AS (
  SELECT state, units, CAST(sum(units) OVER () AS HUGEINT) AS total,
         lead(units, 1) OVER w AS u1, lead(units, 2) OVER w AS u2, lead(units, 3) OVER w AS u3
  FROM money WINDOW w AS (ORDER BY state)),
said AS (
  SELECT *, ((units + u1 + u2) * 1000) // total AS tenths, (units * 100) // u1 AS hundredths
  FROM near WHERE u3 IS NOT NULL),
texts AS (
  SELECT *, CAST(tenths // 10 AS VARCHAR) || ',' || CAST(tenths % 10 AS VARCHAR) AS share,
         CAST(hundredths // 100 AS VARCHAR) || ',' || lpad(CAST(hundredths % 100 AS VARCHAR), 2, '0') AS times
  FROM said),
wrong AS (  -- in hundredths: what the other two groups hold, cut and rounded to each place
  SELECT state, list_contains([
      ((units + u3) * 10000) // total, ((units + u3) * 20000 + total) // (2 * total),
      (((units + u3) * 1000) // total) * 10, (((units + u3) * 2000 + total) // (2 * total)) * 10,
      (((units + u3) * 100) // total) * 100, (((units + u3) * 200 + total) // (2 * total)) * 100],
      tenths * 10) AS hit
  FROM texts)
SELECT state, CAST(0 AS BIGINT) AS sentence, CAST(0 AS BIGINT) AS pos, share AS number_text, 'share' AS kind,
       CAST(3 AS BIGINT) AS named, true AS grounded FROM texts
UNION ALL SELECT state, 1, 0, times, 'ratio', 2, true FROM texts
UNION ALL SELECT t.state, 2, 0, t.share, 'share', 2, w.hit FROM texts t JOIN wrong w ON t.state = w.state"""

SQL["completeness_check"] = rf"""WITH {DOCS}, {BLOCKS},
counts AS (SELECT doc_id, count(CASE WHEN kind = 'heading' THEN 1 END) AS headings,
                  count(CASE WHEN kind = 'item' THEN 1 END) AS items,
                  count(CASE WHEN kind = 'paragraph' THEN 1 END) AS paragraphs
           FROM blocks GROUP BY doc_id)
SELECT s.doc_id, CAST(len(regexp_extract_all(s.text, '[^ \t\r\n]+')) AS BIGINT) AS words,
       regexp_matches(s.text, '[.!?)][ \t\r\n]*\z') AS ends_sentence,
       coalesce(c.headings, 0) AS headings, coalesce(c.items, 0) AS items,
       coalesce(c.paragraphs, 0) AS paragraphs,
       len(regexp_extract_all(s.text, '[^ \t\r\n]+')) BETWEEN {RP.WEB_WORD_RANGE[0]} AND {RP.WEB_WORD_RANGE[1]}
         AS within_word_range
FROM src s LEFT JOIN counts c ON s.doc_id = c.doc_id"""

SQL["number_grounding"] = f"WITH {DOCS}, {PART_VALS}, {GROUNDING}"

SQL["report"] = f"WITH {REPORT} SELECT report FROM rep"

SQL["report_unknown_state"] = SQL["report"].replace("FROM orders o", f"FROM {O.UNKNOWN_CUSTOMERS} o")

WEB_HEADS = ", ".join(f"({i}, -1, {'chr(10) || ' if i else ''}'## {h}' || {NL} || {NL})"
                      for i, h in enumerate(RP.WEB_SECTIONS))
_LABEL = f"coalesce(state, '{UNKNOWN_STATE}')"

WEB_REPORT = f"""{O.STATE_PERF}, {KPI},
shr AS (SELECT *, round(revenue / {O.EXACT_TOTAL}, 6) AS revenue_share,
               row_number() OVER (ORDER BY revenue DESC, state NULLS FIRST) AS by_revenue FROM sp),
late AS (SELECT *, row_number() OVER (ORDER BY late_rate DESC, state NULLS FIRST) AS by_lateness
         FROM sp WHERE late_rate IS NOT NULL),
wlines AS (
  SELECT 0 AS sec, 0 AS pos, 'A receita foi de ' || {_money('revenue')} || ' em ' || CAST(orders AS VARCHAR)
         || ' pedidos. O ticket médio foi de ' || {_money('ticket')} || '. O atraso atingiu '
         || {_pct('late_rate')} || ' das entregas.' AS line FROM kpi
  UNION ALL SELECT 1, 0, '- **Receita**: ' || {_money('revenue')} || ' entregues.' FROM kpi
  UNION ALL SELECT 1, 1, '- **Pedidos**: ' || CAST(orders AS VARCHAR) || ' no período.' FROM kpi
  UNION ALL SELECT 1, 2, '- **Ticket médio**: ' || {_money('ticket')} || ' por pedido entregue.' FROM kpi
  UNION ALL SELECT 1, 3, '- **Atraso**: ' || {_pct('late_rate')} || ' das entregas.' FROM kpi
  UNION ALL SELECT 2, by_revenue, '- **' || {_LABEL} || '**: ' || {_money('revenue')} || ', '
         || {_pct('revenue_share')} || ' da receita, com atraso de ' || {_pct('late_rate')} || '.'
  FROM shr WHERE by_revenue <= {WEB_FINDINGS}
  UNION ALL SELECT 3, by_lateness, '- **' || {_LABEL} || '**: atraso de ' || {_pct('late_rate')} || '; '
         || {_money('revenue')} || ' em risco.' FROM late WHERE by_lateness <= {WEB_RISKS}
  UNION ALL SELECT 4, by_lateness, '- Reduzir o atraso em **' || {_LABEL}
         || '**: dono logística, métrica atraso abaixo de ' || {_pct('late_rate')}
         || ', horizonte de um trimestre.' FROM late WHERE by_lateness <= {NEXT_STEPS}),
rep AS (
  SELECT string_agg(line, '' ORDER BY sec, pos) AS report FROM (
    SELECT sec, pos, line || {NL} AS line FROM wlines
    UNION ALL SELECT * FROM (VALUES {WEB_HEADS}) AS t(sec, pos, line)))"""

SQL["report_web"] = f"WITH {WEB_REPORT} SELECT report FROM rep"

REPORT_SRC = f"{REPORT}, src AS (SELECT CAST(1 AS BIGINT) AS doc_id, report AS text FROM rep)"

SQL["report_sections"] = f"WITH {REPORT_SRC}, {BLOCKS}, {SECTIONS}"

SQL["report_items"] = f"""WITH {REPORT_SRC}, {BLOCKS},
tagged AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS)
                       OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section
           FROM blocks)
SELECT doc_id, section, count(CASE WHEN kind = 'item' THEN 1 END) AS items
FROM tagged WHERE section IS NOT NULL GROUP BY doc_id, section"""

ITEM_RANGE_VALUES = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in RP.CLI_ITEM_RANGES)

ITEM_RANGES = f"""
tagged AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS)
                       OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section
           FROM blocks),
counts AS (SELECT doc_id, section, count(CASE WHEN kind = 'item' THEN 1 END) AS items
           FROM tagged WHERE section IS NOT NULL GROUP BY doc_id, section),
req AS (SELECT * FROM (VALUES {ITEM_RANGE_VALUES}) AS t(section, min_items, max_items)),
ids AS (SELECT doc_id FROM src)
SELECT i.doc_id, r.section, CAST(coalesce(c.items, 0) AS BIGINT) AS items,
       r.min_items, r.max_items, coalesce(c.items, 0) BETWEEN r.min_items AND r.max_items AS within_range
FROM ids i CROSS JOIN req r LEFT JOIN counts c ON c.doc_id = i.doc_id AND c.section = r.section"""

SQL["item_ranges"] = f"WITH {DOCS}, {BLOCKS}, {ITEM_RANGES}"

SQL["report_item_ranges"] = f"WITH {REPORT_SRC}, {BLOCKS}, {ITEM_RANGES}"

WEB_RANGES = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in RP.WEB_ITEM_RANGES)
WEB_REQ = "[" + ", ".join(f"'{x}'" for x in RP.WEB_SECTIONS) + "]"

SQL["report_web_checks"] = rf"""WITH {WEB_REPORT},
src AS (SELECT CAST(1 AS BIGINT) AS doc_id, report AS text FROM rep), {BLOCKS},
{ITEM_RANGES.replace(ITEM_RANGE_VALUES, WEB_RANGES).replace(
    "ids AS (SELECT doc_id FROM src)\nSELECT", "ids AS (SELECT doc_id FROM src),\nsec_items AS (SELECT")})
SELECT i.*, (SELECT list(content ORDER BY line_no) FROM blocks WHERE kind = 'heading') = {WEB_REQ} AS exact,
       CAST(len(regexp_extract_all(s.text, '[^ \t\r\n]+')) AS BIGINT) AS words,
       len(regexp_extract_all(s.text, '[^ \t\r\n]+')) BETWEEN {RP.WEB_WORD_RANGE[0]} AND {RP.WEB_WORD_RANGE[1]}
         AS within_word_range,
       regexp_matches(s.text, '[.!?)][ \t\r\n]*\z') AS ends_sentence
FROM sec_items i JOIN src s ON i.doc_id = s.doc_id"""

MEASURE_VALS = """vals AS (
  SELECT CAST(revenue AS DECIMAL(38,6)) AS v FROM kpi
  UNION ALL SELECT CAST(ticket AS DECIMAL(38,6)) FROM kpi
  UNION ALL SELECT CAST(CAST(orders AS DOUBLE) AS DECIMAL(38,6)) FROM kpi
  UNION ALL SELECT CAST(revenue AS DECIMAL(38,6)) FROM shr
  UNION ALL SELECT CAST(CAST(delivered_orders AS DOUBLE) AS DECIMAL(38,6)) FROM shr
  UNION ALL SELECT CAST(CAST(late_rate AS DECIMAL(38,6)) * 100 AS DECIMAL(38,6)) FROM kpi
  UNION ALL SELECT CAST(CAST(late_rate AS DECIMAL(38,6)) * 100 AS DECIMAL(38,6)) FROM shr
  UNION ALL SELECT CAST(CAST(revenue_share AS DECIMAL(38,6)) * 100 AS DECIMAL(38,6)) FROM shr)"""

_TWO = "CAST(floor(revenue / 10000) AS BIGINT)"
_ONE = "CAST(floor(CAST(late_rate AS DECIMAL(38,6)) * 1000) AS BIGINT)"

SQL["grounding_scaled"] = f"""WITH {REPORT},
src AS (
  SELECT state AS doc_id, 'R$ ' || CAST({_TWO} // 100 AS VARCHAR) || ',' || lpad(CAST({_TWO} % 100 AS VARCHAR), 2, '0')
         || ' mi, atraso de ' || CAST({_ONE} // 10 AS VARCHAR) || ',' || CAST({_ONE} % 10 AS VARCHAR)
         || '%; meta de 987654321,5 mil.' AS text
  FROM sp WHERE state IS NOT NULL),
{MEASURE_VALS},
{GROUNDING.replace("SELECT n.doc_id,", "SELECT n.doc_id AS state,")}"""

SQL["report_grounding"] = f"WITH {REPORT_SRC}, {MEASURE_VALS}, {GROUNDING}"

SQL["data_limits"] = f"""WITH {O.STATE_PERF},{O.BY_MONTH_TAIL}, {KPI}, {O._by_category('p_type')},
u AS (
  SELECT 'cut_total' AS "check", 'kpi' AS subject, CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) AS value FROM kpi
  UNION ALL SELECT 'cut_total', 'state', CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) FROM sp
  UNION ALL SELECT 'cut_total', 'month', CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) FROM bm
  UNION ALL SELECT 'cut_total', 'category', CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) FROM sc
  UNION ALL SELECT 'order_total', 'kpi', CAST(sum(CAST(orders AS DECIMAL(38,4))) AS DOUBLE) FROM kpi
  UNION ALL SELECT 'order_total', 'state', CAST(sum(CAST(orders AS DECIMAL(38,4))) AS DOUBLE) FROM sp
  UNION ALL SELECT 'order_total', 'month', CAST(sum(CAST(orders AS DECIMAL(38,4))) AS DOUBLE) FROM bm
  UNION ALL SELECT 'distinct_values', 'sales_by_category.orders', CAST(count(DISTINCT orders) AS DOUBLE) FROM sc
  UNION ALL SELECT 'distinct_values', 'sales_by_category.delivered_orders',
                   CAST(count(DISTINCT delivered_orders) AS DOUBLE) FROM sc
  UNION ALL SELECT 'distinct_values', 'sales_by_category.revenue', CAST(count(DISTINCT revenue) AS DOUBLE) FROM sc
  UNION ALL SELECT 'distinct_values', 'sales_by_category.ticket', CAST(count(DISTINCT ticket) AS DOUBLE) FROM sc
  UNION ALL SELECT 'null_keys', 'state_performance', CAST(count(CASE WHEN state IS NULL THEN 1 END) AS DOUBLE) FROM sp
  UNION ALL SELECT 'null_keys', 'sales_by_month', CAST(count(CASE WHEN month IS NULL THEN 1 END) AS DOUBLE) FROM bm
  UNION ALL SELECT 'null_keys', 'sales_by_category',
                   CAST(count(CASE WHEN category IS NULL THEN 1 END) AS DOUBLE) FROM sc)
SELECT "check", subject, value,
       CASE WHEN "check" IN ('cut_total', 'order_total')
              THEN abs(value - max(CASE WHEN subject = 'kpi' THEN value END) OVER (PARTITION BY "check")) > 0.005
            WHEN "check" = 'distinct_values' THEN value <= 1
            ELSE value > 0 END AS flag
FROM u"""
