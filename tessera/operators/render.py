"""A-19..A-24: bounded text contexts and prompts.

Rendering happens only *after* the first-N cut, so every text aggregate holds
at most N lines per table or group, whatever the input size.  The first-N cut
per group is ``row_number() <= n`` over (group, key), which Spark plans as a
``WindowGroupLimit``: each map task keeps only its top N per group before the
shuffle, so even a group holding a third of all rows moves only N rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's text -------------------
TABLE_HEADER = "\n### Tabela: {name}\n"
EMPTY_TABLE = "(vazia)\n"
SAMPLE_NOTE = "\nObservação: tabela com {total} linhas; amostra limitada às primeiras {n}.\n"
CELL_SEPARATOR = " | "
RULE_CELL = "---"
NULL_TEXT = "None"
PROMPT_SEPARATOR = "\n\n---\n\n"
CLI_ROWS = 120
WEB_ROWS = 35
# ---------------------------------------------------------------------------


def first_n(df: DataFrame, order_cols: list[str], n: int) -> DataFrame:
    """A-19 for a whole table: TakeOrderedAndProject (top-N per task, merge)."""
    return df.orderBy(*order_cols).limit(n)


def first_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      n: int, pos_col: str = "pos") -> DataFrame:
    """A-19 per group: the first n rows of each group by an explicit key."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (df.withColumn(pos_col, F.row_number().over(w).cast("bigint"))
            .where(F.col(pos_col) <= n))


def sample_note(total: Column, n: int) -> Column:
    """A-20: the note, only when the table has more rows than were kept."""
    before, after = SAMPLE_NOTE.split("{total}")
    middle, end = after.split("{n}")
    return F.when(total > n, F.concat(F.lit(before), total.cast("string"), F.lit(middle),
                                      F.lit(str(n)), F.lit(end)))


def escape_cell(text: Column) -> Column:
    """A cell that cannot break its row: ``|`` behind a backslash, line breaks as ``<br>``."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")),
                            r"\r\n|\r|\n", "<br>")


def row_line(cols: list[str], null_text: str = NULL_TEXT, escape: bool = False) -> Column:
    """One rendered row: cells as text joined by " | ", missing as ``null_text``;
    ``escape`` keeps separators and line breaks inside a cell from looking like the row's."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)) for c in cols]
    cells = [escape_cell(c) for c in cells] if escape else cells
    return F.concat(F.concat_ws(CELL_SEPARATOR, *cells), F.lit("\n"))


def header_text(name: Column, cols: list[str]) -> Column:
    before, after = TABLE_HEADER.split("{name}")
    head = F.concat(F.lit(before), name, F.lit(after))
    if not cols:
        return head
    names = CELL_SEPARATOR.join(cols) + "\n" + CELL_SEPARATOR.join([RULE_CELL] * len(cols)) + "\n"
    return F.concat(head, F.lit(names))


def _ordered_text(line: str, pos: str) -> Column:
    return F.expr(f"listagg({line}, '') WITHIN GROUP (ORDER BY {pos})")


def context_blocks(df: DataFrame, group_cols: list[str], name: Column, order_cols: list[str],
                   n: int, render_cols: list[str] | None = None,
                   null_text: str = NULL_TEXT, totals: DataFrame | None = None,
                   escape: bool = False) -> DataFrame:
    """A-21 per group: one text block per group of ``df``.

    Totals come from a partial+final count per group; the lines come from
    the first-N rows per group.  Both have one row per group, so they are
    stacked and folded by one aggregation, which keeps a null group like any
    other.  ``df`` is read for each side; ``totals`` (the group columns and
    ``_total``) spares the count where it can be made from fewer columns.  A
    null name is rendered as ``null_text``; ``escape`` as in ``row_line``.
    """
    cols = render_cols if render_cols is not None else df.columns
    if totals is None:
        totals = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_total"))
    lines = (first_n_per_group(df, group_cols, order_cols, n, "_pos")
             .select(*group_cols, "_pos", row_line(cols, null_text, escape).alias("_line"))
             .groupBy(*group_cols).agg(_ordered_text("_line", "_pos").alias("_rows")))
    stacked = totals.withColumn("_rows", F.lit(None).cast("string")).unionByName(
        lines.withColumn("_total", F.lit(None).cast("bigint")))
    joined = stacked.groupBy(*group_cols).agg(F.max("_total").alias("_total"), F.max("_rows").alias("_rows"))
    text = F.concat(header_text(F.coalesce(name, F.lit(null_text)), cols),
                    F.coalesce(sample_note(F.col("_total"), n), F.lit("")),
                    F.coalesce(F.col("_rows"), F.lit("")))
    return joined.select(*group_cols, text.alias("context"), F.col("_total").alias("rows"))


def table_block(df: DataFrame, table_name: str, order_cols: list[str], n: int,
                null_text: str = NULL_TEXT) -> DataFrame:
    """A-21 for a whole table: a one-row frame (table_name, context, rows).

    An empty table renders as the header plus the empty marker; the group
    key is a literal, so the totals and the lines aggregate map-side."""
    cols = df.columns
    keyed = df.withColumn("_table", F.lit(table_name))
    totals = keyed.groupBy("_table").agg(F.count(F.lit(1)).alias("_total"))
    limited = first_n(keyed, order_cols, n)
    w = Window.partitionBy("_table").orderBy(*order_cols)
    lines = (limited.withColumn("_pos", F.row_number().over(w))
             .select("_table", "_pos", row_line(cols, null_text).alias("_line"))
             .groupBy("_table").agg(_ordered_text("_line", "_pos").alias("_rows")))
    empty = keyed.sparkSession.range(1).select(F.lit(table_name).alias("_table"),
                                               F.lit(0).cast("bigint").alias("_total"))
    totals = totals.unionByName(empty).groupBy("_table").agg(F.max("_total").alias("_total"))
    joined = totals.join(lines, "_table", "left")
    head_name = TABLE_HEADER.format(name=table_name)
    names = (CELL_SEPARATOR.join(cols) + "\n" + CELL_SEPARATOR.join([RULE_CELL] * len(cols)) + "\n"
             if cols else "")
    text = F.when(F.col("_total") == 0, F.lit(head_name + EMPTY_TABLE)).otherwise(F.concat(
        F.lit(head_name + names),
        F.coalesce(sample_note(F.col("_total"), n), F.lit("")),
        F.coalesce(F.col("_rows"), F.lit("")),
    ))
    return joined.select(F.col("_table").alias("table_name"), text.alias("context"),
                         F.col("_total").alias("rows"))


def dataset_context(blocks: DataFrame, order_col: str = "table_order") -> DataFrame:
    """A-22: blocks concatenated in table order (one row)."""
    return blocks.agg(_ordered_text("context", order_col).alias("context"))


def fill_template(template: str, context: Column, placeholder: str = "{context}") -> Column:
    """A-23: the template with its one placeholder replaced."""
    return F.replace(F.lit(template), F.lit(placeholder), context)


def full_prompt(system: str, user: Column) -> Column:
    """A-24: system text, separator, user text."""
    return F.concat(F.lit(system + PROMPT_SEPARATOR), user)
