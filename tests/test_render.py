from pyspark.sql import functions as F

from tessera.operators import render as R


def _table(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def test_note_only_above_limit(spark):
    at = R.table_block(_table(spark, 120), "t", ["k"], 120).first()
    above = R.table_block(_table(spark, 121), "t", ["k"], 120).first()
    assert "Observação" not in at.context
    assert "tabela com 121 linhas; amostra limitada às primeiras 120." in above.context


def test_block_layout(spark):
    block = R.table_block(_table(spark, 3), "t", ["k"], 2).first().context
    assert block == ("\n### Tabela: t\nk | v\n--- | ---\n"
                     "\nObservação: tabela com 3 linhas; amostra limitada às primeiras 2.\n"
                     "0 | 0\n1 | 2\n")


def test_empty_table(spark):
    block = R.table_block(_table(spark, 0), "vazio", ["k"], 5).first().context
    assert block == "\n### Tabela: vazio\n(vazia)\n"


def test_null_cells_render_as_none(spark):
    df = spark.createDataFrame([(1, None)], "k int, v string")
    assert R.table_block(df, "t", ["k"], 5).first().context.endswith("1 | None\n")


def test_group_blocks_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    blocks = R.context_blocks(df, ["g"], F.col("g").cast("string"), ["k"], 7, ["k"]).collect()
    assert len(blocks) == 3
    for b in blocks:
        body = b.context.split("primeiras 7.\n", 1)[1]
        assert body.count("\n") == 7 and b.rows == 334 - (b.g > 0)


def test_prompt_helpers(spark):
    df = spark.createDataFrame([("CTX",)], "c string")
    user = R.fill_template("a {context} b", F.col("c"))
    row = df.select(user.alias("u"), R.full_prompt("SYS", user).alias("p")).first()
    assert row.u == "a CTX b" and row.p == "SYS\n\n---\n\na CTX b"


def test_escaped_cells_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "a|b\nc\r\nd\\"), (2, None)], "k int, v string").withColumn("g", F.lit("x"))
    plain, safe = (R.context_blocks(df, ["g"], F.col("g"), ["k"], 5, ["k", "v"], escape=e).first().context
                   for e in (False, True))
    assert plain.endswith("1 | a|b\nc\r\nd\\\n2 | None\n")
    assert safe.endswith("1 | a\\|b<br>c<br>d\\\\\n2 | None\n")


def test_given_totals_are_taken(spark):
    df = spark.range(50).select(F.lit("x").alias("g"), F.col("id").alias("k"))
    totals = spark.createDataFrame([("x", 77)], "g string, _total bigint")
    row = R.context_blocks(df, ["g"], F.col("g"), ["k"], 2, ["k"], totals=totals).first()
    assert row.rows == 77 and row.context.endswith("0\n1\n")
