from pyspark.sql import functions as F

from tessera.functions.text import (bytes_text, extension, locale_number, locale_stats, null_token,
                                    safe_name, stem, thousands_text)


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def test_safe_name_cases(spark):
    cases = {
        "vendas por mês": "vendas_por_mês",
        "__a--b__": "a_b",
        "***": "tabela",
        "a×b÷c": "a×b÷c",
        "relatório_2024.v2": "relatório_2024_v2",
    }
    for raw, want in cases.items():
        assert _one(spark, safe_name, raw) == want


def test_safe_name_idempotent(spark):
    df = spark.createDataFrame([("a b-c",), ("x__y",), ("!!",)], "v string")
    once = df.select(safe_name(F.col("v")).alias("v"))
    twice = once.select(safe_name(F.col("v")).alias("v"))
    assert sorted(r.v for r in once.collect()) == sorted(r.v for r in twice.collect())


def test_locale_number_golden(spark):
    golden = {"$13221498,1": 13221498.1, "6,77%": 0.0677, "99%": 0.99, "4,09": 4.09,
              "$1.234,56": 1234.56, "abc": None}
    for raw, want in golden.items():
        got = _one(spark, locale_number, raw)
        assert (got is None and want is None) or abs(got - want) < 1e-9, (raw, got)


def test_null_tokens(spark):
    values = ["NA", "null", "N/A", "None", "nan", "#N/A", "x", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = [r.r for r in df.select(null_token(F.col("v")).alias("r")).collect()]
    assert out.count(None) == 7 and "x" in out


def test_number_texts(spark):
    assert _one(spark, thousands_text, 1234567, "v bigint") == "1.234.567"
    for n, want in [(512, "512 B"), (1536, "1.5 KB"), (1280, "1.3 KB"), (12 * 1048576, "12.0 MB")]:
        assert _one(spark, bytes_text, n, "v bigint") == want


def test_extension_and_stem(spark):
    assert _one(spark, extension, "dir/X.CSV") == ".csv"
    assert _one(spark, extension, "noext") == ""
    assert _one(spark, stem, "a/b/relatório.v2.xlsx") == "relatório.v2"


def test_plain_numbers_keep_their_point(spark):
    df = spark.createDataFrame([("12.5",), ("$12,5",), ("1.234",), ("1.234,5",), ("n/d",), ("12.5%",), (None,)], "t string")
    assert [r.v for r in df.select(locale_number(F.col("t")).alias("v")).collect()] == [
        12.5, 12.5, 1234.0, 1234.5, None, 0.125, None]
    row = df.agg(*locale_stats(F.col("t"))).first()
    assert (row["values"], row.plain, row.unparseable) == (6, 3, 1)
