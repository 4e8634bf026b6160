import pytest
from pyspark.sql import functions as F

from tessera.operators import clean as A
from tessera.sources.files import read_csv


def _csv(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode("utf-8"))
    return str(p)


def test_bom_header(spark, tmp_path):
    df = read_csv(spark, _csv(tmp_path, "a.csv", "﻿a,b\n1,2\n"))
    assert df.columns == ["a", "b"]


def test_all_missing_row_and_column(spark, tmp_path):
    df = A.clean(read_csv(spark, _csv(tmp_path, "r.csv", "a,b\n1,2\n,\n3,4\n")))
    assert df.count() == 2
    df = A.clean(read_csv(spark, _csv(tmp_path, "c.csv", "a,b,c\n1,,2\n3,,4\n")))
    assert df.columns == ["a", "c"]


def test_null_tokens_make_row_empty(spark, tmp_path):
    text = "a\nNA\nnull\nN/A\nNone\nnan\n#N/A\nx\n"
    df = A.clean(read_csv(spark, _csv(tmp_path, "n.csv", text), "a string"))
    assert [r.a for r in df.collect()] == ["x"]


def test_quoted_line_break_and_doubled_quote(spark, tmp_path):
    df = read_csv(spark, _csv(tmp_path, "q.csv", 'a,b\n"x\ny","p|q"\n"say ""hi""",2\n'), "a string, b string")
    rows = df.collect()
    assert rows[0].a == "x\ny" and rows[0].b == "p|q"
    assert rows[1].a == 'say "hi"'


def test_short_row_padded_then_dropped_column(spark, tmp_path):
    df = A.clean(read_csv(spark, _csv(tmp_path, "s.csv", "a,b,c\n1,2\n"), "a int, b int, c int"))
    assert df.columns == ["a", "b"]


def test_names_equal_after_strip_raise(spark):
    df = spark.createDataFrame([(1, 2)], "`a` int, ` a` int")
    with pytest.raises(A.DuplicateColumnError):
        A.strip_column_names(df)


def test_strip_names(spark):
    df = spark.createDataFrame([(1,)], "` a\t` int")
    assert A.strip_column_names(df).columns == ["a"]


def test_name_collision_last_wins(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a-b"), (3, "c")], "pos int, f string")
    named = A.table_names(df, "f")
    out = {r.pos: (r.table_name, r.superseded)
           for r in A.resolve_name_collisions(named, "table_name", "pos").collect()}
    assert out == {1: ("a_b", True), 2: ("a_b", False), 3: ("c", False)}


def test_to_records(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert A.to_records(df).first().record == '{"id":1,"name":"x"}'


def test_drop_empty_columns_keeps_order(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert A.drop_empty_columns(df).columns == ["a", "c"]


def test_validation_rules_and_order(spark):
    from tessera.sources import files as S
    df = spark.createDataFrame(
        [(0, "a.csv", 0), (1, "b.txt", 10), (2, "C.XLSX", 20 * 1048576), (3, "d.xls", 5), (4, "e.csv", 7)],
        "pos int, file_name string, length long")
    v = {r.pos: (r.reason, r.accepted, r.message) for r in S.validate(df, limit_mb=S.WEB_UPLOAD_MB).collect()}
    assert v[0][0] == "empty" and v[0][2] == "O arquivo a.csv está vazio."
    assert v[1][2] == "Formato não suportado em b.txt. Use .csv, .xls, .xlsx."
    assert v[2][2] == "O arquivo C.XLSX tem 20.0MB. O limite atual é 12MB por arquivo."
    assert v[3][1] and v[4][1]
    assert S.first_rejection(S.validate(df), "pos") == v[0][2]
    with pytest.raises(ValueError):
        S.require_files(df.where("pos < 0"))


def test_dedupe_uploads_keeps_last_in_first_position(spark):
    from tessera.sources import files as S
    df = spark.createDataFrame([(1, "a", 5, "v1"), (2, "b", 5, "x"), (3, "a", 5, "v2")],
                               "pos int, name string, size int, payload string")
    out = {r.name: (r.position, r.payload, r.copies)
           for r in S.dedupe_uploads(df, ["name", "size"], "pos", ["payload"]).collect()}
    assert out == {"a": (1, "v2", 2), "b": (2, "x", 1)}


def test_error_envelope_keeps_profile(spark):
    from tessera.operators import profile as PR
    from tessera.sources import sinks as K
    prof = PR.table_profile([("t", "t.csv", spark.range(3))], 120)
    env = K.error_envelope(F.lit("falhou"), prof).first()
    assert env.message == "falhou" and env.table_count == 1 and env.tables[0].rows == 3
    assert env.generated_at.endswith("+00:00")
