import io
import zipfile

import pytest

from tessera.sources import workbook as W


def test_roundtrip_inline_strings():
    data = W.workbook_bytes({"S1": (["a", "b"], [(1, "x"), (2.5, None)]), "S2": (["c"], [("y",)])})
    rows = list(W.parse_workbook(data))
    assert rows[0] == ("S1", 1, ["a", "b"])
    assert rows[1] == ("S1", 2, ["1", "x"])
    assert rows[2] == ("S1", 3, ["2.5"])
    assert rows[4] == ("S2", 2, ["y"])


def test_shared_strings_and_booleans():
    data = W.workbook_bytes({"S": (["a"], [(1,)])})
    src = zipfile.ZipFile(io.BytesIO(data))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in src.namelist():
            body = src.read(name)
            if name.endswith("sheet1.xml"):
                body = (f'<worksheet xmlns="{W.NS["m"]}"><sheetData>'
                        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                        '<row r="2"><c r="A2" t="b"><v>1</v></c><c r="C2"><v>7</v></c></row>'
                        '</sheetData></worksheet>').encode()
            z.writestr(name, body)
        z.writestr("xl/sharedStrings.xml",
                   f'<sst xmlns="{W.NS["m"]}"><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>')
    rows = list(W.parse_workbook(buf.getvalue()))
    assert rows == [("S", 1, ["name", None, "value"]), ("S", 2, ["True", None, "7"])]


def test_read_and_type_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "g1"), (2, "b", "g2"), (3, "c", "g1")], "k long, v string, g string")
    W.write_workbooks(df.withColumn("f", df.g), "f", "g", str(tmp_path), ["k", "v"]).collect()
    out = W.sheet_table(W.read_workbooks(spark, str(tmp_path)), df.select("k", "v").schema)
    assert sorted((r.table_name, r.k, r.v) for r in out.collect()) == [
        ("g1_g1", 1, "a"), ("g1_g1", 3, "c"), ("g2_g2", 2, "b")]


def test_missing_trailing_cells_read_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "g"), (2, None, "g")], "k long, v string, g string")
    W.write_workbooks(df, "g", "g", str(tmp_path), ["k", "v"]).collect()
    out = W.sheet_table(W.read_workbooks(spark, str(tmp_path)), df.select("k", "v").schema)
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, "a"), (2, None)]


def test_dates_in_both_systems_and_cells_without_references():
    import datetime as dt
    day = dt.datetime(2020, 2, 29, 13, 30)
    sheets = {"p": (["k", "d"], [(1, day), (2, None), (None, dt.datetime(1999, 12, 31))])}
    want = [("p", 1, ["k", "d"]), ("p", 2, ["1", "2020-02-29 13:30:00"]), ("p", 3, ["2"]),
            ("p", 4, [None, "1999-12-31 00:00:00"])]
    for late in (False, True):
        for references in (False, True):
            got = list(W.parse_workbook(W.workbook_bytes(sheets, late, references)))
            assert [(s, r, [c for c in cells[:len(w[2])]]) for (s, r, cells), w in zip(got, want)] == want


def test_date_formats():
    assert all(W.is_date_format(f) for f in ("yyyy-mm-dd", "d/m/yy", '[h]:mm:ss', '"Em" dd "de" mmmm'))
    assert not any(W.is_date_format(f) for f in ("0.00", "General", '"days" 0', "[Red]0", "#,##0 [$R$-416]"))


def test_size_limit(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(W.workbook_bytes({"p": (["k"], [(i,) for i in range(100)])}))
    assert W.read_workbooks(spark, str(tmp_path), limit_mb=1).count() == 100
    with pytest.raises(ValueError, match="a.xlsx"):
        W.read_workbooks(spark, str(tmp_path), limit_mb=0.0001)
