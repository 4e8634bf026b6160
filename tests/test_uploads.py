"""A-05 end to end: a folder of uploads -> cleaned tables and their profile."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import uploads as UP
from tessera.sources.workbook import workbook_bytes


def _put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))


def test_header_names_follow_pandas(spark):
    df = spark.createDataFrame([(["a", "", "a", " b ", "a"], 6), (None, 2), ([], 0)],
                               "h array<string>, w int")
    got = [r.n for r in df.select(UP.header_columns(F.col("h"), F.col("w")).alias("n")).collect()]
    assert got == [["a", "Unnamed: 1", "a.1", "b", "a.2", "Unnamed: 5"],
                   ["Unnamed: 0", "Unnamed: 1"], []]


def test_csv_and_workbook_uploads(spark, tmp_path):
    _put(tmp_path, "vendas_Plan1.csv", "uf, receita ,vazia\nSP,10,\n,,\nRJ,NA,\n")
    _put(tmp_path, "vendas.xlsx", workbook_bytes({
        "Plan1": (["uf", "x"], [("MG", 1), ("BA", None)]),
        "Resumo": (["k", "k", "nada"], [("a", "b", None), (None, None, None), ("c", "N/A", None)]),
    }))
    _put(tmp_path, "leia-me.txt", "texto")
    data, profile, rejected = UP.load_uploads(spark, str(tmp_path), strict=False)
    rows = {(r.table_name, r.source_file): r for r in profile.collect()}
    assert set(rows) == {("vendas_Plan1", "vendas_Plan1.csv"), ("vendas_Plan1", "vendas.xlsx"),
                         ("vendas_Resumo", "vendas.xlsx")}
    # the CSV comes later in name order, so it replaces the sheet of the same name
    assert rows[("vendas_Plan1", "vendas.xlsx")].superseded
    assert not rows[("vendas_Plan1", "vendas_Plan1.csv")].superseded
    csv = rows[("vendas_Plan1", "vendas_Plan1.csv")]
    assert (csv.rows, csv.columns) == (2, ["uf", "receita"])  # blank row and empty column dropped
    resumo = rows[("vendas_Resumo", "vendas.xlsx")]
    assert (resumo.rows, resumo.columns) == (2, ["k", "k.1"])
    assert sorted(data) == ["vendas_Plan1", "vendas_Resumo"]
    assert [tuple(r) for r in data["vendas_Resumo"].orderBy("k").collect()] == [("a", "b"), ("c", None)]
    assert [r.uf for r in data["vendas_Plan1"].orderBy("uf").collect()] == ["RJ", "SP"]


def test_sheet_rows_missing_trailing_cells(spark, tmp_path):
    _put(tmp_path, "v.xlsx", workbook_bytes({"A": (["x", "y", "z"], [(1, "a", 5), (2, None, None),
                                                                    (None, None, 7)])}))
    data, profile, rejected = UP.load_uploads(spark, str(tmp_path))
    assert [tuple(r) for r in data["v_A"].orderBy("x").collect()] == [
        (None, None, "7"), ("1", "a", "5"), ("2", None, None)]
    assert profile.first().rows == 3


def test_strict_mode_stops_at_first_rejection(spark, tmp_path):
    _put(tmp_path, "a.csv", "x\n1\n")
    _put(tmp_path, "b.csv", b"")
    _put(tmp_path, "c.pdf", "x")
    with pytest.raises(UP.UploadError, match="b.csv está vazio"):
        UP.load_uploads(spark, str(tmp_path))


def test_no_accepted_file(spark, tmp_path):
    _put(tmp_path, "c.pdf", "x")
    with pytest.raises(UP.UploadError, match="Envie pelo menos um arquivo"):
        UP.load_uploads(spark, str(tmp_path), strict=False)


def test_sheet_types_inferred_on_request(spark, tmp_path):
    _put(tmp_path, "v.xlsx", workbook_bytes({"A": (["n", "x", "s"], [(1, 1.5, "a"), (2, 2, None),
                                                                    (None, None, "b")])}))
    data, _, _ = UP.load_uploads(spark, str(tmp_path), infer_types=True)
    df = data["v_A"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string"]
    assert sorted(tuple(r) for r in df.collect() if r.n is not None) == [(1, 1.5, "a"), (2, 2.0, None)]


def test_rejected_files_come_back_with_their_reason(spark, tmp_path):
    _put(tmp_path, "a.csv", "x,y\n1,2\n")
    _put(tmp_path, "latin.csv", "nome\nS\u00e3o\n".encode("latin-1"))
    _put(tmp_path, "old.xls", "x")
    _put(tmp_path, "leia.txt", "x")
    _put(tmp_path, "vazio.csv", b"")
    data, profile, rejected = UP.load_uploads(spark, str(tmp_path), strict=False)
    assert {r.file_name: r.reason for r in rejected.collect()} == {
        "latin.csv": "encoding", "old.xls": "legacy", "leia.txt": "unsupported", "vazio.csv": "empty"}
    assert list(data) == ["a"] and profile.count() == 1
    with pytest.raises(UP.UploadError, match="latin.csv"):
        UP.load_uploads(spark, str(tmp_path))


def test_no_size_limit_unless_given_and_parts_are_judged_singly(spark, tmp_path):
    spark.range(300000).repartition(4).write.option("header", "true").csv(str(tmp_path / "big.csv"))
    _put(tmp_path, "one.csv", "x\n1\n")
    _, profile, rejected = UP.load_uploads(spark, str(tmp_path))
    assert {r.table_name: r.rows for r in profile.collect()} == {"big": 300000, "one": 1}
    assert rejected.count() == 0
    total = sum(f.stat().st_size for f in (tmp_path / "big.csv").glob("part*")) / 1048576
    _, profile, rejected = UP.load_uploads(spark, str(tmp_path), limit_mb=total / 2, strict=False)
    assert profile.count() == 2 and rejected.count() == 0
    _, profile, rejected = UP.load_uploads(spark, str(tmp_path), limit_mb=total / 8, strict=False)
    assert [r.reason for r in rejected.collect()] == ["too_large"] and profile.count() == 1


def test_ragged_records_and_header_only_files(spark, tmp_path):
    _put(tmp_path, "r.csv", 'a,b\n1,2\n3,4,5\n6\n"x,y",7\n')
    _put(tmp_path, "h.csv", "p,q\n")
    data, profile, _ = UP.load_uploads(spark, str(tmp_path), strict=False)
    by = {r.table_name: r for r in profile.collect()}
    assert (by["r"].rows, by["r"].ragged_rows) == (3, 1)
    assert (by["h"].rows, by["h"].columns) == (0, ["p", "q"])
    assert sorted((str(r.a), r.b) for r in data["r"].collect()) == [("1", 2), ("6", None), ("x,y", 7)]
    assert data["h"].columns == ["p", "q"] and data["h"].count() == 0
    with pytest.raises(UP.UploadError, match="r.csv"):
        UP.load_uploads(spark, str(tmp_path))


def test_quoted_breaks_types_and_names_with_escapes(spark, tmp_path):
    _put(tmp_path, "dados 100%+a.csv", '\ufeffid,id,mes,ok\n1,NA,2016-09,True\n2,"3",2016-10,False\n')
    _put(tmp_path, "texto.csv", 'id,t\n1,"a\nb ""c"""\n2,d\n')
    data, profile, _ = UP.load_uploads(spark, str(tmp_path))
    df = data["dados_100_a"]
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [
        ("id", "bigint"), ("id.1", "bigint"), ("mes", "string"), ("ok", "boolean")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, None, "2016-09", True), (2, 3, "2016-10", False)]
    assert sorted(r.t for r in data["texto"].collect()) == ['a\nb "c"', "d"]


def test_wide_and_narrow_files_have_scans_of_their_own(spark, tmp_path):
    """A row is at most twice as wide as its file, and names of a wide header are made once."""
    wide = [f"c{i % 900}" for i in range(1000)]
    _put(tmp_path, "wide.csv", ",".join(wide) + "\n" + ",".join(str(i) for i in range(1000)) + "\n")
    _put(tmp_path, "a.csv", "x,y\n1,2\n")
    _put(tmp_path, "b.csv", "x,y,z\n1,2,3\n")
    files = UP.csv_files(spark, str(tmp_path), ["a.csv", "b.csv", "wide.csv"])
    read = UP.csv_rows(spark, str(tmp_path), files)._jdf.queryExecution().analyzed().collectLeaves()
    widths = [read.apply(i).output().size() for i in range(read.size())]
    assert sorted(w for w in widths if w > 900) == [1000 + 2]  # one cell more, and the file's metadata
    assert all(w <= 16 for w in widths if w <= 900)
    data, profile, _ = UP.load_uploads(spark, str(tmp_path))
    by = {r.table_name: r for r in profile.collect()}
    assert by["wide"].columns == [f"c{i}" for i in range(900)] + [f"c{i}.1" for i in range(100)]
    assert [by[t].position for t in ("a", "b", "wide")] == [0, 1, 2]
    (row,) = data["wide"].select("`c7`", "`c7.1`", "`c99.1`").collect()
    assert tuple(row) == (7, 907, 999)
    assert [tuple(r) for r in data["b"].collect()] == [(1, 2, 3)]


def test_sheets_with_a_header_only(spark, tmp_path):
    _put(tmp_path, "v.xlsx", workbook_bytes({"A": (["x", "y"], [(1, "a")]), "B": (["p", "q"], [])}))
    _put(tmp_path, "w.xlsx", workbook_bytes({"C": (["r"], [])}))
    data, profile, _ = UP.load_uploads(spark, str(tmp_path))
    assert {r.table_name: (r.rows, r.columns) for r in profile.collect()} == {
        "v_A": (1, ["x", "y"]), "v_B": (0, ["p", "q"]), "w_C": (0, ["r"])}
    assert data["v_B"].columns == ["p", "q"] and data["v_B"].count() == 0


def test_positions_without_one_window_over_all(spark):
    from tessera.operators.number import number_rows
    names = [f"n{i * 7919 % 5000:05d}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    out = number_rows(df, [F.col("name")], "position")
    assert [(r.name, r.position) for r in out.orderBy("name").collect()] == [
        (n, i) for i, n in enumerate(sorted(names))]
    assert number_rows(df.where("false"), [F.col("name")], "position").count() == 0


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / f"n{n}"
        folder.mkdir()
        for i in range(n):
            _put(folder, f"f{i}.csv", f"a{i},b\n1,2\n")
        tag = f"uploads-{n}"
        spark.sparkContext.setJobGroup(tag, tag)
        UP.load_uploads(spark, str(folder))[1].collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    jobs(1)
    assert jobs(9) <= jobs(2) + 1
