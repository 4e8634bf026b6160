"""A-01, A-02: catalog resolution (first existing candidate, strict error)
and catalog load (every table, declared order, temp views)."""

import pytest

from tessera.sources import files as S


def _write(folder, name, text):
    p = folder / name
    p.write_bytes(text.encode("utf-8"))


def test_first_existing_candidate_wins(spark, tmp_path):
    _write(tmp_path, "pedidos.csv", "id,valor\n1,10\n2,20\n")
    _write(tmp_path, "clientes.csv", "id\n7\n")
    _write(tmp_path, "customers.csv", "id\n8\n")
    catalog = {"orders": ("orders.csv", "pedidos.csv"),
               "customers": ("clientes.csv", "customers.csv")}
    got = {r.table_name: (r.resolved_file, r.candidate_rank)
           for r in S.resolve_catalog(spark, str(tmp_path), catalog).collect()}
    assert got == {"orders": ("pedidos.csv", 1), "customers": ("clientes.csv", 0)}


def test_missing_table_names_table_folder_and_candidates(spark, tmp_path):
    _write(tmp_path, "pedidos.csv", "id\n1\n")
    catalog = {"orders": ("pedidos.csv",), "reviews": ("avaliacoes.csv", "reviews.csv")}
    with pytest.raises(S.CatalogError) as err:
        S.resolve_catalog(spark, str(tmp_path), catalog)
    text = str(err.value)
    assert "reviews" in text and str(tmp_path) in text
    assert "avaliacoes.csv or reviews.csv" in text


def test_lenient_resolution_keeps_found_tables(spark, tmp_path):
    _write(tmp_path, "pedidos.csv", "id\n1\n")
    catalog = {"orders": ("pedidos.csv",), "reviews": ("reviews.csv",)}
    got = [r.table_name for r in S.resolve_catalog(spark, str(tmp_path), catalog, strict=False).collect()]
    assert got == ["orders"]


def test_load_registers_views_in_declared_order(spark, tmp_path):
    _write(tmp_path, "b.csv", "x\n1\n2\n")
    _write(tmp_path, "a.csv", "y\n3\n")
    frames = S.load_catalog(spark, str(tmp_path), {"second": ("b.csv",), "first": ("a.csv",)})
    assert list(frames) == ["second", "first"]
    assert spark.sql("SELECT count(*) AS n FROM second").first().n == 2
    assert spark.sql("SELECT sum(y) AS s FROM first").first().s == 3


def test_listing_keeps_empty_files_with_any_name(spark, tmp_path):
    _write(tmp_path, "dados 100%.csv", "x\n1\n")
    _write(tmp_path, "vazio 50%.csv", "")
    got = sorted((r.path.rsplit("/", 1)[1], r.length) for r in S.list_files(spark, str(tmp_path)).collect())
    assert got == [("dados 100%.csv", 4), ("vazio 50%.csv", 0)]
    checked = {r.file_name: r.reason for r in
               S.validate(S.entry_names(spark, str(tmp_path)).withColumnRenamed("entry", "file_name"),
                          size_col="bytes", largest_col="largest").collect()}
    assert checked == {"dados 100%.csv": None, "vazio 50%.csv": "empty"}
