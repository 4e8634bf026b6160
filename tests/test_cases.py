"""Cases that the clean driver tables do not hold: null and missing groups,
several reviews, fine discounts, scaled numbers, session settings."""

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import clean, findings, measures, render, report
from tessera.roles import Roles
from tessera.sources import files as S
from tessera.sources import sinks


def test_fine_discounts_are_exact(spark):
    items = spark.createDataFrame([(1, 100.0, 0.125, "2020-01-02")],
                                  "l_orderkey long, l_extendedprice double, l_discount double, l_shipdate string")
    orders = spark.createDataFrame([(1, 1, "F", "2020-01-01")],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string")
    for roles in (Roles(), Roles(price_decimals=2, discount_decimals=3)):
        row = measures.kpi_general(measures.order_facts(orders, items, roles), roles).first()
        assert row.revenue == 87.5 and row.ticket == 87.5


def test_several_reviews_are_one_entity(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    row = measures.satisfaction(docs, labels).first()
    assert (row.entities, row.reviews, row.review_coverage) == (2, 3, 0.5)
    assert (row.avg_score, row.negative_share, row.positive_share) == (0.666667, 0.333333, 0.666667)


def test_a_missing_right_side_is_the_lowest(spark):
    left = spark.createDataFrame([("a", 1.0, 0.1), ("b", 9.0, 0.9), (None, 1.0, 0.1)], "s string, v double, r double")
    right = spark.createDataFrame([("a", 4), (None, 5)], "s string, n long")
    got = {x.s: (x.n, x.pattern) for x in findings.cross_table_pattern(left, right, "s", "v", "r", "n").collect()}
    assert got == {"a": (4, False), "b": (0, True), None: (5, False)}


def test_null_group_keeps_its_lines(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    got = {r.g: (r.rows, r.context) for r in render.context_blocks(df, ["g"], F.col("g"), ["k"], 5, ["k"]).collect()}
    assert got[None] == (2, "\n### Tabela: None\nk\n---\n1\n2\n") and got["a"][0] == 1


def test_records_keep_null_fields(spark):
    df = spark.createDataFrame([(1, None)], "id int, name string")
    assert clean.to_records(df).first().record == '{"id":1,"name":null}'


def test_text_keys_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("01", "a"), ("02", "b")], "k string, t string")
    sinks.write_markdown(df, "t", str(tmp_path / "m"), "k")
    got = sinks.read_markdown(spark, str(tmp_path / "m"), "t", "k").collect()
    assert sorted((r.k, r.t) for r in got) == [("01", "a"), ("02", "b")]


@pytest.mark.parametrize("text, grounded", [
    ("R$ 1,75 mi", True), ("R$ 1,76 mi", True), ("12,1%", True), ("12,2%", True), ("12,18%", True), ("1757,9 mil", True),
    ("1.757.905", True), ("1,74 mi", False), ("12,3%", False), ("1,75", False), ("1,75 mineiros", False)])
def test_grounding_of_scaled_and_cut_numbers(spark, text, grounded):
    keys = report.grounding_keys(spark.createDataFrame([(1757905.0,), (12.18,)], "v double"), "v")
    docs = spark.createDataFrame([(1, text)], "d int, t string")
    assert report.number_grounding(docs, "d", "t", keys).first().grounded is grounded


def test_item_ranges_of_a_long_document(spark):
    text = "## Recomendações\n" + "- x\n" * 4 + "text\n" * 20000 + "## Other\n- y\n## Recomendações\n- z"
    df = spark.createDataFrame([(1, text), (2, None)], "d int, t string")
    got = {(r.d, r.section): (r["items"], r.within_range) for r in report.item_ranges(df, "d", "t").collect()}
    assert got[1, "Recomendações"] == (5, True) and got[2, "Recomendações"] == (0, False)


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('a,a, b\n1,2,3\n4,5,6,7\n8\n"x\ny",Sã,1\n'.encode() + b"9,\xe3,1\n")
    rows, rejected = S.scan_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["a", "a.1", "b"]
    assert sorted(r[0] for r in rows.collect()) == ["1", "8", "x\ny"]
    assert sorted((r.cells, r.reason) for r in rejected.collect()) == [(3, "encoding"), (4, "ragged")]
    with pytest.raises(ValueError, match="rejected"):
        S.read_csv(spark, str(tmp_path / "a.csv"))


def test_csv_without_quoted_breaks_is_splittable(spark, tmp_path):
    (tmp_path / "b.csv").write_text("k,t\n" + "".join(f"{i},text of row {i}\n" for i in range(200000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = S.read_csv(spark, str(tmp_path / "b.csv"), "k long, t string")
        assert df.rdd.getNumPartitions() > 3 and df.count() == 200000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_session_settings_of_the_operator_stay(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "123")
    try:
        session.configure(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "123"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(session.BROADCAST_LIMIT_BYTES))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_nan_only_columns_are_empty(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], "k int, x double")
    assert clean.drop_empty_columns(df).columns == ["k"]


def test_staged_folders_can_be_cleared(spark):
    path = session.staging_path(spark, "clear-test")
    spark.range(3).write.parquet(path)
    assert S.exists(spark, path)
    kept, session._STAGED[:] = session._STAGED[:-1], [path]
    assert session.clear_staging(spark) == 1 and not S.exists(spark, path)
    session._STAGED[:] = kept


def test_a_stored_fact_can_be_passed(spark, sf_small):
    from tessera.plans import driver, reports
    facts = driver.stored_facts(spark, sf_small)
    assert sorted(map(tuple, reports.data_limits(spark, sf_small, facts).collect())) == sorted(
        map(tuple, reports.data_limits(spark, sf_small).collect()))
