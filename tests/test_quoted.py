"""Records with quoted line breaks: many tasks against a plain parser and the one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import quoted


@pytest.fixture()
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "500")
    yield
    spark.conf.set(key, old)


def cells(rng):
    pieces = ["a", "bc", ",", '"', '""', "\n", "\r\n", " ", "é", "x" * 40, '",', '\n"', "1", ""]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(3)]


def as_csv(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


def test_state_of_a_line(spark):
    # line, cell open behind it if none was open before, if one was
    cases = [("a,b", 0, 1), ('a,"b', 1, 0), ('"a""', 1, 0), ('b",c', 0, 0), ('x",y,"z', 1, 1), ('""', 0, 1),
             ('5" pipe,b', 0, 0), ('"a,b","c', 1, 1), ('a"",b', 0, 1), ('",', 1, 0), ("", 0, 1)]
    df = spark.createDataFrame([(c[0],) for c in cases], "line string")
    out, inside = quoted.open_behind(F.col("line"), ",")
    got = df.select("line", out.cast("int"), inside.cast("int")).collect()
    assert [tuple(r) for r in got] == cases


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_match_a_plain_parser(spark, small_blocks, tmp_path, end):
    rng = random.Random(len(end))
    rows = [cells(rng) for _ in range(400)]
    rows = [r for r in rows if any(c.strip() for c in r)]
    path = tmp_path / "a.csv"
    with open(path, "w", newline="") as f:
        f.write(as_csv([["p", "q", "r"], *rows], csv.QUOTE_ALL, end))
    records = quoted.csv_records(spark, str(path))
    assert records.select(F.spark_partition_id()).distinct().count() > 1
    got, _ = S.scan_csv(spark, str(path), multiline=True)
    assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(map(tuple, rows))


def test_same_as_the_one_task_reader(spark, small_blocks, tmp_path):
    rng = random.Random(3)
    for part in range(3):
        rows = [cells(rng) for _ in range(120)] + [["5' 6\" tall", "", "b"], ["\n" * 300, "long", "x" * 2000]]
        (tmp_path / f"part-{part}.csv").write_bytes(as_csv([["p", "q", "r"], *rows]).encode())
    got, rejected = S.scan_csv(spark, str(tmp_path), multiline=True)
    want = (spark.read.options(**S.CSV_OPTIONS).option("multiLine", "true")
            .schema("p string, q string, r string").csv(str(tmp_path)))
    key = lambda r: tuple((x is not None, x or "") for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert rejected.count() == 0


def test_ragged_unclosed_header_only_and_declared_schema(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1,"x\ny"\n2,z,3\n4\n5,"never\nclosed')
    rows, rejected = S.scan_csv(spark, str(tmp_path / "r.csv"))
    got = {tuple(r) for r in rows.collect()}
    assert {("1", "x\ny"), ("4", None)} <= got and len(got) == 3
    assert [(r.record, r.cells, r.reason) for r in rejected.collect()] == [("2,z,3", 3, "ragged")]
    (tmp_path / "h.csv").write_text('\n"a\nb",c\n')
    rows, _ = S.scan_csv(spark, str(tmp_path / "h.csv"), multiline=True)
    assert rows.count() == 0
    (tmp_path / "d.csv").write_text('n,t\n1,"x\ny"\n')
    df = S.read_csv(spark, str(tmp_path / "d.csv"), "n bigint, t string")
    assert [tuple(r) for r in df.collect()] == [(1, "x\ny")]
    with pytest.raises(ValueError, match="declared"):
        S.read_csv(spark, str(tmp_path / "d.csv"), "m bigint, t string")
