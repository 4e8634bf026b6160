"""The streaming upload flow: re-runs with the same checkpoint process only
new files, and rejected uploads never reach the profile."""

import random

from tessera.plans.ingest import CSV_WRITE
from tessera.session import staging_path
from tessera.sources.files import _filesystem
from tessera.streaming import uploads as U


def _totals(spark, sink):
    return {r.table_name: r.rows for r in U.uploaded_tables(spark, sink).collect()}


def test_rerun_processes_only_new_files(spark):
    root = staging_path(spark, "drop-test")
    work = staging_path(spark, "stream-test")
    spark.range(10).write.options(**CSV_WRITE).csv(f"{root}/first.csv")
    spark.range(3).selectExpr("'x' AS t").write.text(f"{root}/notes.txt")
    U.run_upload_stream(spark, root, f"{work}/sink", f"{work}/ck", max_files=2)
    assert _totals(spark, f"{work}/sink") == {"first": 10}

    spark.range(7).write.options(**CSV_WRITE).csv(f"{root}/second.csv")
    U.run_upload_stream(spark, root, f"{work}/sink", f"{work}/ck", max_files=2)
    # the first upload is not counted twice; the text upload stays rejected
    assert _totals(spark, f"{work}/sink") == {"first": 10, "second": 7}


def test_rejected_and_empty_uploads(spark):
    root, work = staging_path(spark, "drop-test"), staging_path(spark, "stream-test")
    filesystem, empty = _filesystem(spark, f"{root}/empty.csv")
    filesystem.createNewFile(empty)

    def rejected():
        U.run_upload_stream(spark, root, f"{work}/sink", f"{work}/ck", max_files=2)
        return {(r.file_name, r.reason, r.bytes) for r in U.rejected_uploads(spark, f"{work}/sink").collect()}

    assert rejected() == {("empty.csv", "empty", 0)}
    spark.range(2).write.options(**CSV_WRITE).csv(f"{root}/good.csv")
    spark.range(3).selectExpr("'x' AS t").coalesce(1).write.text(f"{root}/notes.txt")
    assert rejected() == {("notes.txt", "unsupported", 6), ("empty.csv", "empty", 0)}
    # a run without news counts nothing twice; an upload filled later is accepted
    filesystem.delete(empty, False)
    spark.range(5).write.options(**CSV_WRITE).csv(f"{root}/empty.csv")
    assert rejected() == {("notes.txt", "unsupported", 6)}
    assert _totals(spark, f"{work}/sink") == {"good": 2, "empty": 5}


def test_later_copies_win_whatever_order_they_arrive_in(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice(["x", "y", None])) for i in range(60)]
    rng.shuffle(rows)
    root, work = staging_path(spark, "drop-test"), staging_path(spark, "stream-test")
    schema = "name string, at long, payload string"

    def run(part):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(root)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
        U.run_dedupe_stream(stream, ["name"], "at", ["payload"], f"{work}/sink", f"{work}/ck")
        got = U.deduped_uploads(spark, f"{work}/sink", ["name"])
        return {(r.name, r.position, r.kept, r.copies, r.payload) for r in got.collect()}

    def plain(part):
        by = {}
        for name, at, payload in sorted(part, key=lambda r: r[1]):
            by.setdefault(name, []).append((at, payload))
        return {(k, v[0][0], v[-1][0], len(v), v[-1][1]) for k, v in by.items()}

    assert run(rows[:40]) == plain(rows[:40])
    assert run(rows[40:]) == plain(rows)
