"""Invariants and partition independence on the small driver tables."""

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import findings as C
from tessera.plans import context, driver, ingest, reports


def test_shares_sum_to_one(spark, sf_small):
    total = driver.share_of_total(spark, sf_small).agg(F.sum("revenue_share")).first()[0]
    assert abs(total - 1.0) < 1e-4


def test_cuts_reconcile(spark, sf_small):
    flags = {(r.check, r.subject): r.flag for r in reports.data_limits(spark, sf_small).collect()}
    assert not any(v for (check, _), v in flags.items() if check in ("cut_total", "order_total"))


def test_rendered_lines_bounded(spark, sf_small):
    for r in context.context_per_group(spark, sf_small).collect():
        body = r.context.split("--- | --- | --- | --- | --- | ---\n", 1)[1]
        lines = [x for x in body.split("\n") if x and not x.startswith("Observação")]
        assert len(lines) == min(r.rows, 35)


def test_accepted_plus_rejected_is_all(spark, sf_small):
    v = ingest.ingest_validate(spark, sf_small)
    n = v.count()
    acc = v.where("accepted").count()
    rej = v.where("not accepted").count()
    assert acc + rej == n and rej > 0 and acc > 0


def test_generated_report_passes_its_checks(spark, sf_small):
    sec = reports.report_sections(spark, sf_small).first()
    assert sec.exact and sec.in_order and sec.missing == []
    grounded = reports.report_grounding(spark, sf_small).agg(F.min(F.col("grounded").cast("int"))).first()[0]
    assert grounded == 1


def _collect_sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_partition_independence(spark, sf_small):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = [_collect_sorted(f(spark, sf_small)) for f in
               (driver.state_performance, driver.kpi_cuts, context.first_n_per_group)]
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = [_collect_sorted(f(spark, sf_small).repartition(8)) for f in
                 (driver.state_performance, driver.kpi_cuts, context.first_n_per_group)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight


def _brute_gaps(pdf, gap_seconds):
    """Consecutive gaps per user in plain pandas (rows without a time count
    as events but make no gap)."""
    pdf = pdf.sort_values(["user_id", "ts", "event_id"])
    pdf["gap"] = pdf.groupby("user_id")["ts"].diff().dt.total_seconds() * 1_000_000
    out = {}
    for u, g in pdf.groupby("user_id"):
        m = g["gap"].max()
        out[u] = (len(g), None if pd.isna(m) else int(m), int((g["gap"] > gap_seconds * 1_000_000).sum()))
    return out


def test_gaps_with_hot_user_match_brute_force(spark):
    """A user holding most events, spread over many range partitions,
    against a plain pandas computation of consecutive gaps; ties on the
    timestamp are ordered by the event id."""
    rows = []
    eid = 0
    for day in range(20):
        for i in range(50):  # hot user: 50 events a day
            rows.append((eid, pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, minutes=i * 7), 1))
            eid += 1
        if day % 5 == 0:
            rows.append((eid, pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, hours=5), 2))
            eid += 1
            # same instant twice for the hot user: the tie-break decides the order
            rows.append((eid, pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, minutes=7), 1))
            eid += 1
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.user_id: (r.events, r.max_gap_us, r.long_gaps)
           for r in C.gaps_by_user(df, "user_id", "ts", 3600, partitions=27).collect()}
    pdf = pdf.sort_values(["user_id", "ts", "event_id"])
    pdf["gap"] = pdf.groupby("user_id")["ts"].diff().dt.total_seconds() * 1_000_000
    want = {u: (len(g), int(g["gap"].max()), int((g["gap"] > 3600 * 1_000_000).sum()))
            for u, g in pdf.groupby("user_id")}
    assert got == want


def test_gaps_with_clustered_hot_user_and_ties(spark):
    """The hot user's events sit mostly in one ten-second burst, many at the
    very same instant, plus rows without a time; a single event user and
    a user with only ties.  The range partitions split the burst; the
    result equals the brute force."""
    base = pd.Timestamp("2024-03-01")
    rows, eid = [], 0

    def add(ts, user):
        nonlocal eid
        rows.append((eid, ts, user))
        eid += 1

    for i in range(1500):  # burst: 1,500 events in ten seconds, ties every third
        add(base + pd.Timedelta(milliseconds=(i // 3) * 20), 1)
    for d in range(1, 40):  # the same user's sparse tail over weeks
        add(base + pd.Timedelta(days=d, minutes=d), 1)
    add(None, 1)
    add(None, 1)
    add(base, 2)  # one event: no gap
    for _ in range(4):  # only ties: gap zero
        add(base + pd.Timedelta(hours=3), 3)
    for h in (0, 5, 6, 30):
        add(base + pd.Timedelta(hours=h), 4)
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = _brute_gaps(pdf, 3600)
    for parts in (1, 7, 40):
        got = {r.user_id: (r.events, r.max_gap_us, r.long_gaps)
               for r in C.gaps_by_user(df, "user_id", "ts", 3600, partitions=parts).collect()}
        assert got == want, parts


def test_partition_independence_of_rewritten_plans(spark, sf_small):
    """The one-pass report, the per-category top-k, range-partitioned gaps
    and stored-fact checks give the same rows with 1 and 8 shuffle
    partitions."""
    fns = (reports.report, driver.top_k_concentration, driver.gaps_by_user, reports.data_limits)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = [_collect_sorted(f(spark, sf_small)) for f in fns]
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = [_collect_sorted(f(spark, sf_small)) for f in fns]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight
