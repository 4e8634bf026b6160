"""Golden values on a published sample (delivery performance by state and
sales by month), reduced to the rows and columns that the values need."""

from pyspark.sql import functions as F

from tessera.functions.text import locale_number
from tessera.operators import findings as C

# ---- fixed values: state, revenue, orders, late share; month, revenue, orders
STATES = [
    ("SP", "$5065369,5", 41727, "4,49%"),
    ("RJ", "$1757905,0", 12838, "12,11%"),
    ("MG", "$1551665,4", 11623, "4,56%"),
    ("AL", "$78725,7", 412, "21,46%"),
    ("AM", "$22155,8", 148, "2,76%"),
]
#: Revenue of all states together; the others are one row here.
TOTAL_REVENUE = 13221497.9
MONTHS = [
    ("2016-10", "$40325,1", 324), ("2016-11", "$0,0", None), ("2016-12", "$10,9", 1),
    ("2017-01", "$111798,4", 800), ("2017-02", "$234223,4", 1780), ("2017-03", "$359198,9", 2682),
    ("2017-04", "$340669,7", 2404), ("2018-08", "$838576,6", 6512), ("2018-09", "$0,0", 16),
    ("2018-10", "$0,0", 4),
]
# ----------------------------------------------------------------------------


def _states(spark):
    raw = spark.createDataFrame(STATES, "state string, revenue_text string, orders int, late_text string")
    listed = raw.select("state", locale_number(F.col("revenue_text")).alias("revenue"), "orders",
                        locale_number(F.col("late_text")).alias("late_rate"))
    others = listed.agg((F.lit(TOTAL_REVENUE) - F.sum("revenue")).alias("revenue")).select(
        F.lit("others").alias("state"), "revenue", F.lit(1).alias("orders"), F.lit(0.09).alias("late_rate"))
    return listed.unionByName(others)


def test_share_of_southeast(spark):
    shares = {r.state: r.share for r in C.share_of_total(_states(spark), "revenue").collect()}
    assert round(shares["SP"] + shares["RJ"] + shares["MG"], 3) == 0.633


def test_benchmark_ratio_rj_vs_sp(spark):
    out = {r.state: r.ratio for r in
           C.benchmark_ratio(_states(spark), "state", "late_rate", "revenue", "SP").collect()}
    assert round(out["RJ"], 2) == 2.70


def test_benchmark_defaults_to_largest(spark):
    row = C.benchmark_ratio(_states(spark), "state", "late_rate", "revenue").first()
    assert row.benchmark == "SP"


def test_benchmark_against_average(spark):
    rows = _states(spark).select("state", "late_rate").collect()
    mean = sum(r.late_rate for r in rows) / len(rows)
    out = {r.state: (r.benchmark, r.ratio) for r in
           C.benchmark_ratio(_states(spark), "state", "late_rate", "revenue", average=True).collect()}
    assert out["RJ"] == (None, round(next(r.late_rate for r in rows if r.state == "RJ") / mean, 6))


def test_best_late_rate_is_the_lowest(spark):
    rows = _states(spark).select("state", "late_rate").collect()
    lowest = min(rows, key=lambda r: (r.late_rate, r.state))
    top = C.worst_k(_states(spark), "state", "late_rate", "orders", 1, 0, best=True).first()
    assert (top.state, top.late_rate) == (lowest.state, lowest.late_rate)


def test_worst_late_rate_is_al(spark):
    top = C.worst_k(_states(spark), "state", "late_rate", "orders", 1, 0).first()
    assert (top.state, round(top.late_rate, 4)) == ("AL", 0.2146)


def test_value_at_risk_includes_rj(spark):
    risky = {r.state: r.revenue for r in
             C.value_at_risk(_states(spark), "state", "revenue", "late_rate", 0.12).collect()}
    assert risky["RJ"] == 1757905.0 and "SP" not in risky


def test_monthly_interruptions(spark):
    raw = spark.createDataFrame(MONTHS, "month string, revenue_text string, orders int")
    months = raw.select("month", "orders", locale_number(F.col("revenue_text")).alias("revenue"))
    kinds = {r.month: r.kind for r in C.monthly_interruptions(months, 0.5).collect()}
    assert kinds["2016-11"] == "absent"
    assert kinds["2018-09"] == "zero_revenue" and kinds["2018-10"] == "zero_revenue"


def test_growth_streak(spark):
    raw = spark.createDataFrame(MONTHS, "month string, revenue_text string, orders int")
    months = raw.select("month", locale_number(F.col("revenue_text")).alias("revenue"))
    g = {r.month: r.rise_streak for r in C.growth(months).collect()}
    # 2016-12 .. 2017-03 rise four times in a row; 2017-04 falls
    assert g["2017-03"] == 4 and g["2017-04"] == 0
