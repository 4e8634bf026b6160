"""The operators bound to the driver tables (roles of SURVEY §7.1).

Each public function takes ``(spark, sf_dir)`` and returns a lazy DataFrame;
``QUERIES`` maps the names used by ``__spark_entry__`` to them.  Parameters
(thresholds, k) are fixed here so the SQL oracle can state the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import findings as C
from tessera.operators import measures as B
from tessera.roles import Roles
from tessera.session import staging_path
from tessera.sources.tables import read_table

# fixed parameters shared with the SQL oracle
TOP_K = 5
WORST_K = 3
MIN_VOLUME = 100
RISK_THRESHOLD = 0.78
DROP_RATIO = 0.5
GAP_SECONDS = 86400


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_facts(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"))


def facts_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_state(facts(spark, sf_dir), _t(spark, sf_dir, "customer"),
                        _t(spark, sf_dir, "nation"))


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-order fact (with state) written once as parquet to a new
    folder under the shared folder, then read back.

    Queries that need several cuts of the same orders (the report, its
    checks, the impact ranking) aggregate this table instead of joining line
    items and orders again for every cut: each cut prunes different columns,
    so Spark could not reuse one exchange for all of them, and the largest
    table would be scanned once per cut.  The write also cuts the lineage:
    a lost executor re-reads stored files instead of recomputing the join.
    """
    path = staging_path(spark, "order-facts")
    facts = facts_with_state(spark, sf_dir).select(
        "o_orderkey", "o_custkey", "order_date", "month", "state", "order_units", "is_delivered", "is_canceled",
        "delivery_days", "is_late")
    facts.write.mode("overwrite").parquet(path)
    return spark.read.schema(facts.schema).parquet(path)  # known schema: no inference job


# ---- group B -------------------------------------------------------------

def kpi_general(spark, sf_dir):
    return B.kpi_general(facts(spark, sf_dir))


def state_performance(spark, sf_dir):
    return B.state_performance(facts_with_state(spark, sf_dir))


def sales_by_month(spark, sf_dir):
    return B.sales_by_month(facts(spark, sf_dir))


def sales_by_category(spark, sf_dir, category: str = "p_type"):
    return B.sales_by_category(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"),
                               _t(spark, sf_dir, "part"), category)


def satisfaction(spark, sf_dir):
    return B.satisfaction(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def kpi_cuts(spark, sf_dir):
    """The total, month and state cuts aggregate the stored fact, the category
    cut joins its flags to the items combined per order and category."""
    f = stored_facts(spark, sf_dir)
    by_category = B.category_orders(f, _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part"))
    return B.kpi_cuts(f, by_category)


def customer_cuts(spark, sf_dir):
    """B-16: distinct customers and cancellation rate per cut, from bitmaps that roll up."""
    f = stored_facts(spark, sf_dir)
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    held = (items.join(parts, items["l_partkey"] == parts["p_partkey"], "left")
            .select("l_orderkey", "category").distinct())
    orders = f.select("o_orderkey", "o_custkey", "is_canceled")
    return B.customer_cuts(f, held.join(orders, held["l_orderkey"] == orders["o_orderkey"]))


FINE = Roles(price_decimals=2, discount_decimals=3)


def revenue_fine_discounts(spark, sf_dir):
    """B-02 on discounts of three decimals (12.5 % and the like): the revenue
    by state keeps them, whatever their places, as ``Roles`` declares them."""
    items = _t(spark, sf_dir, "lineitem").withColumn(
        "l_discount", F.col("l_discount") + (F.col("l_orderkey") % 10) / 1000)
    f = B.with_state(B.order_facts(_t(spark, sf_dir, "orders"), items, FINE),
                     _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"))
    return B.state_performance(f, FINE).select("state", "orders", "revenue", "ticket")


def satisfaction_many_reviews(spark, sf_dir):
    """B-09 with several reviews per entity: every third labelled document is
    reviewed three times, once with the opposite score."""
    labels = _t(spark, sf_dir, "labels")
    again = labels.where(F.col("doc_id") % 3 == 0)
    opposite = again.withColumn("quality", 1 - F.col("quality"))
    return B.satisfaction(_t(spark, sf_dir, "documents"),
                          labels.unionByName(again).unionByName(opposite))


# ---- group C -------------------------------------------------------------

def share_of_total(spark, sf_dir):
    return C.share_of_total(state_performance(spark, sf_dir), "revenue", "revenue_share")


def top_k_concentration(spark, sf_dir):
    revenue = B.category_revenue(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"),
                                 _t(spark, sf_dir, "part"), "p_brand")
    return C.top_k_concentration(revenue, "category", "revenue", TOP_K)


def benchmark_ratio(spark, sf_dir):
    return C.benchmark_ratio(state_performance(spark, sf_dir), "state", "late_rate", "revenue")


def worst_k(spark, sf_dir):
    return C.worst_k(state_performance(spark, sf_dir), "state", "late_rate",
                     "delivered_orders", WORST_K, MIN_VOLUME)


def suppliers_by_state(spark, sf_dir) -> DataFrame:
    supplier = _t(spark, sf_dir, "supplier")
    nation = _t(spark, sf_dir, "nation")
    return (supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
            .groupBy(F.col("n_name").alias("state"))
            .agg(F.count(F.lit(1)).alias("suppliers")))


def cross_table_pattern(spark, sf_dir):
    return C.cross_table_pattern(state_performance(spark, sf_dir), suppliers_by_state(spark, sf_dir),
                                 "state", "revenue", "late_rate", "suppliers")


def pattern_missing_side(spark, sf_dir):
    """C-05 with states that have no supplier at all (every nation whose key
    is divisible by five) and orders of unknown customers (the null state)."""
    kept = suppliers_by_state(spark, sf_dir).join(
        _t(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("state")),
        "state", "left_semi")
    orders = with_unknown_customers(_t(spark, sf_dir, "orders"))
    f = B.with_state(B.order_facts(orders, _t(spark, sf_dir, "lineitem")),
                     _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation"))
    return C.cross_table_pattern(B.state_performance(f), kept, "state", "revenue", "late_rate", "suppliers")


def with_unknown_customers(orders: DataFrame) -> DataFrame:
    """Every seventh order points at a customer that does not exist."""
    return orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, -1)
                             .otherwise(F.col("o_custkey")).cast("bigint"))


def value_at_risk(spark, sf_dir):
    return C.value_at_risk(state_performance(spark, sf_dir), "state", "revenue", "late_rate",
                           RISK_THRESHOLD)


def gaps_by_user(spark, sf_dir):
    return C.gaps_by_user(_t(spark, sf_dir, "events"), "user_id", "ts", GAP_SECONDS)


def monthly_interruptions(spark, sf_dir):
    return C.monthly_interruptions(sales_by_month(spark, sf_dir), DROP_RATIO)


def growth(spark, sf_dir):
    return C.growth(sales_by_month(spark, sf_dir))


def impact_ranking(spark, sf_dir, facts: DataFrame | None = None):
    f = stored_facts(spark, sf_dir) if facts is None else facts  # state and month cuts share one fact table
    risk = C.value_at_risk(B.state_performance(f), "state", "revenue", "late_rate",
                           RISK_THRESHOLD).select(
        F.lit("late_delivery_risk").alias("kind"), F.col("state").alias("subject"),
        F.col("revenue").alias("impact"))
    top = top_k_concentration(spark, sf_dir).select(
        F.lit("revenue_concentration").alias("kind"), F.col("category").alias("subject"),
        F.col("revenue").alias("impact"))
    gaps = C.monthly_interruptions(B.sales_by_month(f), DROP_RATIO).select(
        F.lit("interruption").alias("kind"), F.col("month").alias("subject"),
        F.round(F.col("prev_revenue") - F.col("revenue"), 4).alias("impact"))
    return C.impact_ranking([risk, top, gaps])


QUERIES = {
    "kpi_general": kpi_general,
    "sales_by_month": sales_by_month,
    "state_performance": state_performance,
    "sales_by_category": sales_by_category,
    "satisfaction": satisfaction,
    "satisfaction_many_reviews": satisfaction_many_reviews,
    "revenue_fine_discounts": revenue_fine_discounts,
    "kpi_cuts": kpi_cuts,
    "customer_cuts": customer_cuts,
    "share_of_total": share_of_total,
    "top_k_concentration": top_k_concentration,
    "benchmark_ratio": benchmark_ratio,
    "worst_k": worst_k,
    "cross_table_pattern": cross_table_pattern,
    "pattern_missing_side": pattern_missing_side,
    "value_at_risk": value_at_risk,
    "gaps_by_user": gaps_by_user,
    "monthly_interruptions": monthly_interruptions,
    "growth": growth,
    "impact_ranking": impact_ranking,
}
