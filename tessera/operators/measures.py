"""Group B: business measures behind the five summary tables.

Every function maps DataFrames to a DataFrame and stays lazy.  The per-order
fact is built once: line items are aggregated per order *before* any
dimension is joined, so order counts never fan out and the line-item side is
shuffled exactly once (on the order key, which the join then reuses).
Money is exact integer arithmetic: price and discount are decimals of the
places that ``Roles`` declares, each line item is worth price * (1 - discount)
in integer units of those places, and units are summed as ``bigint`` per order
(at most a few items, no overflow).  Only group totals, which may exceed a
``bigint`` at full scale, are summed as decimals, and they run over orders, not
line items.  A double appears only in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.roles import DEFAULT, Roles


def item_units(roles: Roles = DEFAULT) -> Column:
    """Net value of one line item, price * (1 - discount), in exact integer
    units of 1 / ``roles.money_scale``."""
    one = 10 ** roles.discount_decimals
    return (_units(F.col("l_extendedprice"), roles.price_decimals)
            * (F.lit(one) - _units(F.col("l_discount"), roles.discount_decimals)))


def _units(x: Column, places: int) -> Column:
    """x in units of its last declared decimal place, as bigint (a double such
    as 0.07 is the decimal nearest to it).  Pure double arithmetic: Spark's
    round() on doubles goes through BigDecimal, which is about twice as slow
    in this per-item hot path."""
    return (F.signum(x) * F.floor(F.abs(x) * 10 ** places + 0.5)).cast("bigint")


def money_total(units: Column, roles: Roles = DEFAULT) -> Column:
    """Sum of integer money units as a double amount.  The sum is a decimal
    (a group total can exceed a bigint at full scale); the only rounding is
    the final conversion to double."""
    total = F.sum(units.cast("decimal(20,0)"))
    return F.coalesce((total / F.lit(roles.money_scale)).cast("double"), F.lit(0.0))


def order_facts(orders: DataFrame, lineitem: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """One row per order: value, delivery date, delivery days and status flags."""
    items = lineitem.groupBy("l_orderkey").agg(
        F.sum(item_units(roles)).alias("order_units"),
        F.max(F.to_date("l_shipdate")).alias("delivered_on"),
        F.count(F.lit(1)).alias("n_items"),
    )
    facts = orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.to_date("o_orderdate").alias("order_date"),
        "order_units", "delivered_on", "n_items",
    )
    delivered = F.col("o_orderstatus") == F.lit(roles.delivered_status)
    timed = delivered & F.col("delivered_on").isNotNull()
    days = F.datediff("delivered_on", "order_date")
    return facts.select(
        "*",
        delivered.alias("is_delivered"),
        (F.col("o_orderstatus") == F.lit(roles.canceled_status)).alias("is_canceled"),
        F.when(timed, days).alias("delivery_days"),
        F.when(timed, (days > F.lit(roles.promised_days)).cast("int")).alias("is_late"),
        F.date_format("order_date", "yyyy-MM").alias("month"),
    )


def customer_states(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """customer -> state name.  The nation side is a fixed 25-row dimension;
    the size-checked broadcast threshold turns this join into a broadcast."""
    return customer.select("c_custkey", "c_nationkey").join(
        nation.select(F.col("n_nationkey"), F.col("n_name").alias("state")),
        F.col("c_nationkey") == F.col("n_nationkey"), "left",
    ).select("c_custkey", "state")


def with_state(facts: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    states = customer_states(customer, nation)
    return facts.join(states, facts["o_custkey"] == states["c_custkey"], "left").drop("c_custkey")


def _kpi_aggs(roles: Roles = DEFAULT) -> list[Column]:
    delivered = F.col("is_delivered")
    return [
        F.count(F.lit(1)).alias("orders"),
        F.count(F.when(delivered, F.lit(1))).alias("delivered_orders"),
        money_total(F.when(delivered, F.col("order_units")), roles).alias("revenue"),
        F.round(F.avg("delivery_days"), 6).alias("avg_delivery_days"),
        F.round(F.avg("is_late"), 6).alias("late_rate"),
    ]


def _ticket() -> Column:
    return F.round(F.try_divide(F.col("revenue"), F.col("delivered_orders")), 6)


def kpi_general(facts: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """B-01..B-08, B-11: one row over all orders (global partial+final agg)."""
    return facts.agg(
        *_kpi_aggs(roles),
        F.count_distinct("o_custkey").alias("customers"),
        F.round(F.avg(F.col("is_canceled").cast("int")), 6).alias("cancel_rate"),
    ).withColumn("ticket", _ticket())


def kpi_cut_rows(facts: DataFrame, key: str) -> DataFrame:
    """The general KPIs and the same KPIs per ``key`` as rows of one frame,
    from one GROUPING SETS ((), (key)) aggregation (one read of the facts,
    one shuffle).  ``is_total`` marks the general row, so a null key stays
    a group of its own."""
    return (facts.groupingSets([[], [key]], key)
            .agg(*_kpi_aggs(), F.grouping_id(key).alias("_gid"))
            .withColumn("ticket", _ticket())
            .withColumn("is_total", F.col("_gid") == 1).drop("_gid"))


def state_performance(facts_with_state: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """B-13: delivery performance by state, unmatched geography kept as null."""
    return (facts_with_state.groupBy("state").agg(*_kpi_aggs(roles))
            .withColumn("ticket", _ticket()))


def sales_by_month(facts: DataFrame) -> DataFrame:
    """B-12: month spine from the first to the last month, left-joined to the
    per-month aggregate; months without orders show revenue 0 and a null
    count; orders without a date keep their own null-month row.

    The spine needs the first and last month only: each month row carries
    both (a window over the months), and the last one adds the months that
    are missing up to the next, so the facts are read once."""
    per_month = facts.groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count(F.when(F.col("is_delivered"), F.lit(1))).alias("delivered_orders"),
        money_total(F.when(F.col("is_delivered"), F.col("order_units"))).alias("revenue"),
        F.min("order_date").alias("a_day"),
    )
    here = F.trunc("a_day", "month")
    after = F.lead(here).over(Window.partitionBy(F.col("month").isNull()).orderBy("month"))
    step = F.expr("interval 1 month")
    # a month and the empty ones that follow it; a null month stands alone
    filled = per_month.withColumn("after", after).select(
        "*", F.explode(F.when(F.col("month").isNull(), F.array(F.lit(None).cast("date"))).otherwise(
            F.sequence(here, F.coalesce(F.add_months("after", -1), here), step))).alias("d"))
    own = F.col("month").isNull() | (F.date_format("d", "yyyy-MM") == F.col("month"))
    return filled.select(
        F.coalesce(F.date_format("d", "yyyy-MM"), "month").alias("month"),
        F.when(own, F.col("orders")).alias("orders"),
        F.coalesce(F.when(own, F.col("revenue")), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.when(own, F.round(F.try_divide(F.col("revenue"), F.col("delivered_orders")), 6)),
                   F.lit(0.0)).alias("ticket"),
    )


def sales_by_category(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                      category: str = "p_type", roles: Roles = DEFAULT) -> DataFrame:
    """B-14: revenue of delivered orders per category; the order count is the
    number of *distinct* orders holding the category (not a global count).

    With a broadcast part dimension (below the size threshold) line items are
    combined per (order, category) map-side before anything moves.  Beyond it,
    the raw items move once on the part key, where adaptive execution splits a
    skewed part, and are combined per (order, category) before the next
    exchange.  Either way an order with a third of all items leaves a task as
    at most one row per category.
    """
    items = lineitem.select("l_orderkey", "l_partkey", item_units(roles).alias("units"))
    parts = part.select("p_partkey", F.col(category).alias("category"))
    with_category = items.join(parts, items["l_partkey"] == parts["p_partkey"], "left")
    per_order = with_category.groupBy("l_orderkey", "category").agg(F.sum("units").alias("units"))
    status = orders.select(
        "o_orderkey",
        (F.col("o_orderstatus") == F.lit(roles.delivered_status)).cast("int").alias("delivered"))
    pairs = per_order.join(status, per_order["l_orderkey"] == status["o_orderkey"])
    agg = pairs.groupBy("category").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("delivered").alias("delivered_orders"),
        money_total(F.when(F.col("delivered") == 1, F.col("units")), roles).alias("revenue"),
    )
    return agg.withColumn("ticket", _ticket())


def category_revenue(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                     category: str = "p_type", roles: Roles = DEFAULT) -> DataFrame:
    """Revenue of delivered orders per category when no order count is
    needed (C-02).  Only delivered orders carry revenue: the status is
    filtered before the join (pushed to the scan, and Spark may derive a
    runtime filter on the line items from it), and the items are summed per
    part, then per category, both combined map-side.  Categories of the part
    table without any such item have revenue 0; items of unknown parts are
    the null category."""
    items = lineitem.select("l_orderkey", "l_partkey", item_units(roles).alias("units"))
    delivered = orders.where(F.col("o_orderstatus") == roles.delivered_status).select("o_orderkey")
    parts = part.select("p_partkey", F.col(category).alias("category"))
    units = F.sum(F.col("units").cast("decimal(20,0)"))
    paid = (items.join(delivered, items["l_orderkey"] == delivered["o_orderkey"])
            .groupBy("l_partkey").agg(units.alias("units"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select("category", "units"))
    listed = parts.select("category", F.lit(0).cast("decimal(30,0)").alias("units"))
    return paid.unionByName(listed).groupBy("category").agg(
        (F.sum("units") / F.lit(roles.money_scale)).cast("double").alias("revenue"))


def satisfaction(documents: DataFrame, labels: DataFrame,
                 score: str = "quality", negative: str = "toxic") -> DataFrame:
    """B-05, B-09, B-10, B-15: one row.  Entities are documents, reviews are
    labels; coverage = reviewed entities / all entities; the score and the
    shares are over reviews.

    Reviews are summed per entity before the join, so an entity with several
    reviews stays one entity."""
    s, neg = F.col(score).cast("double"), F.col(negative).cast("double")
    revs = labels.groupBy(F.col("doc_id").alias("r_doc_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(s).alias("score_sum"), F.count(s).alias("score_n"),
        F.sum(neg).alias("negative_sum"), F.count(neg).alias("negative_n"),
        F.sum((s == 1).cast("double")).alias("positive_sum"))
    docs = documents.select("doc_id")
    joined = docs.join(revs, docs["doc_id"] == revs["r_doc_id"], "left")
    entities, reviewed = F.count(F.lit(1)), F.count("r_doc_id")

    def share(total, n):
        return F.round(F.try_divide(F.sum(total), F.sum(n)), 6)

    return joined.agg(
        entities.alias("entities"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"),
        share("score_sum", "score_n").alias("avg_score"),
        F.round(F.try_divide(reviewed, entities), 6).alias("review_coverage"),
        share("negative_sum", "negative_n").alias("negative_share"),
        share("positive_sum", "score_n").alias("positive_share"),
    )


def kpi_cuts(facts_with_state: DataFrame, categories: DataFrame | None = None,
             roles: Roles = DEFAULT) -> DataFrame:
    """B-16: all KPIs for the total, per month and per state in one pass
    (GROUPING SETS: one shuffle instead of three), and per category from
    ``categories`` (rows of ``category_orders``, one per order and category)."""
    gid = F.grouping_id("month", "state")
    grouped = facts_with_state.groupingSets([[], ["month"], ["state"]], "month", "state")
    names = ["orders", "delivered_orders", "revenue", "avg_delivery_days", "late_rate"]
    cuts = grouped.agg(*_kpi_aggs(roles), gid.alias("_gid")).select(
        F.when(F.col("_gid") == 3, F.lit("total")).when(F.col("_gid") == 1, F.lit("month"))
        .otherwise(F.lit("state")).alias("cut"),
        F.coalesce("month", "state").alias("cut_key"), *names)
    if categories is not None:
        cuts = cuts.unionByName(categories.groupBy("category").agg(*_kpi_aggs(roles)).select(
            F.lit("category").alias("cut"), F.col("category").alias("cut_key"), *names))
    return cuts.withColumn("ticket", _ticket())


# ---- exact distinct counts that roll up -------------------------------------

POSITION_BITS = 15  # keys of one bitmap, as ``bitmap_construct_agg`` has them


def key_states(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Mergeable states of the distinct whole-number ``key`` per group: one
    bitmap of 32,768 keys per group and ``bucket``, built map-side.  Null keys
    have none; negative keys have buckets of their own."""
    k = F.col(key).cast("bigint")
    at = k.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (df.where(k.isNotNull()).groupBy(*groups, F.shiftright(k, POSITION_BITS).alias("bucket"))
            .agg(F.bitmap_construct_agg(at).alias("bits")))


def distinct_counts(states: DataFrame, cuts: list[str], name: str) -> DataFrame:
    """Exact distinct counts in total and per column of ``cuts``, all from the
    states: bitmaps are united, never the rows counted again.  Rows ``cut`` (the
    column's name or ``total``), ``cut_key`` (text) and ``name``."""
    sets = [["bucket"], *[["bucket", c] for c in cuts]]
    which = F.lit("total")
    key = F.lit(None).cast("string")
    for c in cuts:
        here = F.col(f"_g_{c}") == 0
        which, key = F.when(here, F.lit(c)).otherwise(which), F.when(here, F.col(c).cast("string")).otherwise(key)
    united = states.groupingSets(sets, "bucket", *cuts).agg(
        F.bitmap_or_agg("bits").alias("bits"), *[F.grouping(c).alias(f"_g_{c}") for c in cuts])
    return (united.select(which.alias("cut"), key.alias("cut_key"), F.bitmap_count("bits").alias("n"))
            .groupBy("cut", "cut_key").agg(F.sum("n").cast("bigint").alias(name)))


def customer_cuts(facts_with_state: DataFrame, categories: DataFrame) -> DataFrame:
    """B-16: distinct customers and cancellation rate for the total, each month,
    state and category.  ``categories`` has one row per order and category.

    Month, state and total come from one set of states per (month, state).
    Counts and rates have one row per cut each: they are stacked and folded by
    one aggregation, so a null month, state or category stays a cut."""
    customers = distinct_counts(key_states(facts_with_state, ["month", "state"], "o_custkey"),
                                ["month", "state"], "customers")
    by_category = distinct_counts(key_states(categories, ["category"], "o_custkey"), ["category"], "customers")
    gid = F.grouping_id("month", "state")
    rate = [F.count(F.lit(1)).alias("orders"), F.round(F.avg(F.col("is_canceled").cast("int")), 6).alias("cancel_rate")]
    rates = (facts_with_state.groupingSets([[], ["month"], ["state"]], "month", "state").agg(*rate, gid.alias("g"))
             .select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "month").otherwise("state").alias("cut"),
                     F.coalesce("month", "state").alias("cut_key"), "orders", "cancel_rate"))
    rates = rates.unionByName(categories.groupBy("category").agg(*rate).select(
        F.lit("category").alias("cut"), F.col("category").alias("cut_key"), "orders", "cancel_rate"))
    counted = customers.unionByName(by_category.where("cut = 'category'"))
    return (rates.unionByName(counted, allowMissingColumns=True).groupBy("cut", "cut_key")
            .agg(F.max("orders").alias("orders"), F.coalesce(F.max("customers"), F.lit(0).cast("bigint")).alias("customers"),
                 F.max("cancel_rate").alias("cancel_rate")))


def category_orders(facts: DataFrame, lineitem: DataFrame, part: DataFrame,
                    category: str = "p_type", roles: Roles = DEFAULT) -> DataFrame:
    """One row per order and category held by it: the order's flags and days,
    and the value of its items of that category."""
    items = lineitem.select("l_orderkey", "l_partkey", item_units(roles).alias("units"))
    parts = part.select("p_partkey", F.col(category).alias("category"))
    per_order = (items.join(parts, items["l_partkey"] == parts["p_partkey"], "left")
                 .groupBy("l_orderkey", "category").agg(F.sum("units").alias("order_units")))
    flags = facts.select("o_orderkey", "is_delivered", "delivery_days", "is_late")
    return per_order.join(flags, per_order["l_orderkey"] == flags["o_orderkey"]).drop("l_orderkey")
