"""Plan-shape checks for the properties the engine relies on at scale, taken
from the final adaptive plans with broadcasting disabled (every join
shuffles, as for the large tables at 100 TB)."""

import re
from collections import Counter

import pytest

from tessera.plans import context as CX
from tessera.plans import driver as P
from tessera.plans import reports as RPL
from tessera.session import SQL_SETTINGS, configure

THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture()
def no_broadcast(spark):
    for key in THRESHOLDS:
        spark.conf.set(key, "-1")
    yield configure(spark)  # which leaves the thresholds of its session as they are
    for key in THRESHOLDS:
        assert spark.conf.get(key) == "-1"
        spark.conf.set(key, SQL_SETTINGS[key])


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def _scans(plan: str) -> Counter:
    return Counter(re.findall(r"FileScan parquet [^\n]*?/(\w+)\.parquet\]", plan))


def test_line_items_combine_before_they_move(no_broadcast, sf_small):
    plan = _final_plan(P.sales_by_category(no_broadcast, sf_small))
    assert "REPARTITION_BY" not in plan and "RoundRobinPartitioning" not in plan
    # the (order, category) sums are partial aggregates below their exchange
    assert re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, category#\d+[^\n]*\n[^\n]*"
                     r"HashAggregate\(keys=\[l_orderkey#\d+L, category#\d+\], functions=\[partial_sum",
                     plan)
    assert _scans(plan)["lineitem"] == 1


def test_report_reads_each_table_once(no_broadcast, sf_small):
    plan = _final_plan(RPL.report(no_broadcast, sf_small))
    scans = _scans(plan)
    assert scans["lineitem"] == 1 and scans["orders"] == 1, scans


def test_data_limits_reads_line_items_once_per_grain(no_broadcast, sf_small):
    # order cuts aggregate the stored fact; the category cut reads line items itself
    plan = _final_plan(RPL.data_limits(no_broadcast, sf_small))
    assert _scans(plan)["lineitem"] == 1


def test_gaps_use_range_partitions_not_one_window_per_user(no_broadcast, sf_small):
    plan = _final_plan(P.gaps_by_user(no_broadcast, sf_small))
    assert "rangepartitioning(user" in plan
    # the per-user window only runs over one summary row per (user, partition)
    assert re.search(r"Window \[lag\(last_t", plan)


def test_item_ranges_stay_in_the_document_row(no_broadcast, sf_small):
    plan = _final_plan(RPL.item_ranges(no_broadcast, sf_small))
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert "Exchange " not in plan


def test_raw_items_move_once_on_the_part_key(no_broadcast, sf_small):
    """Without a broadcast part table the items move before they combine, once."""
    plan = _final_plan(P.sales_by_category(no_broadcast, sf_small))
    assert len(re.findall(r"Exchange hashpartitioning\(l_partkey#\d+L", plan)) == 1


def test_months_read_the_orders_once(no_broadcast, sf_small):
    assert _scans(_final_plan(P.sales_by_month(no_broadcast, sf_small)))["orders"] == 1


def test_preview_scans_nothing(no_broadcast, sf_small):
    assert not _scans(_final_plan(CX.column_preview(no_broadcast, sf_small)))


def test_context_joins_once(no_broadcast, sf_small):
    plan = _final_plan(CX.context_per_group(no_broadcast, sf_small))
    assert "SortMergeJoin" not in plan  # over the stored join; totals and lines are stacked


def test_top_k_filters_the_status_and_sums_per_part(no_broadcast, sf_small):
    plan = _final_plan(P.top_k_concentration(no_broadcast, sf_small))
    assert "keys=[l_orderkey" not in plan  # no (order, category) grain
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan)
    assert re.search(r"HashAggregate\(keys=\[l_partkey#\d+L\], functions=\[partial_sum", plan)
    assert re.search(r"HashAggregate\(keys=\[category#\d+\], functions=\[partial_sum", plan)
    assert _scans(plan)["lineitem"] == 1


def test_context_totals_read_one_column_of_the_orders(no_broadcast, sf_small):
    plan = _final_plan(CX.orders_per_state(no_broadcast, sf_small))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan
    assert re.search(r"HashAggregate\(keys=\[o_custkey#\d+L\], functions=\[partial_count", plan)


def test_context_per_state_reads_wide_rows_below_a_limit_per_group(no_broadcast, sf_small):
    plan = _final_plan(CX.context_per_state(no_broadcast, sf_small))
    assert "WindowGroupLimit" in plan and _scans(plan)["orders"] == 2
