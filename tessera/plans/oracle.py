"""Independent DuckDB SQL for every query in ``driver.QUERIES``.

Written from the operator definitions, not generated from the Spark plans.
Shared CTEs are plain strings so each query stays readable on its own.
"""

from __future__ import annotations

from tessera.plans import driver as P

#: price * (1 - discount) as exact decimals, without rounding
ITEM_UNITS = ("CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS DECIMAL(25,4)) * "
              "(1 - CAST(l_discount AS DECIMAL(9,4)))")


def money(units_expr: str) -> str:
    """Exact decimal sum as a double amount."""
    return f"coalesce(CAST(sum({units_expr}) AS DOUBLE), 0.0)"


FACTS = f"""
items AS (
  SELECT l_orderkey, sum({ITEM_UNITS}) AS order_units,
         max(CAST(l_shipdate AS DATE)) AS delivered_on
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus,
         CAST(o.o_orderdate AS DATE) AS order_date, i.order_units, i.delivered_on,
         o.o_orderstatus = 'F' AS is_delivered,
         o.o_orderstatus = 'P' AS is_canceled,
         CASE WHEN o.o_orderstatus = 'F' AND i.delivered_on IS NOT NULL
              THEN date_diff('day', CAST(o.o_orderdate AS DATE), i.delivered_on) END AS delivery_days,
         CASE WHEN o.o_orderstatus = 'F' AND i.delivered_on IS NOT NULL
              THEN CAST(date_diff('day', CAST(o.o_orderdate AS DATE), i.delivered_on) > 30 AS INTEGER)
         END AS is_late,
         strftime(CAST(o.o_orderdate AS DATE), '%Y-%m') AS month
  FROM orders o LEFT JOIN items i ON o.o_orderkey = i.l_orderkey),
fs AS (
  SELECT f.*, n.n_name AS state FROM facts f
  LEFT JOIN customer c ON f.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

KPI_COLS = f"""
  count(*) AS orders,
  count(CASE WHEN is_delivered THEN 1 END) AS delivered_orders,
  {money("CASE WHEN is_delivered THEN order_units END")} AS revenue,
  round(avg(delivery_days), 6) AS avg_delivery_days,
  round(avg(is_late), 6) AS late_rate"""

TICKET = "round(revenue / nullif(delivered_orders, 0), 6) AS ticket"

STATE_PERF_TAIL = f"""
sp0 AS (SELECT state, {KPI_COLS} FROM fs GROUP BY state),
sp AS (SELECT *, {TICKET} FROM sp0)"""
STATE_PERF = f"{FACTS},{STATE_PERF_TAIL}"

BY_MONTH_TAIL = f"""
per_month AS (
  SELECT month, count(*) AS orders,
         count(CASE WHEN is_delivered THEN 1 END) AS delivered_orders,
         CAST(sum(CASE WHEN is_delivered THEN order_units END) AS DOUBLE) AS revenue
  FROM facts GROUP BY month),
spine AS (
  SELECT strftime(d, '%Y-%m') AS month FROM (
    SELECT unnest(generate_series(date_trunc('month', min(order_date)),
                                  date_trunc('month', max(order_date)),
                                  INTERVAL 1 MONTH)) AS d FROM facts)),
bm AS (
  SELECT coalesce(s.month, p.month) AS month, p.orders,
         coalesce(p.revenue, 0.0) AS revenue,
         coalesce(round(p.revenue / nullif(p.delivered_orders, 0), 6), 0.0) AS ticket
  FROM spine s FULL OUTER JOIN per_month p ON s.month = p.month)"""
BY_MONTH = f"{FACTS},{BY_MONTH_TAIL}"


def _by_category(category: str) -> str:
    return f"""
cat_rows AS (
  SELECT l.l_orderkey, p.{category} AS category, {ITEM_UNITS} AS units, o.o_orderstatus
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey),
cat_order AS (
  SELECT category, l_orderkey, sum(units) AS units,
         max(CAST(o_orderstatus = 'F' AS INTEGER)) AS delivered
  FROM cat_rows GROUP BY category, l_orderkey),
cat0 AS (
  SELECT category, count(*) AS orders, CAST(sum(delivered) AS BIGINT) AS delivered_orders,
         {money("CASE WHEN delivered = 1 THEN units END")} AS revenue
  FROM cat_order GROUP BY category),
sc AS (SELECT *, {TICKET} FROM cat0)"""


EXACT_TOTAL = "CAST(sum(CAST(revenue AS DECIMAL(38,4))) OVER () AS DOUBLE)"

SQL: dict[str, str] = {}

SQL["kpi_general"] = f"""WITH {FACTS},
k AS (SELECT {KPI_COLS}, count(DISTINCT o_custkey) AS customers,
             round(avg(CAST(is_canceled AS INTEGER)), 6) AS cancel_rate FROM facts)
SELECT *, {TICKET} FROM k"""

SQL["state_performance"] = f"WITH {STATE_PERF} SELECT * FROM sp"

SQL["sales_by_month"] = f"WITH {BY_MONTH} SELECT * FROM bm"

SQL["sales_by_category"] = f"WITH {_by_category('p_type')} SELECT * FROM sc"

def _satisfaction(reviews: str) -> str:
    return f"""
WITH r AS ({reviews}),
d AS (SELECT count(*) AS entities, count(CASE WHEN doc_id IN (SELECT doc_id FROM r) THEN 1 END) AS reviewed
      FROM documents),
l AS (SELECT count(*) AS reviews, round(avg(CAST(quality AS DOUBLE)), 6) AS avg_score,
             round(avg(CAST(toxic AS DOUBLE)), 6) AS negative_share,
             round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS positive_share
      FROM r WHERE doc_id IN (SELECT doc_id FROM documents))
SELECT entities, reviews, avg_score, round(reviewed / entities, 6) AS review_coverage,
       negative_share, positive_share
FROM d, l"""


SQL["satisfaction"] = _satisfaction("SELECT doc_id, quality, toxic FROM labels")

SQL["satisfaction_many_reviews"] = _satisfaction("""
  SELECT doc_id, quality, toxic FROM labels
  UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels WHERE doc_id % 3 = 0""")

FINE_FACTS = FACTS.replace("FROM lineitem", "FROM (SELECT * REPLACE (CAST(l_discount AS DECIMAL(9,4)) "
                           "+ CAST(l_orderkey % 10 AS DECIMAL(9,4)) / 1000 AS l_discount) FROM lineitem)")

SQL["revenue_fine_discounts"] = f"""WITH {FINE_FACTS},{STATE_PERF_TAIL}
SELECT state, orders, revenue, ticket FROM sp"""

SQL["kpi_cuts"] = f"""WITH {FACTS},
cat_pairs AS (
  SELECT p.p_type AS category, l.l_orderkey, sum({ITEM_UNITS}) AS order_units
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL),
cat_facts AS (
  SELECT c.category, c.order_units, f.is_delivered, f.delivery_days, f.is_late
  FROM cat_pairs c JOIN facts f ON c.l_orderkey = f.o_orderkey),
cuts AS (
  SELECT CASE WHEN grouping(month) = 1 AND grouping(state) = 1 THEN 'total'
              WHEN grouping(month) = 0 THEN 'month' ELSE 'state' END AS cut,
         coalesce(month, state) AS cut_key, {KPI_COLS}
  FROM fs GROUP BY GROUPING SETS ((), (month), (state))
  UNION ALL SELECT 'category', category, {KPI_COLS} FROM cat_facts GROUP BY category)
SELECT *, {TICKET} FROM cuts"""

SQL["customer_cuts"] = f"""WITH {FACTS},
held AS (SELECT DISTINCT l.l_orderkey, p.p_type AS category
         FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
keyed AS (
  SELECT 'total' AS cut, CAST(NULL AS VARCHAR) AS cut_key, o_custkey, is_canceled FROM fs
  UNION ALL SELECT 'month', month, o_custkey, is_canceled FROM fs
  UNION ALL SELECT 'state', state, o_custkey, is_canceled FROM fs
  UNION ALL SELECT 'category', h.category, f.o_custkey, f.is_canceled
  FROM held h JOIN fs f ON h.l_orderkey = f.o_orderkey)
SELECT cut, cut_key, count(*) AS orders, count(DISTINCT o_custkey) AS customers,
       round(avg(CAST(is_canceled AS INTEGER)), 6) AS cancel_rate
FROM keyed GROUP BY cut, cut_key"""

SQL["share_of_total"] = f"""WITH {STATE_PERF}
SELECT *, round(revenue / {EXACT_TOTAL}, 6) AS revenue_share FROM sp"""

SQL["top_k_concentration"] = f"""WITH {_by_category('p_brand')},
r AS (
  SELECT category, revenue,
         CAST(row_number() OVER (ORDER BY revenue DESC, category) AS BIGINT) AS rank,
         round(revenue / {EXACT_TOTAL}, 6) AS share,
         round(CAST(sum(CAST(revenue AS DECIMAL(38,4))) OVER (
                 ORDER BY revenue DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS DOUBLE) / {EXACT_TOTAL}, 6) AS cum_share
  FROM sc)
SELECT * FROM r WHERE rank <= {P.TOP_K}"""

SQL["benchmark_ratio"] = f"""WITH {STATE_PERF},
b AS (SELECT state AS benchmark, late_rate AS benchmark_value FROM sp
      ORDER BY revenue DESC, state DESC LIMIT 1)
SELECT sp.state, sp.late_rate, b.benchmark, b.benchmark_value,
       round(sp.late_rate / nullif(b.benchmark_value, 0), 6) AS ratio
FROM sp, b"""

SQL["worst_k"] = f"""WITH {STATE_PERF},
r AS (SELECT state, late_rate, delivered_orders,
             CAST(row_number() OVER (ORDER BY late_rate DESC, state) AS BIGINT) AS rank
      FROM sp WHERE delivered_orders >= {P.MIN_VOLUME} AND late_rate IS NOT NULL)
SELECT * FROM r WHERE rank <= {P.WORST_K}"""

def _pattern(suppliers: str) -> str:
    return f"""
sup AS (SELECT n.n_name AS state, count(*) AS suppliers
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey {suppliers} GROUP BY n.n_name),
j AS (SELECT sp.state, sp.revenue, sp.late_rate, coalesce(sup.suppliers, 0) AS suppliers
      FROM sp LEFT JOIN sup ON sp.state IS NOT DISTINCT FROM sup.state),
f AS (SELECT *, revenue >= avg(revenue) OVER () AS high_revenue,
              late_rate >= avg(late_rate) OVER () AS high_late_rate,
              suppliers < avg(suppliers) OVER () AS low_suppliers FROM j)
SELECT *, high_revenue AND high_late_rate AND low_suppliers AS pattern FROM f"""


SQL["cross_table_pattern"] = f"WITH {STATE_PERF}, {_pattern('')}"

UNKNOWN_CUSTOMERS = ("(SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS o_custkey) "
                     "FROM orders)")
UNKNOWN_STATE_PERF = STATE_PERF.replace("FROM orders o", f"FROM {UNKNOWN_CUSTOMERS} o")

SQL["pattern_missing_side"] = f"WITH {UNKNOWN_STATE_PERF}, {_pattern('WHERE n.n_nationkey % 5 <> 0')}"

SQL["value_at_risk"] = f"""WITH {STATE_PERF},
r AS (SELECT state, revenue, late_rate FROM sp WHERE late_rate > {P.RISK_THRESHOLD})
SELECT *, {EXACT_TOTAL} AS value_at_risk FROM r"""

SQL["gaps_by_user"] = f"""
WITH g AS (
  SELECT user_id,
         epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us
  FROM events)
SELECT user_id, count(*) AS events, max(gap_us) AS max_gap_us,
       count(CASE WHEN gap_us > {P.GAP_SECONDS * 1_000_000} THEN 1 END) AS long_gaps
FROM g GROUP BY user_id"""

MONTHLY_INTERRUPTIONS = f"""
mi0 AS (SELECT month, orders, revenue, lag(revenue) OVER (ORDER BY month) AS prev_revenue
        FROM bm WHERE month IS NOT NULL),
mi AS (SELECT *, CASE WHEN orders IS NULL THEN 'absent'
                      WHEN revenue = 0 THEN 'zero_revenue'
                      WHEN revenue < prev_revenue * {P.DROP_RATIO} THEN 'drop' END AS kind
       FROM mi0)"""

SQL["monthly_interruptions"] = f"""WITH {BY_MONTH}, {MONTHLY_INTERRUPTIONS}
SELECT * FROM mi WHERE kind IS NOT NULL"""

SQL["growth"] = f"""WITH {BY_MONTH},
m AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev_revenue
      FROM bm WHERE month IS NOT NULL),
b AS (SELECT *, round(revenue - prev_revenue, 4) AS change,
             round((revenue - prev_revenue) / nullif(prev_revenue, 0), 6) AS pct_change,
             coalesce(CAST(revenue > prev_revenue AS INTEGER), 0) AS rise FROM m),
c AS (SELECT *, sum(1 - rise) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS island FROM b)
SELECT month, revenue, prev_revenue, change, pct_change,
       CAST(sum(rise) OVER (PARTITION BY island ORDER BY month
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rise_streak
FROM c"""

SQL["impact_ranking"] = f"""WITH {STATE_PERF},{BY_MONTH_TAIL},
{_by_category('p_brand')}, {MONTHLY_INTERRUPTIONS},
risk AS (SELECT 'late_delivery_risk' AS kind, state AS subject, revenue AS impact
         FROM sp WHERE late_rate > {P.RISK_THRESHOLD}),
top AS (SELECT 'revenue_concentration' AS kind, category AS subject, revenue AS impact FROM (
          SELECT category, revenue, row_number() OVER (ORDER BY revenue DESC, category) AS rk FROM sc)
        WHERE rk <= {P.TOP_K}),
gaps AS (SELECT 'interruption' AS kind, month AS subject, round(prev_revenue - revenue, 4) AS impact
         FROM mi WHERE kind IS NOT NULL),
u AS (SELECT * FROM risk UNION ALL SELECT * FROM top UNION ALL SELECT * FROM gaps)
SELECT kind, subject, impact,
       CAST(row_number() OVER (ORDER BY impact DESC, kind, subject) AS BIGINT) AS rank,
       CAST(row_number() OVER (PARTITION BY kind ORDER BY impact DESC, subject) AS BIGINT) AS rank_in_kind
FROM u"""
