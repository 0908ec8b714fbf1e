"""DuckDB SQL that states every mart and report directly, to check the Spark plans against.

The statements follow the definitions (joins with the calendar, self-joins, one distinct
count per measure) rather than the plans. Ratios divide exact integers or decimals; the few
measures that add up inexact doubles are rounded here and in the registry alike.
"""

from __future__ import annotations

from aftershock.specs import CohortSpec, PhaseSpec, Span

# Base tables from the TPC-H-shaped ones, as stated in FIXTURES.md §2.
ADAPTER = """
order_line AS (
  SELECT l_orderkey AS order_id, MIN(l_suppkey) AS restaurant_id,
         MIN(l_linenumber) AS first_line, MAX(l_quantity) AS max_quantity
  FROM lineitem GROUP BY l_orderkey
),
fact_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, line.restaurant_id,
         o_orderdate AS order_timestamp,
         CAST(o_totalprice AS DECIMAL(18,4)) AS subtotal_amount,
         CAST(0 AS DECIMAL(18,4)) AS discount_amount,
         CAST(0 AS DECIMAL(18,4)) AS delivery_fee,
         CAST(o_totalprice AS DECIMAL(18,4)) AS total_amount,
         CASE o_orderstatus WHEN 'P' THEN 'Y' ELSE 'N' END AS is_cancelled
  FROM orders LEFT JOIN order_line AS line ON line.order_id = o_orderkey
),
fact_order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS menu_item_id, l_quantity AS quantity,
         l_extendedprice AS line_amount
  FROM lineitem
),
fact_delivery_performance AS (
  SELECT order_id, CAST(25 + 5 * first_line AS INTEGER) AS expected_delivery_time_mins,
         CAST(25 + 5 * first_line + CAST(max_quantity AS INTEGER) - 30 AS INTEGER) AS actual_delivery_time_mins
  FROM order_line
),
fact_ratings AS (
  SELECT CASE WHEN filled THEN event_id END AS order_id,
         CASE WHEN filled THEN user_id END AS customer_id,
         CASE WHEN filled THEN CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3
              WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 END AS DOUBLE) END AS rating,
         CASE WHEN filled THEN (event_id % 21) / 20.0E0 END AS sentiment_score,
         CASE WHEN filled THEN ts END AS review_timestamp
  FROM (SELECT *, event_id % 50 <> 0 AS filled FROM events)
),
dim_restaurant AS (
  SELECT s_suppkey AS restaurant_id, s_name AS restaurant_name, n_name AS city, r_name AS partner_type,
         CAST(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS is_active,
         CASE s_suppkey % 6 WHEN 0 THEN '0-15' WHEN 1 THEN '16-25' WHEN 2 THEN '26-40'
              WHEN 3 THEN '>40' WHEN 4 THEN '18' ELSE 'n/a' END AS avg_prep_time_min
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
)"""


def half_up(numerator: str, denominator: str, digits: int, result: str, unit_digits: int = 0) -> str:
    """Exact non-negative integer ratio, rounded half up to ``digits`` decimals.

    ``unit_digits``: the numerator counts units of that many decimals.
    """
    scaled = f"CAST({numerator} AS HUGEINT) * {10 ** (digits - unit_digits)}"
    whole = f"(2 * ({scaled}) + {denominator}) // NULLIF(2 * CAST({denominator} AS HUGEINT), 0)"
    return f"CAST(CAST({whole} AS DECIMAL(30,0)) * CAST(1e-{digits} AS DECIMAL({digits + 1},{digits})) AS {result})"


def units(money: str, digits: int) -> str:
    """Money as a whole number of its smallest unit."""
    return f"CAST(CAST({money} AS DECIMAL(30,{digits})) * CAST({10 ** digits} AS DECIMAL(5,0)) AS HUGEINT)"


def ratio(numerator: str, denominator: str) -> str:
    return f"CAST({numerator} AS DOUBLE) / NULLIF(CAST({denominator} AS DOUBLE), 0)"


def total(expression: str) -> str:
    return f"CAST(SUM({expression}) AS BIGINT)"


def money(expression: str) -> str:
    return f"CAST(SUM({expression}) AS DECIMAL(38,4))"


KEPT = "is_cancelled = 'N'"
LOST = "is_cancelled = 'Y'"
MONTHS = "month_start_date, phase"
PREP = """CASE avg_prep_time_min WHEN '0-15' THEN 7.5E0 WHEN '16-25' THEN 20.5E0 WHEN '26-40' THEN 33E0
          WHEN '>40' THEN 45E0 ELSE TRY_CAST(avg_prep_time_min AS DOUBLE) END"""


def calendar(phases: PhaseSpec) -> str:
    return f"""
dim_date AS (
  SELECT day AS date, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, monthname(day) AS month_name,
         CAST(date_trunc('month', day) AS DATE) AS month_start_date, strftime(day, '%Y-%m') AS year_month,
         CAST(dayofweek(day) + 1 AS INTEGER) AS day_of_week, dayname(day) AS day_name,
         CAST(CASE WHEN dayname(day) IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
         CASE WHEN day < DATE '{phases.crisis_start}' THEN 'pre'
              WHEN day < DATE '{phases.post_start}' THEN 'crisis' ELSE 'post' END AS phase
  FROM (SELECT DISTINCT CAST(order_timestamp AS DATE) AS day FROM fact_orders)
  WHERE day IS NOT NULL
),
dated AS (
  SELECT o.*, d.* FROM fact_orders AS o JOIN dim_date AS d ON d.date = CAST(o.order_timestamp AS DATE)
),
weekly_dated AS (
  SELECT *, CAST(date_trunc('week', date + INTERVAL 1 DAY) AS DATE) AS week_start_date FROM dated
)"""


def quality() -> str:
    tables = ["fact_order_items", "fact_delivery_performance", "fact_orders", "fact_ratings", "clean_fact_ratings"]
    audit = "\n  UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) - COUNT(order_id) AS null_rows FROM {t}" for t in tables
    )
    return f"""
clean_fact_ratings AS (
  SELECT * FROM fact_ratings
  WHERE COALESCE(CAST(order_id AS VARCHAR), CAST(rating AS VARCHAR),
                 CAST(review_timestamp AS VARCHAR), CAST(customer_id AS VARCHAR)) IS NOT NULL
),
null_key_audit AS (
  {audit}
)"""


def monthly() -> str:
    return f"""
monthly_order AS (
  SELECT {MONTHS}, COUNT(order_id) AS total_orders,
         {money(f"CASE WHEN {KEPT} THEN total_amount ELSE 0 END")} AS total_revenue,
         {ratio(f"SUM(total_amount) FILTER (WHERE {KEPT})", f"COUNT(total_amount) FILTER (WHERE {KEPT})")} AS average_order_value,
         COUNT(*) FILTER (WHERE {LOST}) AS total_cancelled_order,
         COUNT(*) FILTER (WHERE {KEPT}) AS total_non_cancelled_order
  FROM dated GROUP BY ALL
),
monthly_active_customer AS (
  SELECT {MONTHS}, COUNT(DISTINCT customer_id) AS active_customer,
         COUNT(DISTINCT customer_id) FILTER (WHERE {KEPT}) AS active_customer_non_cancel
  FROM dated GROUP BY ALL
),
delivery_performance_summary AS (
  SELECT {MONTHS}, COUNT(*) AS deliveries,
         {ratio("SUM(expected_delivery_time_mins)", "COUNT(expected_delivery_time_mins)")} AS avg_expected_time_min,
         {ratio("SUM(actual_delivery_time_mins)", "COUNT(actual_delivery_time_mins)")} AS avg_actual_time_min,
         ROUND({ratio("SUM(actual_delivery_time_mins - expected_delivery_time_mins)",
                      "COUNT(actual_delivery_time_mins - expected_delivery_time_mins)")}, 5) AS diff_minutes_decimal,
         {ratio("COUNT(*) FILTER (WHERE actual_delivery_time_mins > expected_delivery_time_mins)", "COUNT(*)")} AS late_rate
  FROM dated JOIN fact_delivery_performance USING (order_id) WHERE {KEPT} GROUP BY ALL
),
rated AS (
  SELECT dated.* EXCLUDE (customer_id), r.rating, r.sentiment_score
  FROM dated JOIN fact_ratings AS r ON r.order_id = dated.order_id
),
rating_summary AS (
  SELECT {MONTHS}, {ratio("SUM(rating)", "COUNT(rating)")} AS avg_rating, COUNT(rating) AS total_rating,
         {ratio("COUNT(*) FILTER (WHERE rating <= 2)", "COUNT(*)")} AS low_rating_rate,
         {ratio("COUNT(*) FILTER (WHERE rating = 5)", "COUNT(*)")} AS five_start_rating,
         {ratio("COUNT(*) FILTER (WHERE rating = 1)", "COUNT(*)")} AS one_start_rating,
         {ratio("COUNT(*) FILTER (WHERE rating = 5)", "COUNT(*)")}
           - {ratio("COUNT(*) FILTER (WHERE rating = 1)", "COUNT(*)")} AS net_rating,
         AVG(sentiment_score) AS avg_sentiment
  FROM rated GROUP BY ALL
),
restaurant_activity_summary AS (
  SELECT {MONTHS}, partner_type, COUNT(DISTINCT restaurant_id) AS monthly_active_restaurant,
         COUNT(DISTINCT restaurant_id) FILTER (WHERE is_active = 1) AS active_restaurant_with_orders,
         COUNT(DISTINCT restaurant_id) FILTER (WHERE is_active = 0) AS inactive_restaurant_with_ordes
  FROM dated JOIN dim_restaurant USING (restaurant_id) WHERE {KEPT} GROUP BY ALL
),
cancellation_rate AS (
  SELECT {MONTHS}, COUNT(*) AS total_orders, COUNT(*) FILTER (WHERE {LOST}) AS cancelled_orders,
         {ratio(f"COUNT(*) FILTER (WHERE {LOST})", "COUNT(*)")} AS cancellation_rate,
         ROUND({ratio(f"100 * COUNT(*) FILTER (WHERE {LOST})", "COUNT(*)")}, 3) AS cancellation_rate_pct
  FROM dated GROUP BY ALL
),
monthly_ordered_active_customer AS (
  SELECT {MONTHS}, COUNT(*) FILTER (WHERE {KEPT}) AS total_noncancel_order,
         COUNT(DISTINCT customer_id) FILTER (WHERE {KEPT}) AS active_customer,
         {ratio(f"COUNT(*) FILTER (WHERE {KEPT})", f"COUNT(DISTINCT customer_id) FILTER (WHERE {KEPT})")} AS order_per_active_customer
  FROM dated GROUP BY ALL
),
revenue_per_active_customer AS (
  SELECT {MONTHS}, buyers AS active_customer_non_cancel, revenue AS total_revenue_non_cancel,
         {half_up(units("revenue", 4), "buyers", 4, "DECIMAL(18,4)", 4)} AS revenue_per_active_customer
  FROM (SELECT {MONTHS}, COUNT(DISTINCT customer_id) FILTER (WHERE {KEPT}) AS buyers,
               {money(f"CASE WHEN {KEPT} THEN total_amount ELSE 0 END")} AS revenue
        FROM dated GROUP BY ALL)
),
monthly_customer_activity AS (
  SELECT DISTINCT {MONTHS}, customer_id FROM dated WHERE {KEPT}
),
returning_customer AS (
  SELECT now.month_start_date, now.phase, COUNT(DISTINCT now.customer_id) AS returning_customers
  FROM monthly_customer_activity AS now JOIN monthly_customer_activity AS earlier
    ON earlier.customer_id = now.customer_id
   AND CAST(earlier.month_start_date + INTERVAL 1 MONTH AS DATE) = now.month_start_date
  GROUP BY ALL
),
returning_customer_rate AS (
  SELECT {MONTHS}, active_customer_non_cancel AS active_customers,
         COALESCE(returning_customers, 0) AS returning_customers,
         {ratio("COALESCE(returning_customers, 0)", "active_customer_non_cancel")} AS retention_rate
  FROM monthly_active_customer LEFT JOIN returning_customer USING ({MONTHS})
),
monthly_rest_activity AS (
  SELECT DISTINCT {MONTHS}, restaurant_id AS non_cancel_rest_id FROM dated WHERE {KEPT}
),
monthly_active_res AS (
  SELECT {MONTHS}, COUNT(DISTINCT restaurant_id) AS active_restaurants FROM dated WHERE {KEPT} GROUP BY ALL
),
churn_restaurants AS (
  SELECT CAST(last.month_start_date + INTERVAL 1 MONTH AS DATE) AS month_start_date, last.phase,
         COUNT(DISTINCT last.non_cancel_rest_id) AS churned_restaurants
  FROM monthly_rest_activity AS last
  WHERE NOT EXISTS (
    SELECT 1 FROM monthly_rest_activity AS later
    WHERE later.non_cancel_rest_id = last.non_cancel_rest_id AND later.phase = last.phase
      AND later.month_start_date = CAST(last.month_start_date + INTERVAL 1 MONTH AS DATE))
  GROUP BY ALL
),
restaurant_churn_rate AS (
  SELECT c.month_start_date, c.phase, c.churned_restaurants, a.active_restaurants AS active_restaurants_prev_month,
         {ratio("c.churned_restaurants", "a.active_restaurants")} AS churn_rate
  FROM churn_restaurants AS c LEFT JOIN monthly_active_res AS a
    ON a.phase = c.phase AND CAST(a.month_start_date + INTERVAL 1 MONTH AS DATE) = c.month_start_date
),
monthly_master_summary AS (
  SELECT base.*, mac.active_customer, mac.active_customer_non_cancel, rcr.active_customers, rcr.returning_customers,
         rcr.retention_rate, dps.* EXCLUDE ({MONTHS}), rs.* EXCLUDE ({MONTHS}), cr.cancelled_orders,
         cr.cancellation_rate, cr.cancellation_rate_pct, oac.order_per_active_customer,
         rpac.revenue_per_active_customer, mar.active_restaurants, rc.churn_rate AS restaurant_churn_rate,
         rc.churned_restaurants, rc.active_restaurants_prev_month
  FROM monthly_order AS base
  LEFT JOIN monthly_active_customer AS mac USING ({MONTHS})
  LEFT JOIN returning_customer_rate AS rcr USING ({MONTHS})
  LEFT JOIN delivery_performance_summary AS dps USING ({MONTHS})
  LEFT JOIN rating_summary AS rs USING ({MONTHS})
  LEFT JOIN cancellation_rate AS cr USING ({MONTHS})
  LEFT JOIN monthly_ordered_active_customer AS oac USING ({MONTHS})
  LEFT JOIN revenue_per_active_customer AS rpac USING ({MONTHS})
  LEFT JOIN monthly_active_res AS mar ON mar.month_start_date = base.month_start_date
  LEFT JOIN restaurant_churn_rate AS rc ON rc.month_start_date = base.month_start_date
)"""


def daily() -> str:
    return f"""
daily_orders AS (
  SELECT CAST(order_timestamp AS DATE) AS date, COUNT(*) AS total_orders,
         COUNT(*) FILTER (WHERE {KEPT}) AS non_cancel_orders,
         {money(f"CASE WHEN {KEPT} THEN total_amount ELSE 0 END")} AS revenue_non_cancel,
         {ratio(f"SUM(total_amount) FILTER (WHERE {KEPT})", f"COUNT(total_amount) FILTER (WHERE {KEPT})")} AS aov_non_cancel,
         COUNT(DISTINCT customer_id) FILTER (WHERE {KEPT}) AS active_customers_non_cancel,
         COUNT(*) FILTER (WHERE {LOST}) AS cancelled_orders,
         {ratio(f"COUNT(*) FILTER (WHERE {LOST})", "COUNT(*)")} AS cancellation_rate
  FROM fact_orders GROUP BY 1
),
daily_ratings AS (
  SELECT CAST(order_timestamp AS DATE) AS date, {ratio("SUM(rating)", "COUNT(rating)")} AS avg_rating,
         COUNT(*) AS rating_count, {ratio("COUNT(*) FILTER (WHERE rating <= 2)", "COUNT(*)")} AS low_rating_rate
  FROM fact_orders JOIN fact_ratings USING (order_id) GROUP BY 1
),
daily_delivery AS (
  SELECT CAST(order_timestamp AS DATE) AS date,
         {ratio("SUM(expected_delivery_time_mins)", "COUNT(expected_delivery_time_mins)")} AS avg_expected_time_min,
         {ratio("SUM(actual_delivery_time_mins)", "COUNT(actual_delivery_time_mins)")} AS avg_actual_time_min,
         {ratio("COUNT(*) FILTER (WHERE actual_delivery_time_mins > expected_delivery_time_mins)", "COUNT(*)")} AS late_rate
  FROM fact_orders JOIN fact_delivery_performance USING (order_id) WHERE {KEPT} GROUP BY 1
),
daily_summary AS (
  SELECT d.date, d.phase, COALESCE(total_orders, 0) AS total_orders, COALESCE(non_cancel_orders, 0) AS non_cancel_orders,
         COALESCE(revenue_non_cancel, 0) AS revenue_non_cancel, aov_non_cancel,
         COALESCE(active_customers_non_cancel, 0) AS active_customers_non_cancel, cancellation_rate,
         avg_rating, rating_count, low_rating_rate, avg_expected_time_min, avg_actual_time_min, late_rate
  FROM dim_date AS d LEFT JOIN daily_orders USING (date) LEFT JOIN daily_ratings USING (date)
  LEFT JOIN daily_delivery USING (date)
),
orders_per_active_customer_day AS (
  SELECT phase, {ratio("SUM(non_cancel_orders)", "SUM(active_customers_non_cancel)")} AS orders_per_active_customer
  FROM daily_summary GROUP BY phase
)"""


def phase_reports() -> str:
    return f"""
phase_revenue_decomposition AS (
  SELECT phase, COUNT(DISTINCT customer_id) AS active_customers, COUNT(DISTINCT order_id) AS non_cancel_orders,
         {ratio("COUNT(DISTINCT order_id)", "COUNT(DISTINCT customer_id)")} AS frequency,
         {money("total_amount")} AS revenue, {ratio("SUM(total_amount)", "COUNT(DISTINCT order_id)")} AS aov
  FROM dated WHERE {KEPT} GROUP BY phase
),
phase_customer_overlap AS (
  SELECT n AS pre_customer_total, missing AS pre_never_ordered_in_crisis,
         {half_up("100 * missing", "n", 2, "DECIMAL(10,2)")} AS pct_pre_missing_in_crisis,
         n - missing AS customer_pre_and_crisis
  FROM (SELECT COUNT(*) AS n, {total("CASE WHEN c.customer_id IS NULL THEN 1 ELSE 0 END")} AS missing
        FROM (SELECT DISTINCT customer_id FROM dated WHERE phase = 'pre') AS p
        LEFT JOIN (SELECT DISTINCT customer_id FROM dated WHERE phase = 'crisis') AS c
               ON c.customer_id = p.customer_id)
),
kept_days AS (
  SELECT customer_id, CAST(order_timestamp AS DATE) AS day FROM fact_orders WHERE {KEPT}
),
new_vs_returning AS (
  SELECT d.phase, COUNT(DISTINCT CASE WHEN is_new THEN customer_id END) AS new_customer,
         COUNT(DISTINCT CASE WHEN NOT is_new THEN customer_id END) AS returning_customer
  FROM (SELECT k.customer_id, k.day, COALESCE(k.day = f.first_day, FALSE) AS is_new
        FROM kept_days AS k
        LEFT JOIN (SELECT customer_id, MIN(day) AS first_day FROM kept_days GROUP BY 1) AS f
               ON f.customer_id = k.customer_id) AS o
  LEFT JOIN dim_date AS d ON d.date = o.day
  GROUP BY d.phase
),
phase_comparison AS (
  SELECT phase, COUNT(*) AS months_in_phase, {total("total_orders")} AS total_orders, {money("total_revenue")} AS total_revenue,
         CAST(TRUNC(AVG(active_customer)) AS BIGINT) AS avg_monthly_active_customers,
         CAST(TRUNC(AVG(active_customer_non_cancel)) AS BIGINT) AS avg_monthly_active_non_cancel_customers,
         ROUND({ratio("SUM(retention_rate * active_customer)", "SUM(active_customer)")}, 9) AS retention_rate,
         ROUND({ratio("SUM(avg_rating * total_rating)", "SUM(total_rating)")}, 9) AS avg_rating,
         ROUND({ratio("SUM(late_rate * deliveries)", "SUM(deliveries)")}, 9) AS late_rate,
         ROUND({ratio("SUM(avg_actual_time_min * deliveries)", "SUM(deliveries)")}, 9) AS avg_actual_time_min,
         ROUND({ratio("SUM(avg_expected_time_min * deliveries)", "SUM(deliveries)")}, 9) AS avg_expected_time_min,
         ROUND({ratio("SUM(avg_actual_time_min * deliveries) - SUM(avg_expected_time_min * deliveries)", "SUM(deliveries)")}, 9)
           AS diff_actual_expected_min,
         {ratio("SUM(total_cancelled_order)", "SUM(total_orders)")} AS cancellation_rate,
         CAST(TRUNC(AVG(active_restaurants)) AS BIGINT) AS avg_monthly_active_restaurants,
         ROUND(AVG(avg_sentiment), 9) AS avg_monthly_sentiment_score
  FROM monthly_master_summary GROUP BY phase
)"""


def weekly() -> str:
    indexes = ",\n         ".join(
        f"ROUND(100 * w.{metric} / NULLIF(b.{metric}, 0), 6) AS {name}"
        for name, metric in {
            "orders_index": "weekly_order",
            "customers_index": "weekly_active_customer",
            "delay_index": "avg_weekly_delay_min",
            "rating_index": "avg_weekly_rating",
            "cancel_index": "cancellation_rate",
        }.items()
    )
    return f"""
weekly_kpis AS (
  SELECT o.phase, week_start_date, weekly_order, weekly_active_customer, weekly_cancel_order, weekly_active_restaurant,
         {ratio("weekly_order", "weekly_active_customer")} AS weekly_frequency,
         {ratio("weekly_cancel_order", "weekly_order")} AS cancellation_rate,
         avg_weekly_rating, avg_weekly_actual_time, avg_weekly_expected_time,
         avg_weekly_actual_time - avg_weekly_expected_time AS avg_weekly_delay_min
  FROM (SELECT phase, week_start_date, COUNT(DISTINCT order_id) AS weekly_order,
               COUNT(DISTINCT customer_id) AS weekly_active_customer,
               COUNT(DISTINCT order_id) FILTER (WHERE {LOST}) AS weekly_cancel_order,
               COUNT(DISTINCT restaurant_id) AS weekly_active_restaurant
        FROM weekly_dated GROUP BY ALL) AS o
  LEFT JOIN (SELECT week_start_date, {ratio("SUM(r.rating)", "COUNT(r.rating)")} AS avg_weekly_rating
             FROM weekly_dated AS w JOIN fact_ratings AS r ON r.order_id = w.order_id
             GROUP BY ALL) AS rating USING (week_start_date)
  LEFT JOIN (SELECT week_start_date,
                    {ratio("SUM(actual_delivery_time_mins)", "COUNT(actual_delivery_time_mins)")} AS avg_weekly_actual_time,
                    {ratio("SUM(expected_delivery_time_mins)", "COUNT(expected_delivery_time_mins)")} AS avg_weekly_expected_time
             FROM weekly_dated JOIN fact_delivery_performance USING (order_id)
             GROUP BY ALL) AS delivery USING (week_start_date)
),
baseline AS (
  SELECT AVG(weekly_order) AS weekly_order, AVG(weekly_active_customer) AS weekly_active_customer,
         AVG(avg_weekly_delay_min) AS avg_weekly_delay_min, AVG(avg_weekly_rating) AS avg_weekly_rating,
         AVG(cancellation_rate) AS cancellation_rate
  FROM weekly_kpis WHERE phase = 'pre'
),
baseline_index AS (
  SELECT w.*, {indexes}
  FROM weekly_kpis AS w CROSS JOIN baseline AS b
),
phase_spans AS (
  SELECT phase, MIN(week_start_date) AS first_week, MAX(week_start_date) AS last_week FROM weekly_kpis GROUP BY phase
)"""


def inside(span: Span, column: str = "o.order_timestamp") -> str:
    return f"{column} >= TIMESTAMP '{span.start}' AND {column} < TIMESTAMP '{span.end}'"


def cohorts(spec: CohortSpec) -> str:
    return f"""
ops_experience AS (
  SELECT customer_id, MAX(CASE WHEN actual_delivery_time_mins - expected_delivery_time_mins > 15 THEN 1 ELSE 0 END) AS high_delay_flag,
         MAX(CASE WHEN {LOST} THEN 1 ELSE 0 END) AS cancelled_flag
  FROM fact_orders AS o LEFT JOIN fact_delivery_performance USING (order_id)
  WHERE {inside(spec.experience)} GROUP BY customer_id
),
cohort_ops_retention AS (
  SELECT '{spec.name}' AS cohort_name, CAST(COALESCE(high_delay_flag, 0) AS INTEGER) AS high_delay_flag,
         CAST(COALESCE(cancelled_flag, 0) AS INTEGER) AS cancelled_flag, COUNT(*) AS total_customers,
         COUNT(back.customer_id) AS retained_customers, {ratio("COUNT(back.customer_id)", "COUNT(*)")} AS retention_rate
  FROM (SELECT DISTINCT customer_id FROM fact_orders AS o WHERE {inside(spec.cohort)}) AS m
  LEFT JOIN ops_experience AS e ON e.customer_id = m.customer_id
  LEFT JOIN (SELECT DISTINCT customer_id FROM fact_orders AS o WHERE {inside(spec.outcome)}) AS back
         ON back.customer_id = m.customer_id
  GROUP BY ALL
),
kept_members AS (
  SELECT customer_id, COUNT(*) AS n FROM fact_orders AS o WHERE {inside(spec.cohort)} AND {KEPT} GROUP BY customer_id
),
kept_back AS (
  SELECT DISTINCT customer_id FROM fact_orders AS o WHERE {inside(spec.outcome)} AND {KEPT}
),
experience AS (
  SELECT o.customer_id,
         MAX(CASE WHEN {KEPT} THEN 1 ELSE 0 END) AS june_non_cancel_order_flag,
         MAX(CASE WHEN {LOST} THEN 1 ELSE 0 END) AS june_cancelled_flag,
         MAX(CASE WHEN actual_delivery_time_mins - expected_delivery_time_mins > 10 THEN 1 ELSE 0 END) AS delay_diff_flag,
         MAX(CASE WHEN actual_delivery_time_mins > 45 THEN 1 ELSE 0 END) AS long_delivery_flag,
         MAX(CASE WHEN {KEPT} AND r.rating <= 2 THEN 1 ELSE 0 END) AS low_rating_flag
  FROM fact_orders AS o LEFT JOIN fact_delivery_performance AS dp ON dp.order_id = o.order_id
  LEFT JOIN fact_ratings AS r ON r.order_id = o.order_id
  WHERE {inside(spec.experience)} GROUP BY o.customer_id
),
rating_members AS (
  SELECT m.n, CASE WHEN back.customer_id IS NULL THEN 0 ELSE 1 END AS retained,
         COALESCE(june_non_cancel_order_flag, 0) AS june_non_cancel_order_flag,
         COALESCE(june_cancelled_flag, 0) AS june_cancelled_flag, COALESCE(delay_diff_flag, 0) AS delay_diff_flag,
         COALESCE(long_delivery_flag, 0) AS long_delivery_flag, COALESCE(low_rating_flag, 0) AS low_rating_flag
  FROM kept_members AS m LEFT JOIN experience AS e ON e.customer_id = m.customer_id
  LEFT JOIN kept_back AS back ON back.customer_id = m.customer_id
),
cohort_rating_retention AS (
  SELECT CAST(low_rating_flag AS INTEGER) AS low_rating_flag, COUNT(*) AS customers, {total("retained")} AS retained_count,
         {ratio("SUM(retained)", "COUNT(*)")} AS retention_rate, {ratio("SUM(n)", "COUNT(*)")} AS avg_may_order_count
  FROM rating_members GROUP BY 1
),
cohort_flag_retention AS (
  SELECT CAST(june_non_cancel_order_flag AS INTEGER) AS june_non_cancel_order_flag,
         CAST(june_cancelled_flag AS INTEGER) AS june_cancelled_flag, CAST(delay_diff_flag AS INTEGER) AS delay_diff_flag,
         CAST(long_delivery_flag AS INTEGER) AS long_delivery_flag, CAST(low_rating_flag AS INTEGER) AS low_rating_flag,
         COUNT(*) AS customers, {total("retained")} AS retained_count, {ratio("SUM(retained)", "COUNT(*)")} AS retention_rate,
         {ratio("SUM(n)", "COUNT(*)")} AS avg_may_order_count
  FROM rating_members GROUP BY ALL
),
frequency_bucket_retention AS (
  SELECT CASE WHEN n = 1 THEN '1_order' WHEN n = 2 THEN '2_order' ELSE '3+_order' END AS frequency_bucket,
         COUNT(*) AS customer, {ratio("SUM(retained)", "COUNT(*)")} AS retention_rate
  FROM rating_members GROUP BY 1
),
curve_members AS (
  SELECT DISTINCT customer_id FROM dated AS o WHERE {inside(spec.cohort)}
),
cohort_retention_curve AS (
  SELECT a.month_start_date,
         CAST(date_diff('month', DATE '{spec.cohort.end}', a.month_start_date) + 1 AS INTEGER) AS months_after_cohort,
         COUNT(DISTINCT m.customer_id) AS active_customers, (SELECT COUNT(*) FROM curve_members) AS cohort_size,
         {ratio("COUNT(DISTINCT m.customer_id)", "(SELECT COUNT(*) FROM curve_members)")} AS retention_rate
  FROM (SELECT DISTINCT month_start_date, customer_id FROM dated AS o
        WHERE o.order_timestamp >= TIMESTAMP '{spec.cohort.end}') AS a
  LEFT JOIN curve_members AS m ON m.customer_id = a.customer_id
  GROUP BY a.month_start_date
)"""


def restaurants() -> str:
    by_revenue = "ORDER BY pre_revenue DESC, restaurant_id NULLS FIRST"
    return f"""
pre_restaurants AS (
  SELECT restaurant_id, {money("COALESCE(total_amount, 0)")} AS pre_revenue, COUNT(*) AS pre_orders
  FROM dated WHERE phase = 'pre' AND {KEPT} GROUP BY restaurant_id
),
restaurant_phases AS (
  SELECT restaurant_id, phase, {money("COALESCE(total_amount, 0)")} AS revenue, COUNT(*) AS orders
  FROM dated WHERE {KEPT} GROUP BY ALL
),
restaurant_tier_by_phase AS (
  SELECT CASE WHEN decile = 1 THEN 'Top_10%' WHEN decile <= 3 THEN 'Next_20%' ELSE 'Bottom_70%' END AS restaurant_tier,
         p.phase, {total("p.orders")} AS orders, {money("p.revenue")} AS revenue
  FROM (SELECT restaurant_id, NTILE(10) OVER ({by_revenue}) AS decile FROM pre_restaurants) AS t
  LEFT JOIN restaurant_phases AS p ON p.restaurant_id = t.restaurant_id
  GROUP BY 1, 2
),
leaders AS (
  SELECT * FROM pre_restaurants {by_revenue} LIMIT 15
),
top_restaurants_pre AS (
  SELECT restaurant_id, restaurant_name, city, pre_orders, pre_revenue FROM leaders JOIN dim_restaurant USING (restaurant_id)
),
top_restaurants_across_phases AS (
  SELECT restaurant_id, restaurant_name, city, phase, orders, revenue
  FROM leaders JOIN dim_restaurant USING (restaurant_id) LEFT JOIN restaurant_phases USING (restaurant_id)
)"""


def cities() -> str:
    metrics = ["revenue", "orders", "active_customers", "active_restaurants"]
    wide = ",\n         ".join(
        f"MAX({m}) FILTER (WHERE phase = '{p}') AS {p}_{m}" for m in metrics for p in ("pre", "crisis", "post")
    )

    def pivot(metric: str) -> str:
        return ", ".join(f"MAX({metric}) FILTER (WHERE phase = '{p}') AS {p}" for p in ("pre", "crisis", "post"))

    return f"""
served AS (
  SELECT * FROM dated JOIN dim_restaurant USING (restaurant_id) WHERE {KEPT}
),
city_phase AS (
  SELECT city, phase, COUNT(*) AS orders, {money("COALESCE(total_amount, 0)")} AS revenue,
         COUNT(DISTINCT customer_id) AS active_customers, COUNT(DISTINCT restaurant_id) AS active_restaurants
  FROM served GROUP BY ALL
),
city_cents AS (
  SELECT city, phase, COUNT(*) AS orders,
         CAST(SUM(COALESCE(CAST(total_amount AS DECIMAL(18,2)), 0)) AS DECIMAL(18,2)) AS revenue,
         COUNT(DISTINCT customer_id) AS active_customers, COUNT(DISTINCT restaurant_id) AS active_restaurants,
         COUNT(DISTINCT restaurant_id) FILTER (WHERE is_active = 1) AS active_partner_restaurants,
         AVG({PREP}) FILTER (WHERE is_active = 1) AS avg_prep_time_active_restaurants
  FROM served GROUP BY ALL
),
city_revenue AS (
  SELECT c.*, {half_up("orders", "active_customers", 4, "DECIMAL(10,4)")} AS frequency,
         {half_up(units("revenue", 2), "orders", 2, "DECIMAL(10,2)", 2)} AS aov,
         {half_up(units("revenue", 2), units("whole", 2), 6, "DECIMAL(10,6)")} AS revenue_share_in_phase
  FROM city_cents AS c JOIN (SELECT phase, SUM(revenue) AS whole FROM city_cents GROUP BY phase) USING (phase)
),
city_revenue_wide AS (
  SELECT *, {ratio("crisis_revenue", "pre_revenue")} AS crisis_vs_pre_revenue_pct,
         {ratio("post_revenue", "pre_revenue")} AS post_vs_pre_revenue_pct,
         {ratio("post_revenue", "crisis_revenue")} AS post_vs_crisis_revenue_multiple
  FROM (SELECT city, {wide} FROM city_phase GROUP BY city)
),
restaurant_coverage AS (
  SELECT *, {ratio("post", "pre")} * 100 AS post_vs_pre_pct
  FROM (SELECT city, {pivot("active_restaurants")} FROM city_revenue GROUP BY city)
),
revenue_share_pivot AS (
  SELECT city, {pivot("revenue_share_in_phase")} FROM city_revenue GROUP BY city
)"""


SENTIMENT = "SELECT * REPLACE (ROUND(avg_sentiment, 10) AS avg_sentiment) FROM"

# Final SELECT of every query; names as in ``queries()``.
REPORTS: dict[str, str] = {
    "q01_null_key_audit": "SELECT * FROM null_key_audit",
    "q02_clean_ratings": "SELECT * FROM clean_fact_ratings",
    "q03_normalize_amounts": "SELECT order_id, subtotal_amount, discount_amount, delivery_fee, total_amount FROM fact_orders",
    "q04_build_dim_date": "SELECT * FROM dim_date",
    "q05_scan_restaurants": "SELECT * FROM dim_restaurant",
    "q06_ratings_by_sentiment": "SELECT * FROM fact_ratings WHERE sentiment_score = 0.7E0",
    "q07_orders_with_date": "SELECT * FROM dated",
    "q08_monthly_order": "SELECT * FROM monthly_order",
    "q09_monthly_active_customer": "SELECT * FROM monthly_active_customer",
    "q10_delivery_performance_summary": "SELECT * FROM delivery_performance_summary",
    "q11_rating_summary": f"{SENTIMENT} rating_summary",
    "q12_restaurant_activity_summary": "SELECT * FROM restaurant_activity_summary",
    "q13_cancellation_rate": "SELECT * FROM cancellation_rate",
    "q14_monthly_ordered_active_customer": "SELECT * FROM monthly_ordered_active_customer",
    "q15_revenue_per_active_customer": "SELECT * FROM revenue_per_active_customer",
    "q16_monthly_customer_activity": "SELECT * FROM monthly_customer_activity",
    "q17_preview": f"SELECT * FROM monthly_customer_activity ORDER BY {MONTHS}, customer_id NULLS FIRST LIMIT 10",
    "q18_returning_customer": "SELECT * FROM returning_customer",
    "q19_returning_customer_rate": "SELECT * FROM returning_customer_rate",
    "q20_monthly_rest_activity": "SELECT * FROM monthly_rest_activity",
    "q21_monthly_active_res": "SELECT * FROM monthly_active_res",
    "q22_churn_restaurants": "SELECT * FROM churn_restaurants",
    "q23_restaurant_churn_rate": "SELECT * FROM restaurant_churn_rate",
    "q24_grain_check": f"""SELECT {MONTHS}, COUNT(*) AS cnt FROM restaurant_churn_rate GROUP BY ALL HAVING COUNT(*) > 1
      UNION ALL SELECT {MONTHS}, COUNT(*) AS cnt FROM monthly_master_summary GROUP BY ALL HAVING COUNT(*) > 1""",
    "q24_grain_check_orders": "SELECT order_id, COUNT(*) AS cnt FROM fact_orders GROUP BY ALL HAVING COUNT(*) > 1",
    "q24_grain_check_deliveries": """SELECT order_id, COUNT(*) AS cnt FROM fact_delivery_performance
      GROUP BY ALL HAVING COUNT(*) > 1""",
    "q24_grain_check_ratings": "SELECT order_id, COUNT(*) AS cnt FROM fact_ratings GROUP BY ALL HAVING COUNT(*) > 1",
    "q24_grain_check_restaurants": """SELECT restaurant_id, COUNT(*) AS cnt FROM dim_restaurant
      GROUP BY ALL HAVING COUNT(*) > 1""",
    "q24_grain_check_items": """SELECT order_id, menu_item_id, COUNT(*) AS cnt FROM fact_order_items
      GROUP BY ALL HAVING COUNT(*) > 1""",
    "q26_monthly_master_summary": f"{SENTIMENT} monthly_master_summary",
    "q27_mart_row_count": "SELECT COUNT(*) AS rows_in_master FROM monthly_master_summary",
    "q27_mart_dump": f"{SENTIMENT} monthly_master_summary ORDER BY {MONTHS}",
    "q28a_daily_orders": "SELECT * FROM daily_orders",
    "q28b_daily_ratings": "SELECT * FROM daily_ratings",
    "q28c_daily_delivery": "SELECT * FROM daily_delivery",
    "q28_daily_summary": "SELECT * FROM daily_summary",
    "q29_orders_per_active_customer_day": "SELECT * FROM orders_per_active_customer_day",
    "q30_phase_revenue_decomposition": "SELECT * FROM phase_revenue_decomposition",
    "q31_phase_customer_overlap": "SELECT * FROM phase_customer_overlap",
    "q32_weekly_kpis": "SELECT * FROM weekly_kpis",
    "q33_cohort_ops_retention": "SELECT * FROM cohort_ops_retention",
    "q34_cohort_rating_retention": "SELECT * FROM cohort_rating_retention",
    "q34_cohort_flag_retention": "SELECT * FROM cohort_flag_retention",
    "q35_new_vs_returning": "SELECT * FROM new_vs_returning",
    "q36_frequency_bucket_retention": "SELECT * FROM frequency_bucket_retention",
    "q37_restaurant_tier_by_phase": "SELECT * FROM restaurant_tier_by_phase",
    "q38_top_restaurants_pre": "SELECT * FROM top_restaurants_pre",
    "q39_top_restaurants_across_phases": "SELECT * FROM top_restaurants_across_phases",
    "q40_city_phase": "SELECT * FROM city_phase",
    "q41_city_revenue": "SELECT * FROM city_revenue",
    "q42_city_revenue_wide": "SELECT * FROM city_revenue_wide",
    "q43_phase_comparison": "SELECT * FROM phase_comparison",
    "q44_baseline_index": "SELECT * FROM baseline_index",
    "q45_phase_spans": "SELECT * FROM phase_spans",
    "q46_restaurant_coverage": "SELECT * FROM restaurant_coverage",
    "q47_revenue_share_pivot": "SELECT * FROM revenue_share_pivot",
    "q48_export_csv": """SELECT 'weekly_df' AS frame, * FROM weekly_kpis
      UNION ALL BY NAME SELECT 'retention_df' AS frame, * FROM cohort_ops_retention
      UNION ALL BY NAME SELECT 'retention_rating_df' AS frame, * FROM cohort_rating_retention
      UNION ALL BY NAME SELECT 'city_revenue_df' AS frame, * FROM city_revenue""",
    "q49_cohort_retention_curve": "SELECT * FROM cohort_retention_curve",
}

# Queries that give the rows of another one by other means.
REPORTS |= {
    "q03_amounts_of_changed_type": REPORTS["q03_normalize_amounts"],
    "q09_customers_of_bitmaps": REPORTS["q09_monthly_active_customer"],
    "q14_ordered_of_bitmaps": REPORTS["q14_monthly_ordered_active_customer"],
    "q30_decomposition_of_bitmaps": REPORTS["q30_phase_revenue_decomposition"],
    "q32_weekly_of_bitmaps": REPORTS["q32_weekly_kpis"],
    "q16_activity_of_masks": REPORTS["q16_monthly_customer_activity"],
    "q18_returning_of_masks": REPORTS["q18_returning_customer"],
    "q19_returning_rate_of_masks": REPORTS["q19_returning_customer_rate"],
    "q20_activity_of_masks": REPORTS["q20_monthly_rest_activity"],
    "q21_active_res_of_masks": REPORTS["q21_monthly_active_res"],
    "q22_churn_of_masks": REPORTS["q22_churn_restaurants"],
    "q23_churn_rate_of_masks": REPORTS["q23_restaurant_churn_rate"],
    "q26_refreshed_master": REPORTS["q26_monthly_master_summary"],
    "q49_curve_of_masks": REPORTS["q49_cohort_retention_curve"],
}


def statements(phases: PhaseSpec, spec: CohortSpec, base: str = ADAPTER) -> dict[str, str]:
    """One self-contained statement per query; ``base`` defines the base tables, or is empty where they exist."""
    parts = [base] if base else []
    parts += [calendar(phases), quality(), monthly(), daily(), phase_reports(), weekly(), cohorts(spec), restaurants(), cities()]
    definitions = ",".join(parts)
    return {name: f"WITH {definitions}\n{report}" for name, report in REPORTS.items()}
