"""Checks and business indicators."""

from pyspark.sql import functions as F

from tradeloom.functions import text
from tradeloom.operators import audit, features, kpis, views
from tradeloom.plans.forecast_plans import (
    build_monthly, build_weekly, future_monthly, metadata, monthly, sums_panel, weekly_sums_panel,
)
from tradeloom.plans.registry import query
from tradeloom.sources.star import CALENDAR


@query(
    "dq_summary",
    """SELECT 'customers_missing_province' AS issue, count(*) AS issue_count, CAST(NULL AS DOUBLE) AS affected_revenue
    FROM dim_customer WHERE province_id IS NULL
    UNION ALL SELECT 'fact_rows_missing_geography', count(*), CAST(sum(line_total) AS DOUBLE) FROM fact
    WHERE province_id IS NULL OR province_name IS NULL OR region IS NULL
    UNION ALL SELECT 'sku_missing_group', count(DISTINCT product_code), CAST(sum(line_total) AS DOUBLE) FROM fact
    WHERE line_id_fk IS NULL OR group_code IS NULL
    UNION ALL SELECT 'customers_missing_tax_code', count(*), NULL FROM dim_customer WHERE tax_code IS NULL OR trim(tax_code) = ''""",
)
def _(t):
    fact = t.fact("province_id", "province_name", "region", "product_code", "line_id_fk", "group_code", "line_total")
    return audit.dq_summary(t.customer(), fact)


def count_sql(name: str, actual: str, expected: str) -> str:
    return f"""SELECT '{name}' AS table_name, a AS actual, e AS expected, CASE WHEN a = e THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT ({actual}) AS a, ({expected}) AS e)"""


@query(
    "row_count_check",
    " UNION ALL ".join(
        [
            count_sql("fact_sales", "SELECT count(*) FROM fact", "SELECT count(*) FROM lineitem"),
            count_sql("sales_order", "SELECT count(*) FROM sales_order", "SELECT count(DISTINCT l_orderkey) FROM lineitem"),
            count_sql("customer", "SELECT count(*) FROM dim_customer", "SELECT count(DISTINCT c_custkey) FROM customer"),
            count_sql("product", "SELECT count(*) FROM dim_product", "SELECT count(DISTINCT p_partkey) FROM part"),
        ]
    ),
)
def _(t):
    tables = {
        "fact_sales": t.fact("order_id", "customer_name", "province_name", "product_name"),
        "sales_order": t.orders(),
        "customer": t.customer(),
        "product": t.product(),
    }
    expected = {
        "fact_sales": t.raw("lineitem").agg(F.count(F.lit(1))).scalar(),
        "sales_order": t.raw("lineitem").agg(F.countDistinct("l_orderkey")).scalar(),
        "customer": t.raw("customer").agg(F.countDistinct("c_custkey")).scalar(),
        "product": t.raw("part").agg(F.countDistinct("p_partkey")).scalar(),
    }
    return audit.row_count_check(tables, expected)


def totals_sql(check: str, a: str, b: str) -> str:
    return f"""SELECT '{check}' AS check, CASE WHEN abs({a} - {b}) < 1 THEN 'PASS' ELSE 'FAIL' END AS status,
    CAST({a} AS DOUBLE) AS left_value, CAST({b} AS DOUBLE) AS right_value"""


L_AMOUNT, L_QUANTITY = "(SELECT sum(line_total) FROM order_line)", "(SELECT sum(quantity) FROM order_line)"


@query(
    "cross_table_totals",
    " UNION ALL ".join(
        [
            totals_sql("header_vs_line_amount", "(SELECT sum(line_total) FROM order_line JOIN orders ON o_orderkey = order_id)", L_AMOUNT),
            totals_sql("header_vs_line_quantity", "(SELECT sum(quantity) FROM order_line JOIN orders ON o_orderkey = order_id)", L_QUANTITY),
            totals_sql("fact_vs_line_amount", "(SELECT sum(line_total) FROM fact)", L_AMOUNT),
            totals_sql("fact_vs_line_quantity", "(SELECT sum(quantity) FROM fact)", L_QUANTITY),
        ]
    ),
)
def _(t):
    headers = views.order_rollup(t.orders(), t.lines()).select(
        F.col("total_amount").cast("decimal(20,2)").alias("total_amount"), "total_quantity"
    )
    return audit.cross_table_totals(headers, t.lines(), t.fact("line_total", "quantity", "customer_name", "product_name"))


@query(
    "merge_loss_check",
    """SELECT 'row count unchanged' AS check, CASE WHEN (SELECT count(*) FROM order_line) = (SELECT count(*) FROM fact) THEN 'PASS' ELSE 'FAIL' END AS status,
    CAST((SELECT count(*) FROM fact) AS VARCHAR) AS detail
    UNION ALL SELECT 'quantity unchanged', CASE WHEN (SELECT sum(quantity) FROM order_line) = (SELECT sum(quantity) FROM fact) THEN 'PASS' ELSE 'FAIL' END,
    CAST(CAST((SELECT sum(quantity) FROM fact) AS BIGINT) AS VARCHAR)
    UNION ALL SELECT 'revenue unchanged', CASE WHEN (SELECT sum(line_total) FROM order_line) = (SELECT sum(line_total) FROM fact) THEN 'PASS' ELSE 'FAIL' END,
    CAST(CAST((SELECT sum(line_total) FROM fact) AS DECIMAL(38,2)) AS VARCHAR)""",
)
def _(t):
    return audit.merge_loss_check(t.lines(), t.fact("quantity", "line_total", "customer_name", "region", "product_name"))


@query(
    "week_month_reconcile",
    """SELECT w.period_month, w.q AS weekly_quantity, m.q AS monthly_quantity, abs(w.q - m.q) AS difference,
    CASE WHEN abs(w.q - m.q) <= 1 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT period_month, sum(total_quantity) AS q FROM weekly GROUP BY 1) w
    JOIN (SELECT period_month, sum(total_quantity) AS q FROM monthly GROUP BY 1) m USING (period_month)""",
)
def _(t):
    return audit.week_month_reconcile(weekly_sums_panel(t), sums_panel(t))


def share(column: str) -> str:
    return f"100 * CAST(unknown_{column} AS DOUBLE) / all_{column} AS {column}_share_pct"


@query(
    "unknown_impact",
    f"""SELECT month, is_total, unknown_rows, unknown_quantity, unknown_revenue, {share('rows')}, {share('quantity')}, {share('revenue')} FROM (
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, grouping(month) = 1 AS is_total, CAST(count(*) FILTER (WHERE line_id_fk IS NULL) AS BIGINT) AS unknown_rows, count(*) AS all_rows,
    CAST(coalesce(sum(quantity) FILTER (WHERE line_id_fk IS NULL), 0) AS DOUBLE) AS unknown_quantity, CAST(sum(quantity) AS DOUBLE) AS all_quantity,
    CAST(coalesce(sum(line_total) FILTER (WHERE line_id_fk IS NULL), 0) AS DOUBLE) AS unknown_revenue, CAST(sum(line_total) AS DOUBLE) AS all_revenue
    FROM fact GROUP BY ROLLUP (month))""",
    rounded="rows_share_pct quantity_share_pct revenue_share_pct",
)
def _(t):
    return audit.unknown_impact(t.fact("order_date", "line_id_fk", "quantity", "line_total"))


@query(
    "unknown_sku_detail",
    """SELECT product_code, min(product_name) AS product_name, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(line_total) AS DOUBLE) AS line_total,
    min(order_date) >= DATE '2001-03-01' AS is_cold_start_march FROM blocks WHERE line_id_fk IS NULL GROUP BY 1""",
)
def _(t):
    fact = t.block_fact("product_code", "product_name", "quantity", "line_total", "order_date", "line_id_fk")
    return audit.unknown_sku_detail(fact, CALENDAR.last_month_start)


@query(
    "match_rate",
    """SELECT count(*) AS fact_rows, CAST(count(*) FILTER (WHERE province_id IS NOT NULL) AS BIGINT) AS matched_rows,
    100.0 * count(*) FILTER (WHERE province_id IS NOT NULL) / count(*) AS match_rate_percent FROM fact""",
    rounded="match_rate_percent",
)
def _(t):
    as_text = F.concat(F.col("province_id").cast("string"), F.lit(".0"))
    return audit.match_rate(
        t.fact("province_id"), t.province(), text.normalize_id(as_text), text.normalize_id(F.col("province_id").cast("string"))
    )


@query(
    "missing_key_impact",
    """SELECT count(*) FILTER (WHERE line_id_fk IS NULL) AS missing_rows, CAST(sum(quantity) FILTER (WHERE line_id_fk IS NULL) AS DOUBLE) AS missing_quantity,
    CAST(sum(quantity) AS DOUBLE) AS all_quantity, 100 * CAST(sum(quantity) FILTER (WHERE line_id_fk IS NULL) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE)
    AS quantity_share_pct FROM fact""",
    rounded="quantity_share_pct",
)
def _(t):
    return audit.missing_key_impact(t.fact("line_id_fk", "quantity"), "line_id_fk")


@query("dirty_values", "SELECT DISTINCT line_name FROM fact WHERE line_name LIKE '%Chưa xác định%' OR length(line_name) > 15")
def _(t):
    return audit.dirty_values(t.fact("line_name"), "line_name")


@query(
    "unresolved_by_customer",
    """SELECT f.customer_code, c.customer_name, c.address, count(*) AS fact_rows FROM fact f JOIN dim_customer c USING (customer_code)
    WHERE f.province_id IS NULL OR f.province_name IS NULL OR f.region IS NULL GROUP BY 1, 2, 3""",
)
def _(t):
    return audit.unresolved_by_customer(t.fact("customer_code", "province_id", "province_name", "region"), t.customer())


def panel_check(check: str, passed: str, detail: str) -> str:
    return f"""SELECT '{check}' AS check, CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS status,
    CAST(CAST(round({detail}) AS BIGINT) AS VARCHAR) AS detail FROM m, w, s, f, fw"""


@query(
    "panel_audit",
    """WITH m AS (SELECT count(*) AS n, count(DISTINCT product_code) AS skus, sum(total_quantity) AS q, sum(total_revenue) AS r,
      coalesce(sum(total_revenue) FILTER (WHERE group_code_clean = 'UNKNOWN'), 0) AS u FROM monthly),
    w AS (SELECT count(*) AS wn, sum(total_quantity) AS wq, sum(total_revenue) AS wr FROM weekly),
    s AS (SELECT count(DISTINCT product_code) AS sskus, CAST(sum(quantity) AS DOUBLE) AS sq, CAST(sum(line_total) AS DOUBLE) AS sr,
      CAST(coalesce(sum(line_total) FILTER (WHERE group_code IS NULL), 0) AS DOUBLE) AS su FROM blocks),
    f AS (SELECT count(*) AS fn, count(total_quantity) AS ft FROM monthly_all WHERE period_month > 15),
    fw AS (SELECT count(*) AS fwn, 0 AS fwt FROM future_week)
    """
    + " UNION ALL ".join(
        panel_check(*c)
        for c in [
            ("monthly panel has rows", "n > 0", "n"),
            ("weekly panel has no fewer rows", "wn >= n", "wn"),
            ("SKU count matches sales", "skus = sskus", "skus"),
            ("monthly quantity matches sales", "abs(q - sq) <= 1", "q"),
            ("weekly quantity matches sales", "abs(wq - sq) <= 1", "wq"),
            ("monthly revenue matches sales", "abs(r - sr) <= 1", "r"),
            ("weekly revenue matches sales", "abs(wr - sr) <= 1", "wr"),
            ("unknown revenue matches unmapped sales", "abs(u - su) <= 1", "u"),
            ("monthly future targets are empty", "ft = 0", "fn"),
            ("weekly future targets are empty", "fwt = 0", "fwn"),
        ]
    ),
)
def _(t):
    panel, weekly = monthly(t), weekly_sums_panel(t)
    future = features.future_monthly_rows(panel, metadata(t), CALENDAR)
    ahead = features.future_weekly_rows(build_weekly(t, metadata(t)), metadata(t), CALENDAR)
    return audit.panel_audit(panel, weekly, future, ahead, t.block_fact("product_code", "group_code", "quantity", "line_total"))


@query(
    "period_set_check",
    """SELECT 'periods match' AS check, CASE WHEN string_agg(p, ',' ORDER BY p::INT) = '1,2,3,13,14,15' THEN 'PASS' ELSE 'FAIL' END AS status,
    string_agg(p, ',' ORDER BY p::INT) AS detail FROM (SELECT DISTINCT CAST(period_month AS VARCHAR) AS p FROM monthly)
    UNION ALL SELECT 'gap is untouched', CASE WHEN count(*) FILTER (WHERE period_month BETWEEN 4 AND 12) = 0 THEN 'PASS' ELSE 'FAIL' END,
    CAST(count(DISTINCT period_month) AS VARCHAR) FROM monthly""",
)
def _(t):
    return audit.period_set_check(sums_panel(t), CALENDAR)


AUDITED = ["qty_lag_1", "qty_lag_2", "n_dealers_lag1", "implied_price_lag1", "median_unit_price_lag1", "n_provinces_lag1", "n_regions_lag1"]


@query(
    "cross_gap_lag_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, period_month, count(*) AS total_rows, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        100.0 * (count(*) - count({c})) / count(*) AS null_rate_pct, CASE WHEN period_month <> 13 THEN 'N/A (intra-block)'
        WHEN count({c}) > 0 THEN 'YES - CRITICAL VIOLATION' ELSE 'NO' END AS cross_gap_violation
        FROM monthly_feat WHERE period_month IN (13, 14, 15) GROUP BY 2"""
        for c in AUDITED
    ),
    rounded="null_rate_pct",
)
def _(t):
    return audit.cross_gap_lag_audit(features.monthly_lags(build_monthly(t)), AUDITED, "period_month", CALENDAR.periods_b)


FUTURE_AUDITED = AUDITED[:5]


@query(
    "future_lag_audit",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, fiscal_month, count(*) AS total_rows, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        100.0 * (count(*) - count({c})) / count(*) AS null_rate_pct, CASE WHEN count({c}) = 0 OR (SELECT count({c}) FROM monthly_future WHERE fiscal_month > 4) = 0 THEN 'NO'
        WHEN (SELECT max(v) FROM (SELECT coalesce(var_samp({c}), 0) AS v FROM monthly_future GROUP BY product_code)) = 0 THEN 'NO'
        ELSE 'POSSIBLE CASCADE' END AS cascade_risk FROM monthly_future GROUP BY 2"""
        for c in FUTURE_AUDITED
    ),
    rounded="null_rate_pct",
)
def _(t):
    future = t.table("future_monthly", lambda: future_monthly(t))
    return audit.future_lag_audit(future, FUTURE_AUDITED, CALENDAR.future_months[0])


#: Weeks that may look back over the gap, and the first week of the forecast quarter.
WEEKS_AFTER_GAP = [CALENDAR.period_week(CALENDAR.year_b, 1) + i for i in range(4)]
FIRST_FUTURE_WEEK = min(s["period_week"] for s in features.future_segments(CALENDAR))
WEEK_AUDITED = [c for c in features.WEEKLY_LAGS if "roll" not in c]


@query(
    "cross_gap_lag_audit_weekly",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, period_week, count(*) AS total_rows, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        100.0 * (count(*) - count({c})) / count(*) AS null_rate_pct, CASE WHEN period_week <> 53 THEN 'N/A (intra-block)'
        WHEN count({c}) > 0 THEN 'YES - CRITICAL VIOLATION' ELSE 'NO' END AS cross_gap_violation
        FROM weekly_lags WHERE period_week IN (53, 54, 55, 56) GROUP BY 2"""
        for c in WEEK_AUDITED
    ),
    rounded="null_rate_pct",
)
def _(t):
    lags = features.weekly_features(build_weekly(t, metadata(t)), metadata(t))
    return audit.cross_gap_lag_audit(lags, WEEK_AUDITED, "period_week", WEEKS_AFTER_GAP)


@query(
    "future_lag_audit_weekly",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, period_week, count(*) AS total_rows, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        100.0 * (count(*) - count({c})) / count(*) AS null_rate_pct,
        CASE WHEN count({c}) = 0 OR (SELECT count({c}) FROM weekly_future_lags WHERE period_week > 65) = 0 THEN 'NO'
        WHEN (SELECT max(v) FROM (SELECT coalesce(var_samp({c}), 0) AS v FROM weekly_future_lags GROUP BY product_code)) = 0 THEN 'NO'
        ELSE 'POSSIBLE CASCADE' END AS cascade_risk FROM weekly_future_lags GROUP BY 2"""
        for c in WEEK_AUDITED
    ),
    rounded="null_rate_pct",
)
def _(t):
    ahead = features.future_weekly_rows(build_weekly(t, metadata(t)), metadata(t), CALENDAR)
    return audit.future_lag_audit(ahead, WEEK_AUDITED, FIRST_FUTURE_WEEK, "period_week")


@query(
    "line_total_identity",
    """SELECT CAST(max(abs(line_total - quantity * unit_price)) AS DOUBLE) AS max_difference,
    CASE WHEN max(abs(line_total - quantity * unit_price)) < 1000 THEN 'PASS' ELSE 'FAIL' END AS status FROM order_line""",
)
def _(t):
    return audit.line_total_identity(t.lines())


@query("duplicate_lines", "SELECT order_id, product_code, count(*) AS n FROM order_line GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return audit.duplicate_lines(t.lines())


def fk_sql(check: str, violations: str) -> str:
    return f"SELECT '{check}' AS check, v AS violations, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({violations})"


@query(
    "fk_check",
    " UNION ALL ".join(
        [
            fk_sql("line -> order", "SELECT count(*) AS v FROM order_line WHERE order_id NOT IN (SELECT order_id FROM sales_order)"),
            fk_sql("line -> product", "SELECT count(*) AS v FROM order_line WHERE product_code NOT IN (SELECT product_code FROM dim_product)"),
            fk_sql("order -> customer", "SELECT count(*) AS v FROM sales_order WHERE customer_code NOT IN (SELECT customer_code FROM dim_customer)"),
            fk_sql("order has lines", "SELECT count(*) AS v FROM sales_order WHERE order_id NOT IN (SELECT order_id FROM order_line)"),
            fk_sql("quantity > 0", "SELECT count(*) FILTER (WHERE quantity <= 0) AS v FROM order_line"),
            fk_sql("unit_price >= 0", "SELECT count(*) FILTER (WHERE unit_price < 0) AS v FROM order_line"),
        ]
    ),
)
def _(t):
    lines, orders = t.lines(), t.orders()
    return audit.fk_check(
        [
            audit.orphan_count(lines, "order_id", orders, "order_id", "line -> order"),
            audit.orphan_count(lines, "product_code", t.product(), "product_code", "line -> product"),
            audit.orphan_count(orders, "customer_code", t.customer(), "customer_code", "order -> customer"),
            audit.orphan_count(orders, "order_id", lines, "order_id", "order has lines"),
            audit.predicate_count(lines, F.col("quantity") <= 0, "quantity > 0"),
            audit.predicate_count(lines, F.col("unit_price") < 0, "unit_price >= 0"),
        ]
    )


# indicators ------------------------------------------------------------------------


@query(
    "active_dealer_rate",
    """SELECT fiscal_year, fiscal_month, count(DISTINCT customer_code) AS active,
    count(DISTINCT customer_code) / (SELECT count(*) FROM customer) AS active_rate FROM fact GROUP BY 1, 2""",
    rounded="active_rate",
)
def _(t):
    return kpis.active_dealer_rate(t.fact("fiscal_year", "fiscal_month", "customer_code"), t.customer())


@query(
    "group_mix_share",
    """SELECT fiscal_year, fiscal_quarter, group_code, CAST(sum(line_total) AS DOUBLE) AS revenue,
    CAST(sum(line_total) AS DOUBLE) / CAST(sum(sum(line_total)) OVER (PARTITION BY fiscal_year, fiscal_quarter) AS DOUBLE) AS share
    FROM fact GROUP BY 1, 2, 3""",
    rounded="share",
)
def _(t):
    return kpis.group_mix_share(t.fact("fiscal_year", "fiscal_quarter", "group_code", "line_total"))


@query(
    "new_dealers_by_month",
    """SELECT CAST(date_trunc('month', first) AS DATE) AS month, count(*) AS new_dealers FROM (
    SELECT customer_code, min(order_date) AS first FROM fact GROUP BY 1) GROUP BY 1""",
)
def _(t):
    return kpis.new_dealers_by_month(t.fact("customer_code", "order_date"))


@query(
    "orders_and_qty_per_dealer",
    """SELECT fiscal_year, fiscal_month, count(DISTINCT customer_code) AS dealers, CAST(count(DISTINCT so_number) AS BIGINT) AS orders,
    CAST(sum(quantity) AS DOUBLE) AS quantity, count(DISTINCT so_number) / count(DISTINCT customer_code) AS orders_per_dealer,
    CAST(sum(quantity) AS DOUBLE) / count(DISTINCT customer_code) AS quantity_per_dealer FROM fact GROUP BY 1, 2""",
    rounded="orders_per_dealer quantity_per_dealer",
)
def _(t):
    return kpis.orders_and_quantity_per_dealer(t.fact("fiscal_year", "fiscal_month", "customer_code", "so_number", "quantity"))


@query(
    "zero_sales_sku_share",
    """SELECT fiscal_year, fiscal_month, count(DISTINCT product_code) AS sold_skus, (SELECT count(*) FROM part) AS all_skus,
    ((SELECT count(*) FROM part) - count(DISTINCT product_code)) / (SELECT count(*) FROM part) AS zero_share FROM fact GROUP BY 1, 2""",
    rounded="zero_share",
)
def _(t):
    return kpis.zero_sales_sku_share(t.fact("fiscal_year", "fiscal_month", "product_code"), t.product())


@query(
    "hhi_concentration",
    """SELECT count(*) AS dealers, sum(r * r) / (sum(r) * sum(r)) AS hhi FROM (SELECT customer_code, CAST(sum(line_total) AS DOUBLE) AS r
    FROM fact GROUP BY 1)""",
    rounded="hhi:9",
)
def _(t):
    return kpis.hhi_concentration(t.fact("customer_code", "line_total"))


@query(
    "sku_penetration",
    """SELECT product_code, count(DISTINCT province_id) AS n_provinces, count(DISTINCT province_id) / (SELECT count(*) FROM nation) AS penetration
    FROM fact GROUP BY 1""",
    rounded="penetration",
)
def _(t):
    return kpis.sku_penetration(t.fact("product_code", "province_id"), t.province())


@query("cross_sell_index", "SELECT customer_code, count(DISTINCT group_code) AS n_groups FROM fact GROUP BY 1")
def _(t):
    return kpis.cross_sell_index(t.fact("customer_code", "group_code"))


@query(
    "price_realization",
    """SELECT l.product_code, CAST(sum(l.unit_price) AS DOUBLE) / count(*) AS avg_price, p.p_retailprice AS list_price,
    CAST(sum(l.unit_price) AS DOUBLE) / count(*) / p.p_retailprice AS realization FROM order_line l
    JOIN part p ON CAST(p.p_partkey AS VARCHAR) = l.product_code GROUP BY 1, 3, p.p_partkey""",
)
def _(t):
    prices = t.raw("part").select(F.col("p_partkey").cast("string").alias("product_code"), F.col("p_retailprice").alias("list_price"))
    return kpis.price_realization(t.lines(), prices)


@query(
    "order_velocity",
    """SELECT customer_code, count(*) AS n_dates, avg(gap) AS mean_days_between_orders FROM (SELECT customer_code,
    CAST(order_date - lag(order_date) OVER (PARTITION BY customer_code ORDER BY order_date) AS DOUBLE) AS gap
    FROM (SELECT DISTINCT customer_code, order_date FROM sales_order)) GROUP BY 1""",
    rounded="mean_days_between_orders",
)
def _(t):
    return kpis.order_velocity(t.orders())


@query(
    "demand_cv",
    "SELECT product_code, count(*) AS n_months, stddev_samp(total_quantity) / avg(total_quantity) AS cv FROM monthly GROUP BY 1",
    rounded="cv",
)
def _(t):
    return kpis.demand_variation(sums_panel(t))


@query(
    "region_monthly",
    """SELECT fiscal_year, fiscal_month, region, CAST(sum(quantity) AS DOUBLE) AS total_qty, CAST(sum(line_total) AS DOUBLE) AS total_revenue
    FROM fact GROUP BY 1, 2, 3""",
)
def _(t):
    return kpis.region_monthly(t.fact("fiscal_year", "fiscal_month", "region", "quantity", "line_total"))


@query(
    "dealer_sku_monthly",
    """SELECT customer_code, product_code, fiscal_year, fiscal_month, CAST(sum(quantity) AS DOUBLE) AS total_qty,
    CAST(sum(line_total) AS DOUBLE) AS total_revenue FROM fact GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return kpis.dealer_sku_monthly(t.fact("customer_code", "product_code", "fiscal_year", "fiscal_month", "quantity", "line_total"))


@query(
    "price_change_log",
    """SELECT product_code, effective_from, order_id, line_id, CAST(unit_price AS DOUBLE) AS unit_price, CAST(prev AS DOUBLE) AS previous_price
    FROM (SELECT product_code, order_date AS effective_from, order_id, line_id, unit_price, lag(unit_price) OVER (PARTITION BY product_code
    ORDER BY order_date, order_id, line_id, unit_price) AS prev FROM fact) WHERE prev IS NULL OR prev <> unit_price""",
)
def _(t):
    return kpis.price_change_log(t.product_price())


@query(
    "price_volatility",
    """SELECT product_code, count(*) AS n, stddev_pop(CAST(unit_price AS DOUBLE)) / avg(CAST(unit_price AS DOUBLE)) AS volatility
    FROM order_line GROUP BY 1""",
    rounded="volatility",
)
def _(t):
    return kpis.price_volatility(t.lines())


@query(
    "winsorize",
    """SELECT f.order_id, f.line_id, f.product_code, f.group_code, CAST(f.line_total AS DOUBLE) AS line_total,
    least(greatest(CAST(f.line_total AS DOUBLE), lo), hi) AS line_total_capped FROM fact f JOIN (SELECT group_code,
    quantile_cont(CAST(line_total AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(line_total AS DOUBLE), 0.99) AS hi FROM fact GROUP BY 1) q
    ON q.group_code IS NOT DISTINCT FROM f.group_code""",
    rounded="line_total_capped:3",
)
def _(t):
    rows = t.fact("order_id", "line_id", "product_code", "group_code", "line_total")
    out = kpis.winsorize(rows, "group_code", "line_total")
    return out.withColumn("line_total", F.col("line_total").cast("double"))
