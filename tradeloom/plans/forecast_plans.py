"""Panels, features, baselines, scenario forecast, colour and slow movers."""

from datetime import date

from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates
from tradeloom.operators import features, forecast, panels, views
from tradeloom.operators.common import explode_rows
from tradeloom.plans.registry import cte, query
from tradeloom.sources.star import CALENDAR, SCENARIO_FACTORS, StarTables

PANEL_COLUMNS = [
    "product_code", "fiscal_year", "fiscal_month", "quantity", "line_total", "unit_price", "so_number",
    "customer_code", "province_name", "region",
]


def build_metadata(t: StarTables):
    sold = t.block_fact("product_code", "order_date")
    return panels.product_metadata(t.product(), t.product_line(), t.product_group(), sold, CALENDAR.last_month_start)


def metadata(t: StarTables):
    """Product metadata, written once: the panels and every later step join it."""
    return t.table("metadata", lambda: build_metadata(t))


def sums_panel(t: StarTables):
    """Monthly panel without median prices, for steps that read it once."""
    return panels.monthly_panel(t.block_fact(*PANEL_COLUMNS), build_metadata(t), CALENDAR, with_median=False)


def weekly_sums_panel(t: StarTables):
    fact = t.block_fact(*PANEL_COLUMNS, "order_date")
    return panels.weekly_panel(fact, build_metadata(t), CALENDAR, with_median=False)


def build_monthly(t: StarTables, meta=None):
    return panels.monthly_panel(t.block_fact(*PANEL_COLUMNS), build_metadata(t) if meta is None else meta, CALENDAR)


def build_weekly(t: StarTables, meta=None):
    return panels.weekly_panel(t.block_fact(*PANEL_COLUMNS, "order_date"), build_metadata(t) if meta is None else meta, CALENDAR)


def monthly(t: StarTables):
    """Monthly panel, written once: totals, group medians and lags all read it."""
    return t.table("monthly", lambda: build_monthly(t, metadata(t)))


def monthly_sums(t: StarTables):
    """Monthly panel without median prices, written once."""
    return t.table(
        "monthly_sums",
        lambda: panels.monthly_panel(t.block_fact(*PANEL_COLUMNS), metadata(t), CALENDAR, with_median=False),
    )


def monthly_features(t: StarTables):
    return features.monthly_features(monthly(t), metadata(t))


def future_monthly(t: StarTables):
    return features.future_monthly_rows(monthly(t), metadata(t), CALENDAR)


def observed_quarter(t: StarTables):
    """Quantity of the current quarter, the base of the test scenarios."""
    rows = monthly_sums(t).where(F.col("period_month").isin(*CALENDAR.periods_b))
    return rows.agg(F.sum("total_quantity").alias("observed"))


def scenario_totals(t: StarTables):
    observed = observed_quarter(t).scalar()
    return {name: observed * factor for name, factor in SCENARIO_FACTORS.items()}


def asp(t: StarTables):
    prices = t.product_price(last=CALENDAR.as_of)
    return forecast.asp_cascade(metadata(t), prices, monthly_sums(t), CALENDAR.as_of, CALENDAR.periods_b[-1])


def share_forecast(t: StarTables):
    return forecast.group_share_forecast(monthly_sums(t), metadata(t), asp(t), scenario_totals(t), CALENDAR)


def color_rows(t: StarTables):
    """SKU totals scaled to the base and the aggressive scenario."""
    skus = t.table(
        "sku_totals", lambda: forecast.sku_totals(forecast.enrich_missing(share_forecast(t), metadata(t)))
    )
    totals = scenario_totals(t)
    base = forecast.rescale_to_total(skus, totals["Base"], "Group_Share_Base")
    return base.unionByName(forecast.rescale_to_total(skus, totals["Aggressive"], "Group_Share_Aggressive"))


# shared SQL --------------------------------------------------------------------

PERIOD = "CAST((fiscal_year - 2000) * 12 + fiscal_month AS INTEGER)"
STATIC = "base_color, group_code_clean, group_name_clean, line_id_clean, line_name_clean, product_name"
cte(
    "meta",
    """
SELECT p.product_code, p.product_name, p.color, p.base_color, p.line_id_fk AS line_id_original,
  l.line_name AS line_name_original, l.group_code AS group_code_original, g.group_name AS group_name_original,
  CASE WHEN l.line_id IS NOT NULL THEN p.line_id_fk END AS line_id_clean,
  coalesce(l.line_name, 'UNKNOWN') AS line_name_clean, coalesce(l.group_code, 'UNKNOWN') AS group_code_clean,
  CASE WHEN l.line_id IS NULL THEN 'UNKNOWN' ELSE g.group_name END AS group_name_clean,
  CASE WHEN p.line_id_fk IS NULL THEN 'original_null' WHEN l.line_id IS NULL THEN 'join_failed'
    ELSE 'dimension_join' END AS mapping_source,
  'high' AS mapping_confidence, FALSE AS needs_manual_review,
  p.product_code IN (SELECT product_code FROM blocks WHERE order_date >= DATE '2001-03-01')
    AND p.product_code NOT IN (SELECT product_code FROM blocks WHERE order_date < DATE '2001-03-01') AS is_cold_start_march_sku
FROM dim_product p LEFT JOIN dim_line l ON l.line_id = p.line_id_fk LEFT JOIN dim_group g ON g.group_code = l.group_code""",
)
MEASURES = """CAST(sum(quantity) AS DOUBLE) AS total_quantity, CAST(sum(line_total) AS DOUBLE) AS total_revenue,
  count(DISTINCT so_number) AS n_orders, count(*) AS n_transactions, count(DISTINCT customer_code) AS n_dealers,
  count(DISTINCT province_name) AS n_provinces, count(DISTINCT region) AS n_regions,
  quantile_cont(CAST(unit_price AS DOUBLE), 0.5) AS median_unit_price,
  CAST(sum(line_total) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS implied_price"""
cte(
    "monthly",
    f"""
SELECT x.*, CASE fiscal_year WHEN 2000 THEN 'A' ELSE 'B' END AS block_id, {PERIOD} AS period_month,
  m.product_name, m.base_color, m.group_code_clean, m.group_name_clean, m.line_id_clean, m.line_name_clean
FROM (SELECT product_code, fiscal_year, fiscal_month, {MEASURES} FROM blocks GROUP BY 1, 2, 3) x
LEFT JOIN meta m USING (product_code)""",
)
cte(
    "weekly",
    f"""
SELECT x.*, CAST(week_start_date + INTERVAL 6 DAY AS DATE) AS week_end_date,
  CAST(isoyear(week_start_date) AS INTEGER) AS iso_year, CAST(weekofyear(week_start_date) AS INTEGER) AS iso_week,
  strftime(week_start_date, '%G-W%V') AS year_week,
  CASE fiscal_year WHEN 2000 THEN 'A' ELSE 'B' END AS block_id, {PERIOD} AS period_month,
  CAST((isoyear(week_start_date) - 2000) * 52 + weekofyear(week_start_date) AS INTEGER) AS period_week,
  m.product_name, m.base_color, m.group_code_clean, m.group_name_clean, m.line_id_clean, m.line_name_clean
FROM (SELECT product_code, fiscal_year, fiscal_month, CAST(date_trunc('week', order_date) AS DATE) AS week_start_date,
  {MEASURES} FROM blocks GROUP BY 1, 2, 3, 4) x LEFT JOIN meta m USING (product_code)""",
)
cte(
    "future_grid",
    """
SELECT product_code, 2001 AS fiscal_year, CAST(mm AS INTEGER) AS fiscal_month, CAST(12 + mm AS INTEGER) AS period_month,
  'B' AS block_id, product_name, base_color, group_code_clean, group_name_clean, line_id_clean, line_name_clean
FROM meta, (VALUES (4), (5), (6)) v(mm)""",
)
cte("monthly_all", "SELECT * FROM monthly UNION ALL BY NAME SELECT * FROM future_grid")


def feature_sql(base: str) -> str:
    return f"""
SELECT a.*, m.color, m.is_cold_start_march_sku, CASE WHEN a.group_code_clean = 'UNKNOWN' THEN 1 ELSE 0 END AS is_unknown_hierarchy,
  sin(2 * pi() * a.fiscal_month / 12) AS month_sin, cos(2 * pi() * a.fiscal_month / 12) AS month_cos,
  CASE WHEN a.fiscal_month <= 3 THEN 1 ELSE 0 END AS is_q1, CASE WHEN a.fiscal_month BETWEEN 4 AND 6 THEN 1 ELSE 0 END AS is_q2,
  CAST(day(last_day(make_date(a.fiscal_year, a.fiscal_month, 1))) AS INTEGER) AS days_in_month,
  a.period_month - f.first_period AS months_since_first_seen,
  CASE WHEN a.period_month = f.first_period THEN 1 ELSE 0 END AS is_new_sku,
  p1.total_quantity AS qty_lag_1, p2.total_quantity AS qty_lag_2, CAST(p1.n_dealers AS DOUBLE) AS n_dealers_lag1,
  p1.median_unit_price AS median_unit_price_lag1, p1.implied_price AS implied_price_lag1,
  CAST(p1.n_provinces AS DOUBLE) AS n_provinces_lag1, CAST(p1.n_regions AS DOUBLE) AS n_regions_lag1,
  g1.q AS group_total_quantity_lagged, p1.total_quantity / nullif(g1.q, 0) AS sku_share_in_group_lagged,
  p1.total_quantity / nullif(k1.q, 0) AS sku_share_total_lagged,
  p1.median_unit_price / g1.price AS price_vs_group_median_lag1,
  p1.total_quantity / p1.n_dealers AS avg_qty_per_dealer_lag1
FROM {base} a LEFT JOIN meta m USING (product_code)
LEFT JOIN (SELECT product_code, min(period_month) AS first_period FROM {base} GROUP BY 1) f USING (product_code)
LEFT JOIN {base} p1 ON p1.product_code = a.product_code AND p1.period_month = a.period_month - 1
LEFT JOIN {base} p2 ON p2.product_code = a.product_code AND p2.period_month = a.period_month - 2
LEFT JOIN (SELECT group_code_clean, period_month, coalesce(sum(total_quantity), 0) AS q, quantile_cont(median_unit_price, 0.5) AS price
  FROM {base} GROUP BY 1, 2) g1 ON g1.group_code_clean = p1.group_code_clean AND g1.period_month = p1.period_month
LEFT JOIN (SELECT period_month, coalesce(sum(total_quantity), 0) AS q FROM {base} GROUP BY 1) k1 ON k1.period_month = p1.period_month"""


cte("monthly_feat", feature_sql("monthly"))
cte("monthly_future", f"SELECT * FROM ({feature_sql('monthly_all')}) WHERE period_month > 15")
ROUND_MONTHLY = (
    "median_unit_price:4 month_sin month_cos median_unit_price_lag1:4 "
    "sku_share_in_group_lagged sku_share_total_lagged price_vs_group_median_lag1 avg_qty_per_dealer_lag1"
)


@query("product_metadata", "SELECT * FROM meta")
def _(t):
    return build_metadata(t)


@query("monthly_panel", "SELECT * FROM monthly", rounded="median_unit_price:4")
def _(t):
    return build_monthly(t)


@query("weekly_panel", "SELECT * FROM weekly", rounded="median_unit_price:4")
def _(t):
    return build_weekly(t)


@query(
    "period_summary",
    """SELECT fiscal_year, fiscal_month, year_week, count(DISTINCT product_code) AS n_skus, sum(total_quantity) AS sum_qty,
    CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) AS sum_rev FROM weekly GROUP BY 1, 2, 3""",
)
def _(t):
    return panels.period_summary(weekly_sums_panel(t), ["fiscal_year", "fiscal_month", "year_week"])


@query(
    "period_summary_monthly",
    """SELECT fiscal_year, fiscal_month, count(DISTINCT product_code) AS n_skus, sum(total_quantity) AS sum_qty,
    CAST(sum(CAST(total_revenue AS DECIMAL(20,2))) AS DOUBLE) AS sum_rev FROM monthly GROUP BY 1, 2""",
)
def _(t):
    return panels.period_summary(monthly_sums(t), ["fiscal_year", "fiscal_month"])


@query(
    "calendar_parts",
    "SELECT order_id, order_date, fiscal_year, fiscal_quarter, fiscal_month, week_of_year FROM sales_order",
)
def _(t):
    parts = dates.calendar_parts(F.col("order_date"))
    return t.orders().select("order_id", "order_date", *[c.alias(n) for n, c in parts.items()])


@query(
    "iso_week_key",
    """SELECT DISTINCT order_date, strftime(order_date, '%G-W%V') AS year_week,
    CAST(date_trunc('week', order_date) AS DATE) AS week_start_date,
    CAST(date_trunc('week', order_date) + INTERVAL 6 DAY AS DATE) AS week_end_date FROM sales_order""",
)
def _(t):
    d = F.col("order_date")
    days = t.orders().select("order_date").distinct()
    return days.select(
        "order_date",
        dates.year_week(d).alias("year_week"),
        dates.week_start(d).alias("week_start_date"),
        dates.week_end(d).alias("week_end_date"),
    )


@query(
    "period_month_index",
    f"""SELECT order_id, CASE WHEN fiscal_year IN (2000, 2001) AND fiscal_month <= 3 THEN {PERIOD} END AS period_month
    FROM sales_order""",
)
def _(t):
    return t.orders().select(
        "order_id", dates.period_month(F.col("fiscal_year"), F.col("fiscal_month"), CALENDAR).alias("period_month")
    )


@query(
    "block_label",
    """SELECT order_id, CASE WHEN fiscal_year = 2000 AND fiscal_month <= 3 THEN 'A'
    WHEN fiscal_year = 2001 AND fiscal_month <= 3 THEN 'B' ELSE 'GAP' END AS block_id FROM sales_order""",
)
def _(t):
    return t.orders().select(
        "order_id", dates.block_label(F.col("fiscal_year"), F.col("fiscal_month"), CALENDAR).alias("block_id")
    )


@query(
    "period_week_index",
    """SELECT order_id, CAST((isoyear(order_date) - 2000) * 52 + weekofyear(order_date) AS INTEGER) AS period_week,
    CAST(datediff('day', DATE '2000-01-03', CAST(date_trunc('week', order_date) AS DATE)) // 7 + 1 AS INTEGER) AS running_week
    FROM sales_order""",
)
def _(t):
    d = F.col("order_date")
    return t.orders().select(
        "order_id",
        dates.period_week(dates.iso_year(d), F.weekofyear(d), CALENDAR).alias("period_week"),
        dates.running_week(d, CALENDAR).alias("running_week"),
    )


@query(
    "cyclic_month",
    """SELECT order_id, sin(2 * pi() * fiscal_month / 12) AS month_sin, cos(2 * pi() * fiscal_month / 12) AS month_cos,
    CASE WHEN fiscal_month <= 3 THEN 1 ELSE 0 END AS is_q1, CASE WHEN fiscal_month BETWEEN 4 AND 6 THEN 1 ELSE 0 END AS is_q2,
    CAST(day(last_day(order_date)) AS INTEGER) AS days_in_month FROM sales_order""",
    rounded="month_sin month_cos",
)
def _(t):
    rows = t.orders().select("order_id", "fiscal_year", "fiscal_month")
    return features.calendar_features(rows).drop("fiscal_year", "fiscal_month")


def lag_rows(t):
    return sums_panel(t).select("product_code", "period_month", "total_quantity")


@query(
    "safe_lag",
    """SELECT a.product_code, a.period_month, p1.total_quantity AS lag_1, p2.total_quantity AS lag_2 FROM monthly a
    LEFT JOIN monthly p1 ON p1.product_code = a.product_code AND p1.period_month = a.period_month - 1
    LEFT JOIN monthly p2 ON p2.product_code = a.product_code AND p2.period_month = a.period_month - 2""",
)
def _(t):
    return lag_rows(t).select(
        "product_code",
        "period_month",
        features.safe_lag("total_quantity", 1, "period_month").alias("lag_1"),
        features.safe_lag("total_quantity", 2, "period_month").alias("lag_2"),
    )


@query(
    "calendar_self_join",
    """SELECT a.product_code, a.period_month, a.total_quantity, p.total_quantity AS quantity_year_before FROM monthly a
    LEFT JOIN monthly p ON p.product_code = a.product_code AND p.period_month = a.period_month - 12""",
)
def _(t):
    return lag_rows(t).withColumn("quantity_year_before", features.safe_lag("total_quantity", 12, "period_month"))


@query(
    "monthly_lag_features",
    """SELECT product_code, period_month, qty_lag_1, qty_lag_2, n_dealers_lag1, median_unit_price_lag1,
    implied_price_lag1, n_provinces_lag1, n_regions_lag1 FROM monthly_feat""",
    rounded="median_unit_price_lag1:4",
)
def _(t):
    return features.monthly_lags(build_monthly(t)).select("product_code", "period_month", *features.MONTHLY_LAGS)


@query(
    "hierarchy_share_lags",
    """SELECT product_code, period_month, group_total_quantity_lagged, sku_share_in_group_lagged, sku_share_total_lagged
    FROM monthly_feat""",
    rounded="sku_share_in_group_lagged sku_share_total_lagged",
)
def _(t):
    rows = features.hierarchy_lags(features.monthly_lags(monthly(t)))
    return rows.select(
        "product_code", "period_month", "group_total_quantity_lagged", "sku_share_in_group_lagged", "sku_share_total_lagged"
    )


@query(
    "price_position_lag",
    "SELECT product_code, period_month, price_vs_group_median_lag1 FROM monthly_feat",
    rounded="price_vs_group_median_lag1",
)
def _(t):
    rows = features.hierarchy_lags(features.monthly_lags(monthly(t)))
    return rows.select("product_code", "period_month", "price_vs_group_median_lag1")


@query(
    "dealer_intensity_lag",
    "SELECT product_code, period_month, avg_qty_per_dealer_lag1 FROM monthly_feat",
    rounded="avg_qty_per_dealer_lag1",
)
def _(t):
    quantity = features.safe_lag("total_quantity", 1, "period_month")
    dealers = features.safe_lag("n_dealers", 1, "period_month")
    return sums_panel(t).select(
        "product_code", "period_month", F.try_divide(quantity, dealers).alias("avg_qty_per_dealer_lag1")
    )


@query("monthly_features", "SELECT * FROM monthly_feat", rounded=ROUND_MONTHLY)
def _(t):
    return monthly_features(t)


def lag_week_sql(base: str, value: str) -> str:
    return f"(SELECT product_code, period_week, {value} FROM {base} GROUP BY 1, 2)"


WEEK_LAGS = """p1.q AS qty_lag_1w, p2.q AS qty_lag_2w, p4.q AS qty_lag_4w, p1.d AS n_dealers_lag_1w,
  p1.m AS median_unit_price_lag_1w, p1.p AS implied_price_lag_1w,
  (coalesce(p1.q, 0) + coalesce(p2.q, 0)) / nullif((p1.q IS NOT NULL)::INT + (p2.q IS NOT NULL)::INT, 0) AS qty_roll_mean_2w,
  (coalesce(p1.q, 0) + coalesce(p2.q, 0) + coalesce(p3.q, 0) + coalesce(p4.q, 0)) / nullif((p1.q IS NOT NULL)::INT
    + (p2.q IS NOT NULL)::INT + (p3.q IS NOT NULL)::INT + (p4.q IS NOT NULL)::INT, 0) AS qty_roll_mean_4w"""


def week_joins(base: str) -> str:
    return " ".join(
        f"LEFT JOIN {base} p{i} ON p{i}.product_code = a.product_code AND p{i}.period_week = a.period_week - {i}"
        for i in (1, 2, 3, 4)
    )


cte(
    "week_mean",
    """SELECT product_code, period_week, avg(total_quantity) AS q, CAST(avg(n_dealers) AS DOUBLE) AS d,
    avg(median_unit_price) AS m, avg(implied_price) AS p FROM weekly GROUP BY 1, 2""",
)
ROUND_WEEKLY = "median_unit_price_lag_1w:4 implied_price_lag_1w qty_roll_mean_2w qty_roll_mean_4w qty_lag_1w qty_lag_2w qty_lag_4w n_dealers_lag_1w"


@query(
    "weekly_lag_features",
    f"SELECT a.product_code, a.fiscal_month, a.period_week, {WEEK_LAGS} FROM weekly a {week_joins('week_mean')}",
    rounded=ROUND_WEEKLY,
)
def _(t):
    return features.weekly_features(build_weekly(t, metadata(t)), metadata(t)).select(
        "product_code", "fiscal_month", "period_week", *features.WEEKLY_LAGS
    )


cte("weekly_lags", f"SELECT a.product_code, a.period_week, {WEEK_LAGS} FROM weekly a {week_joins('week_mean')}")
cte("weekly_future_lags", f"SELECT a.product_code, a.period_week, {WEEK_LAGS} FROM future_week a {week_joins('week_total')}")


@query(
    "safe_rolling_mean",
    f"""SELECT a.product_code, a.fiscal_month, a.period_week,
    (coalesce(p1.q, 0) + coalesce(p2.q, 0) + coalesce(p3.q, 0) + coalesce(p4.q, 0)) / nullif((p1.q IS NOT NULL)::INT
    + (p2.q IS NOT NULL)::INT + (p3.q IS NOT NULL)::INT + (p4.q IS NOT NULL)::INT, 0) AS roll_4
    FROM weekly a {week_joins('week_mean')}""",
    rounded="roll_4",
)
def _(t):
    roll = features.safe_rolling_mean("total_quantity", 4, "period_week")
    return weekly_sums_panel(t).select("product_code", "fiscal_month", "period_week", roll.alias("roll_4"))


@query(
    "week_of_month",
    """SELECT *, CASE WHEN week_of_month = 1 THEN 1 ELSE 0 END AS is_month_start_week, CASE WHEN week_of_month = max(week_of_month)
    OVER (PARTITION BY product_code, fiscal_year, fiscal_month) THEN 1 ELSE 0 END AS is_month_end_week FROM (
    SELECT product_code, fiscal_year, fiscal_month, week_start_date, CAST(dense_rank() OVER (PARTITION BY product_code,
    fiscal_year, fiscal_month ORDER BY week_start_date) AS INTEGER) AS week_of_month FROM weekly)""",
)
def _(t):
    rows = weekly_sums_panel(t).select("product_code", "fiscal_year", "fiscal_month", "week_start_date")
    return panels.week_of_month(rows, "week_start_date", ["product_code", "fiscal_year", "fiscal_month"])


@query("future_monthly_rows", "SELECT * FROM monthly_future", rounded=ROUND_MONTHLY)
def _(t):
    return future_monthly(t)


@query(
    "past_week_segments",
    """SELECT strftime(d, '%G-W%V') AS year_week, CAST(month(d) AS INTEGER) AS fiscal_month, min(d) AS segment_start_date,
    max(d) AS segment_end_date, count(*) AS days_in_segment, CASE WHEN count(*) < 7 THEN 1 ELSE 0 END AS is_partial_week
    FROM (SELECT DISTINCT order_date AS d FROM sales_order) GROUP BY 1, 2""",
)
def _(t):
    return panels.week_segments(t.orders().select(F.col("order_date").alias("day")).distinct())


cte(
    "future_segment",
    """
SELECT strftime(d, '%G-W%V') AS year_week, 2001 AS fiscal_year, CAST(month(d) AS INTEGER) AS fiscal_month, min(d) AS segment_start_date,
  max(d) AS segment_end_date, CAST(count(*) AS INTEGER) AS days_in_segment, CASE WHEN count(*) < 7 THEN 1 ELSE 0 END AS is_partial_week,
  CAST((isoyear(d) - 2000) * 52 + weekofyear(d) AS INTEGER) AS period_week, 'B' AS block_id
FROM (SELECT CAST(unnest(generate_series(DATE '2001-04-01', DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS d)
GROUP BY year_week, fiscal_month, period_week""",
)
cte(
    "future_week",
    """
SELECT product_code, s.*, product_name, base_color, group_code_clean, group_name_clean, line_id_clean, line_name_clean, color,
  is_cold_start_march_sku, CASE WHEN group_code_clean = 'UNKNOWN' THEN 1 ELSE 0 END AS is_unknown_hierarchy
FROM meta, future_segment s""",
)
@query(
    "future_week_segments",
    """SELECT product_code, year_week, fiscal_year, fiscal_month, segment_start_date, segment_end_date, days_in_segment, is_partial_week,
    period_week, block_id FROM meta, future_segment""",
)
def _(t):
    """The weeks of the forecast quarter, cut at month ends, for every SKU."""
    kinds = {
        "year_week": "string", "fiscal_year": "int", "fiscal_month": "int", "segment_start_date": "date", "segment_end_date": "date",
        "days_in_segment": "int", "is_partial_week": "int", "period_week": "int", "block_id": "string",
    }
    return explode_rows(metadata(t).select("product_code"), features.future_segments(CALENDAR), kinds)


cte(
    "week_total",
    """
SELECT product_code, period_week, coalesce(sum(total_quantity), 0) AS q, CAST(max(n_dealers) AS DOUBLE) AS d,
  quantile_cont(median_unit_price, 0.5) AS m, avg(implied_price) AS p
FROM (SELECT product_code, period_week, total_quantity, n_dealers, median_unit_price, implied_price FROM weekly
  UNION ALL SELECT product_code, period_week, NULL, NULL, NULL, NULL FROM future_week) GROUP BY 1, 2""",
)


@query(
    "future_weekly_rows",
    f"""SELECT a.*, sin(2 * pi() * a.fiscal_month / 12) AS month_sin, cos(2 * pi() * a.fiscal_month / 12) AS month_cos,
    CAST(NULL AS DOUBLE) AS total_quantity, CAST(NULL AS DOUBLE) AS total_revenue,
    CASE WHEN a.week_of_month = 1 THEN 1 ELSE 0 END AS is_month_start_week, CASE WHEN a.week_of_month = max(a.week_of_month)
      OVER (PARTITION BY a.product_code, a.fiscal_month) THEN 1 ELSE 0 END AS is_month_end_week, {WEEK_LAGS}
    FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY product_code, fiscal_month ORDER BY segment_start_date) AS INTEGER)
      AS week_of_month FROM future_week) a {week_joins('week_total')}""",
    rounded=ROUND_WEEKLY + " month_sin month_cos",
)
def _(t):
    return features.future_weekly_rows(build_weekly(t, metadata(t)), metadata(t), CALENDAR)


@query(
    "union_history_future",
    "SELECT product_code, period_month, block_id, total_quantity, n_dealers, group_code_clean FROM monthly_all",
)
def _(t):
    months = [
        {"period_month": p, "block_id": "B"} for p in CALENDAR.periods_future
    ]
    future = explode_rows(
        metadata(t).select("product_code", "group_code_clean"), months, {"period_month": "int", "block_id": "string"}
    )
    history = monthly_sums(t).select(
        "product_code", "period_month", "block_id", "total_quantity", "n_dealers", "group_code_clean"
    )
    return history.unionByName(future, allowMissingColumns=True)


@query(
    "cross_join_grid",
    "SELECT product_code, CAST(mm AS INTEGER) AS period_month FROM dim_product, (VALUES (1), (2), (3), (13), (14), (15)) v(mm)",
)
def _(t):
    periods = [{"period_month": p} for p in CALENDAR.periods_a + CALENDAR.periods_b]
    return explode_rows(t.product().select("product_code"), periods, {"period_month": "int"})


@query(
    "feature_sets",
    "SELECT " + ", ".join(params.FEATURE_SETS["monthly_extended_features"]) + " FROM monthly_feat",
    rounded=" ".join(c for c in ROUND_MONTHLY.split() if c.split(":")[0] in params.FEATURE_SETS["monthly_extended_features"]),
)
def _(t):
    return features.select_features(monthly_features(t), "monthly_extended_features")


@query(
    "zero_fill_panel",
    """SELECT f.product_code, CAST(v.p AS INTEGER) AS period_month, coalesce(m.total_quantity, 0) AS total_quantity,
    coalesce(m.total_revenue, 0) AS total_revenue, CASE WHEN m.product_code IS NULL THEN 1 ELSE 0 END AS is_zero_sales_row
    FROM (SELECT product_code, min(period_month) AS fp FROM monthly GROUP BY 1) f
    JOIN (VALUES (1), (2), (3), (13), (14), (15)) v(p) ON v.p >= f.fp
    LEFT JOIN monthly m ON m.product_code = f.product_code AND m.period_month = v.p""",
)
def _(t):
    return features.zero_fill_panel(monthly_sums(t), CALENDAR)


# baselines ---------------------------------------------------------------------

cte(
    "early",
    "SELECT product_code, sum(total_quantity) AS early_quantity FROM monthly WHERE period_month IN (13, 14) GROUP BY 1",
)
cte(
    "volume",
    """SELECT product_code, early_quantity, CASE WHEN early_quantity >= (SELECT quantile_cont(early_quantity, 0.75) FROM early)
    THEN 'High Volume' ELSE 'Low Volume' END AS volume_segment FROM early""",
)
cte(
    "baseline",
    """
SELECT f.product_code, f.group_code_clean, f.total_quantity, coalesce(v.volume_segment, 'Low Volume') AS volume_segment,
  coalesce(f.qty_lag_1, 0) AS naive_last,
  coalesce((coalesce(f.qty_lag_1, 0) + coalesce(f.qty_lag_2, 0))
    / nullif((f.qty_lag_1 IS NOT NULL)::INT + (f.qty_lag_2 IS NOT NULL)::INT, 0), 0) AS jan_feb_avg,
  coalesce((SELECT sum(early_quantity) FROM early) / (SELECT count(DISTINCT period_month) FROM monthly WHERE period_month IN (13, 14))
    * (v.early_quantity / (SELECT sum(early_quantity) FROM early)), 0) AS group_share_proportional
FROM monthly_feat f LEFT JOIN volume v USING (product_code) WHERE f.period_month = 15""",
)
cte(
    "baseline_long",
    """SELECT product_code, group_code_clean, total_quantity, volume_segment, model, predicted FROM baseline
    UNPIVOT (predicted FOR model IN (naive_last, jan_feb_avg, group_share_proportional))""",
)
METRICS = """avg(abs(total_quantity - predicted)) AS mae, sqrt(avg((total_quantity - predicted) ** 2)) AS rmse,
  sum(abs(total_quantity - predicted)) / nullif(sum(abs(total_quantity)), 0) AS wmape,
  avg(CASE WHEN abs(total_quantity) + abs(predicted) = 0 THEN 0
    ELSE abs(total_quantity - predicted) / ((abs(total_quantity) + abs(predicted)) / 2) END) AS smape,
  avg(predicted - total_quantity) AS mean_error,
  sum(predicted - total_quantity) / CASE WHEN sum(total_quantity) > 0 THEN sum(total_quantity) END AS bias_ratio"""
ROUND_METRICS = "mae rmse wmape smape mean_error bias_ratio"


def baselines(t):
    quantity = {f"qty_lag_{n}": features.safe_lag("total_quantity", n, "period_month") for n in (1, 2)}
    return forecast.baseline_predictions(monthly_sums(t).withColumns(quantity), CALENDAR)


def long_baselines(t):
    return forecast.unpivot_models(baselines(t), forecast.MODELS)


@query("volume_segment", "SELECT * FROM volume")
def _(t):
    return forecast.volume_segments(sums_panel(t), CALENDAR)


@query("naive_last", "SELECT product_code, total_quantity, naive_last FROM baseline")
def _(t):
    return baselines(t).select("product_code", "total_quantity", "naive_last")


@query("two_month_avg", "SELECT product_code, total_quantity, jan_feb_avg FROM baseline")
def _(t):
    return baselines(t).select("product_code", "total_quantity", "jan_feb_avg")


@query(
    "share_proportional",
    "SELECT product_code, total_quantity, group_share_proportional FROM baseline",
    rounded="group_share_proportional",
)
def _(t):
    return baselines(t).select("product_code", "total_quantity", "group_share_proportional")


@query(
    "forecast_metrics",
    f"SELECT model, mae, rmse, wmape, smape, mean_error AS bias FROM (SELECT model, {METRICS} FROM baseline_long GROUP BY 1)",
    rounded="mae rmse wmape smape bias",
)
def _(t):
    return forecast.forecast_metrics(long_baselines(t)).select(
        "model", "mae", "rmse", "wmape", "smape", F.col("mean_error").alias("bias")
    )


@query("forecast_metrics_bias", f"SELECT model, {METRICS} FROM baseline_long GROUP BY 1", rounded=ROUND_METRICS)
def _(t):
    return forecast.forecast_metrics(long_baselines(t))


@query(
    "metrics_by_segment",
    f"""SELECT model, 'Overall' AS segment, {METRICS} FROM baseline_long GROUP BY 1
    UNION ALL SELECT model, 'Group: ' || group_code_clean, {METRICS} FROM baseline_long GROUP BY 1, 2
    UNION ALL SELECT model, 'Volume: ' || volume_segment, {METRICS} FROM baseline_long GROUP BY 1, 2""",
    rounded=ROUND_METRICS,
)
def _(t):
    return forecast.metrics_by_segment(long_baselines(t))


cte(
    "own_price",
    """SELECT product_code, CAST(unit_price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY product_code
    ORDER BY order_date DESC, order_id DESC, line_id DESC, unit_price DESC) AS rn FROM fact WHERE order_date <= DATE '2001-03-31')
    WHERE rn = 1""",
)
cte(
    "asp",
    """
SELECT s.product_code, coalesce(o.price, x.implied_price, ge.price, gt.price, ov.price) AS asp_used,
  CASE WHEN o.price IS NOT NULL THEN 'a. SKU latest effective price'
    WHEN x.implied_price IS NOT NULL THEN 'b. SKU latest transaction unit_price'
    WHEN ge.price IS NOT NULL THEN 'c. group-level latest effective ASP'
    WHEN gt.price IS NOT NULL THEN 'd. group-level latest transaction ASP' ELSE 'e. overall latest ASP' END AS asp_source,
  DATE '2001-03-31' AS asp_cutoff_date
FROM meta s LEFT JOIN own_price o USING (product_code)
LEFT JOIN (SELECT product_code, arg_max(implied_price, period_month) AS implied_price FROM monthly GROUP BY 1) x USING (product_code)
LEFT JOIN (SELECT group_code_clean, sum(CAST(price AS DECIMAL(28,2)))::DOUBLE / count(*) AS price FROM own_price
  JOIN meta USING (product_code) GROUP BY 1) ge ON ge.group_code_clean = s.group_code_clean
LEFT JOIN (SELECT group_code_clean, sum(total_revenue) / sum(total_quantity) AS price FROM monthly WHERE period_month = 15
  GROUP BY 1) gt ON gt.group_code_clean = s.group_code_clean
CROSS JOIN (SELECT sum(total_revenue) / sum(total_quantity) AS price FROM monthly WHERE period_month = 15) ov""",
)


@query("asp_cascade", "SELECT * FROM asp", rounded="asp_used")
def _(t):
    return asp(t)


cte(
    "scenario_total",
    """SELECT s.scenario, q.total * s.factor AS total FROM (VALUES ('Conservative', CAST(0.85 AS DOUBLE)), ('Base', CAST(1.0 AS DOUBLE)),
    ('Aggressive', CAST(1.1425 AS DOUBLE))) s(scenario, factor),
    (SELECT CAST(sum(quantity) AS DOUBLE) AS total FROM blocks WHERE fiscal_year = 2001) q""",
)
cte(
    "sku_share",
    """
SELECT product_code, group_code_clean, sku_quantity, sum(sku_quantity) OVER (PARTITION BY group_code_clean) AS group_quantity,
  sum(sku_quantity) OVER (PARTITION BY group_code_clean) / sum(sku_quantity) OVER () AS group_share,
  coalesce(sku_quantity / nullif(sum(sku_quantity) OVER (PARTITION BY group_code_clean), 0), 0) AS sku_share_in_group
FROM (SELECT m.product_code, m.group_code_clean, coalesce(sum(p.total_quantity), 0) AS sku_quantity FROM meta m
  LEFT JOIN monthly p ON p.product_code = m.product_code AND p.period_month IN (13, 14, 15) GROUP BY 1, 2)""",
)
cte(
    "share_fc",
    """
SELECT k.product_code, m.product_name, k.group_code_clean, m.line_id_clean, m.base_color, 2001 AS fiscal_year,
  CAST(v.mm AS INTEGER) AS fiscal_month, s.scenario, s.total * k.group_share * k.sku_share_in_group / 3.0 AS predicted_quantity,
  a.asp_used, a.asp_source, a.asp_cutoff_date, s.total * k.group_share * k.sku_share_in_group / 3.0 * a.asp_used AS estimated_revenue,
  'core_baseline' AS method_type, 'group_share_proportional' AS model_name
FROM sku_share k JOIN meta m USING (product_code) LEFT JOIN asp a USING (product_code)
CROSS JOIN scenario_total s CROSS JOIN (VALUES (4), (5), (6)) v(mm)""",
)


@query("group_share_forecast", "SELECT * FROM share_fc", rounded="predicted_quantity asp_used estimated_revenue:3")
def _(t):
    return share_forecast(t)


cte(
    "scenario_sum",
    """SELECT scenario, sum(predicted_quantity) AS total_quantity, sum(estimated_revenue) AS total_revenue FROM share_fc GROUP BY 1""",
)


@query(
    "scenario_summary",
    """SELECT scenario, total_quantity, total_revenue, total_quantity / 3 AS monthly_avg_quantity,
    total_revenue / 3 AS monthly_avg_revenue FROM scenario_sum""",
    rounded="total_quantity:4 total_revenue:1 monthly_avg_quantity:4 monthly_avg_revenue:1",
)
def _(t):
    return forecast.scenario_summary(share_forecast(t))


@query(
    "scenario_delta",
    """SELECT a.scenario, a.total_quantity, a.total_revenue, a.total_quantity - b.total_quantity AS delta_quantity,
    a.total_revenue - b.total_revenue AS delta_revenue FROM scenario_sum a,
    (SELECT * FROM scenario_sum WHERE scenario = 'Base') b""",
    rounded="total_quantity:4 total_revenue:1 delta_quantity:4 delta_revenue:1",
)
def _(t):
    return forecast.scenario_delta(forecast.scenario_summary(share_forecast(t)))


@query(
    "join_right_keep_all_skus",
    """SELECT m.product_code, coalesce(sum(p.total_quantity), 0) AS sku_quantity, coalesce(m.group_code_clean, 'UNKNOWN') AS group_code_clean
    FROM meta m LEFT JOIN monthly p ON p.product_code = m.product_code AND p.period_month IN (13, 14, 15) GROUP BY 1, 3""",
)
def _(t):
    sold = (
        monthly_sums(t)
        .where(F.col("period_month").isin(*CALENDAR.periods_b))
        .groupBy("product_code")
        .agg(F.sum("total_quantity").alias("sku_quantity"))
    )
    return forecast.keep_all_skus(sold, metadata(t))


# colour --------------------------------------------------------------------------


@query(
    "enrich_missing",
    """SELECT f.product_code, f.fiscal_month, f.scenario, f.predicted_quantity, f.product_name, f.group_code_clean, f.line_id_clean,
    f.base_color, coalesce(m.color, 'UNKNOWN') AS color FROM share_fc f LEFT JOIN meta m USING (product_code)""",
    rounded="predicted_quantity",
)
def _(t):
    return forecast.enrich_missing(share_forecast(t), metadata(t)).select(
        "product_code", "fiscal_month", "scenario", "predicted_quantity", "product_name", "group_code_clean", "line_id_clean",
        "base_color", "color",
    )


cte(
    "color_row",
    """
SELECT x.product_code, x.base_color, x.color, x.q * s.total / w.q AS predicted_quantity, x.r * s.total / w.q AS estimated_revenue,
  'Group_Share_' || s.scenario AS model_scenario
FROM (SELECT product_code, f.base_color, m.color, sum(predicted_quantity) AS q, sum(estimated_revenue) AS r FROM share_fc f
  JOIN meta m USING (product_code) GROUP BY 1, 2, 3) x,
  (SELECT sum(predicted_quantity) AS q FROM share_fc) w, scenario_total s WHERE s.scenario IN ('Base', 'Aggressive')""",
)
cte(
    "color_fc",
    """SELECT model_scenario, base_color, color, sum(predicted_quantity) AS predicted_quantity,
    sum(estimated_revenue) AS estimated_revenue FROM color_row GROUP BY 1, 2, 3""",
)


@query("rescale_to_total", "SELECT * FROM color_row", rounded="predicted_quantity estimated_revenue:6")
def _(t):
    return color_rows(t)


@query("color_forecast", "SELECT * FROM color_fc", rounded="predicted_quantity:4 estimated_revenue:1")
def _(t):
    return forecast.color_forecast(color_rows(t))


@query(
    "reconcile_totals",
    """SELECT 'Group_Share_' || scenario AS model_scenario, total AS expected, q AS actual,
    CASE WHEN abs(total - q) <= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM scenario_total JOIN (SELECT model_scenario,
    sum(predicted_quantity) AS q FROM color_row GROUP BY 1) ON model_scenario = 'Group_Share_' || scenario""",
    rounded="expected:4 actual:4",
)
def _(t):
    rows = color_rows(t)
    expected = explode_rows(
        observed_quarter(t),
        [
            {"model_scenario": f"Group_Share_{n}", "factor": SCENARIO_FACTORS[n]} for n in ("Base", "Aggressive")
        ],
        {"model_scenario": "string", "factor": "double"},
    ).select("model_scenario", (F.col("observed") * F.col("factor")).alias("expected"))
    return forecast.reconcile_totals(rows, expected)


PIVOT = ["Group_Share_Base", "Group_Share_Aggressive"]


@query(
    "pivot_scenarios",
    "SELECT base_color, color, "
    + ", ".join(
        f"coalesce(sum({c}) FILTER (WHERE model_scenario = '{s}'), 0) AS {s}_{n}"
        for s in PIVOT
        for c, n in (("predicted_quantity", "Qty"), ("estimated_revenue", "Rev"))
    )
    + " FROM color_fc GROUP BY 1, 2",
    rounded=" ".join(f"{s}_Qty:4 {s}_Rev:1" for s in PIVOT),
)
def _(t):
    return views.pivot_sums(
        forecast.color_forecast(color_rows(t)),
        ["base_color", "color"],
        "model_scenario",
        PIVOT,
        {"predicted_quantity": "Qty", "estimated_revenue": "Rev"},
    )


@query(
    "color_contribution",
    """SELECT base_color, quantity, revenue, quantity / sum(quantity) OVER () AS quantity_share, revenue / sum(revenue) OVER ()
    AS revenue_share FROM (SELECT base_color, sum(predicted_quantity) AS quantity, sum(estimated_revenue) AS revenue FROM color_row
    WHERE model_scenario = 'Group_Share_Base' GROUP BY 1) ORDER BY quantity DESC LIMIT 10""",
    rounded="quantity:4 revenue:1 quantity_share revenue_share",
)
def _(t):
    return forecast.color_contribution(color_rows(t), "Group_Share_Base")


cte(
    "quarter_chg",
    """
SELECT *, CASE WHEN q1_previous > 0 THEN (q1_current - q1_previous) / q1_previous END AS q1_yoy_change FROM (
SELECT m.product_code, m.group_code_clean, m.base_color, m.color,
  coalesce(sum(p.total_quantity) FILTER (WHERE p.period_month IN (1, 2, 3)), 0) AS q1_previous,
  coalesce(sum(p.total_quantity) FILTER (WHERE p.period_month IN (13, 14, 15)), 0) AS q1_current,
  coalesce(sum(p.total_quantity) FILTER (WHERE p.period_month = 13), 0) AS month_1,
  coalesce(sum(p.total_quantity) FILTER (WHERE p.period_month = 14), 0) AS month_2,
  coalesce(sum(p.total_quantity) FILTER (WHERE p.period_month = 15), 0) AS month_3
FROM meta m LEFT JOIN monthly p USING (product_code) GROUP BY 1, 2, 3, 4)""",
)


@query("yoy_change", "SELECT * FROM quarter_chg", rounded="q1_yoy_change")
def _(t):
    skus = metadata(t).select("product_code", "group_code_clean", "base_color", "color")
    return forecast.quarter_change(monthly_sums(t), skus, CALENDAR)


@query(
    "slow_moving_flags",
    """SELECT * EXCLUDE (p10, lim), CASE slow_moving_flag
      WHEN 'new_or_uncertain' THEN 'SKU appeared very recently (Mar01 or Q1_2001) with no Q1_00 history.'
      WHEN 'red_no_demand' THEN 'Q1_2001 total_quantity = 0.'
      WHEN 'amber_slow_moving' THEN 'Q1_2001 qty (' || CAST(q1_current AS VARCHAR) || ') is <= group P10/10 threshold ('
        || CASE WHEN lim = 10 THEN '10' ELSE CAST(lim AS VARCHAR) END || ').'
      WHEN 'declining_activity' THEN 'Q1_2001 qty dropped by ' || printf('%.1f', abs(q1_yoy_change * 100)) || '% vs Q1_2000.'
      ELSE 'Normal activity.' END AS slow_moving_reason,
    CASE slow_moving_flag WHEN 'new_or_uncertain' THEN 'Monitor demand closely. Do not classify as slow-moving yet.'
      WHEN 'red_no_demand' THEN 'Phase out or stop production unless required for strategic reasons.'
      WHEN 'amber_slow_moving' THEN 'Deprioritize in production. Liquidate excess inventory.'
      WHEN 'declining_activity' THEN 'Review marketing/pricing. Reduce production forecast.'
      ELSE 'Follow Q2 forecast.' END AS recommended_action
    FROM (SELECT q.*, p10, greatest(10, coalesce(p10, 10)) AS lim, CASE WHEN q1_previous = 0 AND month_1 = 0 AND month_2 = 0 THEN 'new_or_uncertain'
      WHEN q1_current = 0 THEN 'red_no_demand' WHEN q1_current <= greatest(10, coalesce(p10, 10)) THEN 'amber_slow_moving'
      WHEN q1_previous >= 10 AND q1_yoy_change <= -0.5 THEN 'declining_activity' ELSE 'healthy' END AS slow_moving_flag
    FROM quarter_chg q LEFT JOIN (SELECT group_code_clean, quantile_cont(q1_current, 0.1) AS p10 FROM quarter_chg
      WHERE q1_current > 0 GROUP BY 1) g USING (group_code_clean))""",
    rounded="q1_yoy_change",
)
def _(t):
    return forecast.slow_moving_flags(monthly_sums(t), metadata(t), CALENDAR)
