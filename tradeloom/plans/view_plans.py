"""Aggregates, shares, rankings and set operations."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeloom.functions import dates
from tradeloom.operators import dealers, ranking, rollups, views
from tradeloom.plans.base_sql import AS_OF
from tradeloom.plans.registry import cte, query
from tradeloom.sources import layout
from tradeloom.sources.star import CALENDAR, FACT_COLUMNS, THRESHOLDS, StarTables
from tradeloom.storage import materialize, work_folder

SUMS = "CAST(sum(quantity) AS DOUBLE) AS total_qty, CAST(sum(line_total) AS DOUBLE) AS total_revenue"


def customer_rfm(t: StarTables):
    fact = t.fact("customer_code", "order_date", "so_number", "line_total", last=CALENDAR.as_of)
    return dealers.rfm_base(fact, t.customer(), t.province(), CALENDAR.as_of)


cte(
    "rfm",
    f"""
SELECT f.customer_code, c.customer_name, c.customer_tier, coalesce(v.province_name, 'Chưa xác định') AS province_name,
  coalesce(v.region, 'Chưa xác định') AS region, max(f.order_date) AS last_order_date,
  CAST({AS_OF} - max(f.order_date) AS INTEGER) AS recency_days, count(DISTINCT f.so_number) AS frequency,
  CAST(sum(f.line_total) AS DOUBLE) AS monetary
FROM past f JOIN dim_customer c ON c.customer_code = f.customer_code
LEFT JOIN dim_province v ON v.province_id = c.province_id
GROUP BY ALL""",
)
cte(
    "bcg",
    """
SELECT *, round(100.0 * total_revenue / (SELECT sum(CAST(total_revenue AS DECIMAL(38,2)))::DOUBLE FROM bcg_lines), 1)
    AS revenue_share_pct,
  CASE WHEN rev_previous = 0 AND rev_current > 0 THEN 'New Launch'
    WHEN total_revenue > median_revenue AND coalesce(growth_pct_yoy, 0) > 0 THEN 'Stars'
    WHEN total_revenue > median_revenue THEN 'Cash Cows'
    WHEN coalesce(growth_pct_yoy, 0) > 0 THEN 'Question Marks' ELSE 'Dogs' END AS bcg_category
FROM (SELECT *, (SELECT quantile_cont(total_revenue, 0.5) FROM bcg_lines) AS median_revenue FROM bcg_lines)""",
)
cte(
    "bcg_lines",
    f"""
SELECT *, round(100.0 * (rev_current - rev_previous) / nullif(rev_previous, 0), 1) AS growth_pct_yoy FROM (
  SELECT coalesce(line_name, 'Chưa phân loại') AS line_name, coalesce(group_code, 'UNKNOWN') AS group_code,
    coalesce(group_name, 'Chưa phân loại') AS group_name,
    CAST(sum(CASE WHEN fiscal_year = 2000 AND fiscal_month BETWEEN 1 AND 3 THEN line_total ELSE 0 END) AS DOUBLE) AS rev_previous,
    CAST(sum(CASE WHEN fiscal_year = 2001 AND fiscal_month BETWEEN 1 AND 3 THEN line_total ELSE 0 END) AS DOUBLE) AS rev_current,
    {SUMS}
  FROM past GROUP BY 1, 2, 3)""",
)


@query(
    "monthly_by_group",
    f"""SELECT fiscal_year, fiscal_month, group_code, group_name, count(DISTINCT so_number) AS order_count, {SUMS},
    round(CAST(sum(unit_price) AS DOUBLE) / count(unit_price), 0) AS avg_unit_price FROM fact GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return views.monthly_by_group(
        t.fact("fiscal_year", "fiscal_month", "group_code", "group_name", "so_number", "quantity", "line_total", "unit_price")
    )


@query(
    "customer_period",
    f"""SELECT fiscal_year, fiscal_quarter, customer_code, customer_name, province_name, region,
    count(DISTINCT so_number) AS order_count, {SUMS}, max(order_date) AS last_order_date,
    min(order_date) AS first_order_date FROM fact GROUP BY 1, 2, 3, 4, 5, 6""",
)
def _(t):
    return views.customer_period(
        t.fact("fiscal_year", "fiscal_quarter", "customer_code", "customer_name", "province_name", "region",
               "so_number", "quantity", "line_total", "order_date")
    )


@query(
    "sku_monthly",
    f"""SELECT fiscal_year, fiscal_month, product_code, product_name, color, line_name, group_code, {SUMS},
    count(DISTINCT so_number) AS order_count FROM fact GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def _(t):
    return views.sku_monthly(
        t.fact("fiscal_year", "fiscal_month", "product_code", "product_name", "color", "line_name", "group_code",
               "so_number", "quantity", "line_total")
    )


@query(
    "customer_activity",
    f"""SELECT c.customer_code, c.customer_name, c.province_id, v.province_name, v.region,
    count(DISTINCT o.so_number) AS total_orders, CAST(sum(l.line_total) AS DOUBLE) AS total_revenue,
    min(o.order_date) AS first_order_date, max(o.order_date) AS last_order_date,
    CAST({AS_OF} - max(o.order_date) AS INTEGER) AS days_since_last_order
    FROM dim_customer c LEFT JOIN sales_order o ON o.customer_code = c.customer_code AND o.order_date <= {AS_OF}
    LEFT JOIN order_line l ON l.order_id = o.order_id LEFT JOIN dim_province v ON v.province_id = c.province_id
    GROUP BY 1, 2, 3, 4, 5""",
)
def _(t):
    return views.customer_activity(
        t.customer(), t.orders(last=CALENDAR.as_of), t.lines(), t.province(), CALENDAR.as_of
    )


@query(
    "order_rollup",
    """SELECT o.order_id, CAST(coalesce(sum(line_total), 0) AS DOUBLE) AS total_amount,
    CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity, count(l.order_id) AS line_count
    FROM sales_order o LEFT JOIN order_line l ON l.order_id = o.order_id GROUP BY 1""",
)
def _(t):
    return views.order_rollup(t.orders(), t.lines())


@query(
    "order_rollup_truncated",
    """SELECT o.order_id, CAST(coalesce(sum(CAST(trunc(line_total) AS BIGINT)), 0) AS DOUBLE) AS total_amount,
    CAST(coalesce(sum(CAST(trunc(quantity) AS BIGINT)), 0) AS BIGINT) AS total_quantity, count(l.order_id) AS line_count
    FROM sales_order o LEFT JOIN order_line l ON l.order_id = o.order_id GROUP BY 1""",
)
def _(t):
    return views.order_rollup(t.orders(), t.lines(), truncate=True)


@query(
    "conditional_sum",
    """SELECT line_name, group_code, group_name, rev_previous, rev_current, total_qty, total_revenue FROM bcg_lines""",
)
def _(t):
    return views.quarter_revenue_by_line(bcg_fact(t), CALENDAR)


def bcg_fact(t):
    return t.fact("line_name", "group_code", "group_name", "fiscal_year", "fiscal_month", "line_total", "quantity",
                  last=CALENDAR.as_of)


@query("bcg_matrix", "SELECT * FROM bcg", rounded="median_revenue", digits=4)
def _(t):
    return views.bcg_matrix(bcg_fact(t), CALENDAR)


@query(
    "top_n_growth",
    """SELECT line_name, rev_previous, rev_current, growth_pct_yoy FROM bcg
    ORDER BY growth_pct_yoy DESC NULLS LAST, line_name LIMIT 10""",
)
def _(t):
    return views.top_growth(views.bcg_matrix(bcg_fact(t), CALENDAR))


@query(
    "filtered_count",
    """SELECT count(*) FILTER (WHERE province_id IS NULL) AS missing_province_id,
    count(*) FILTER (WHERE province_name IS NULL) AS missing_province_name,
    count(*) FILTER (WHERE region IS NULL) AS missing_region FROM fact""",
)
def _(t):
    return views.missing_geography_counts(t.fact("province_id", "province_name", "region"))


@query("status_counts", "SELECT processing_status, count(*) AS email_count FROM mail_log GROUP BY 1")
def _(t):
    return views.status_counts(t.email_log())


@query(
    "region_summary",
    f"SELECT coalesce(region, 'Chưa xác định') AS region, count(*) AS fact_rows, {SUMS} FROM fact GROUP BY 1",
)
def _(t):
    return views.region_summary(t.fact("region", "quantity", "line_total"))


@query(
    "kpi_totals",
    """SELECT CAST(sum(line_total) AS DOUBLE) AS revenue, CAST(sum(quantity) AS DOUBLE) AS quantity,
    count(DISTINCT so_number) AS orders, count(DISTINCT customer_code) AS customers,
    CAST(sum(line_total) AS DOUBLE) / count(DISTINCT so_number) AS avg_order_value FROM fact""",
    rounded="avg_order_value",
)
def _(t):
    return views.kpi_totals(t.fact("line_total", "quantity", "so_number", "customer_code"))


@query(
    "null_profile",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM fact" for c in FACT_COLUMNS
    ) + ") WHERE n_null > 0",
)
def _(t):
    return views.null_profile(t.fact())


@query(
    "order_rollup_incremental",
    """SELECT o.order_id, CAST(coalesce(sum(line_total), 0) AS DOUBLE) AS total_amount,
    CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity, count(l.order_id) AS line_count
    FROM sales_order o LEFT JOIN (SELECT * FROM order_line WHERE line_id <> 6) l ON l.order_id = o.order_id GROUP BY 1""",
)
def _(t):
    """Totals kept up through inserts, deletes and updates of lines."""
    path = f"{work_folder(t.spark)}/order_totals-{uuid.uuid4().hex}"
    lines, number = t.lines(), F.col("line_id")
    wrong = F.when(number == 2, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(10,2)")
    rollups.start_order_totals(lines.where(number != 3).withColumn("quantity", wrong), path)
    late = lines.where(number == 3).withColumn("sign", F.lit(1))
    rollups.change_order_totals(late, path)
    old = lines.where(number == 2).withColumn("quantity", wrong).withColumn("sign", F.lit(-1))
    new = lines.where(number == 2).withColumn("sign", F.lit(1))
    gone = lines.where(number == 6).withColumn("sign", F.lit(-1))
    rollups.change_order_totals(old.unionByName(new).unionByName(gone), path)
    return rollups.order_totals(t.spark, t.orders(), path)


GRAINS = {"week": ["fiscal_year", "week_of_year"], "month": ["fiscal_year", "fiscal_quarter", "fiscal_month"],
          "quarter": ["fiscal_year", "fiscal_quarter"], "year": ["fiscal_year"]}


@query(
    "distinct_sets_by_grain",
    " UNION ALL ".join(
        f"SELECT '{grain}' AS grain, " + ", ".join(k if k in own else f"CAST(NULL AS INTEGER) AS {k}" for k in ("fiscal_year", "fiscal_quarter", "fiscal_month", "week_of_year"))
        + f", CAST(count(DISTINCT customer_code) AS BIGINT) AS n_dealers FROM fact GROUP BY {', '.join(own)}"
        for grain, own in GRAINS.items()
    ),
)
def _(t):
    """Dealers by week, month, quarter and year from one table of sets."""
    keys = ["fiscal_year", "fiscal_quarter", "fiscal_month", "week_of_year"]
    fact = t.fact(*keys, "customer_code")
    sets = materialize(rollups.distinct_sets(fact, keys, "customer_code", rollups.dictionary(t.customer(), "customer_code")), "dealer-sets")
    return rollups.sizes_by_grain(sets, GRAINS, keys, "n_dealers")


def fact_by_order(t):
    """The lines laid out by order."""
    lines = t.fact("order_id", "line_id", "product_code", "quantity", "line_total")
    return t.once("fact_by_order", lambda: layout.laid_out(lines, "order_id", "fact_by_order"))


def orders_by_order(t):
    orders = t.orders().select("order_id", "order_date", "customer_code")
    return t.once("orders_by_order", lambda: layout.laid_out(orders, "order_id", "orders_by_order"))


@query(
    "order_mix",
    """SELECT o.order_id, o.order_date, o.customer_code, count(*) AS n_lines, count(DISTINCT f.product_code) AS n_skus,
    CAST(sum(f.line_total) AS DOUBLE) AS revenue, CAST(max(f.line_total) AS DOUBLE) AS largest_line
    FROM sales_order o JOIN fact f ON f.order_id = o.order_id GROUP BY 1, 2, 3""",
)
def _(t):
    """What an order holds, from tables laid out by order: neither the join nor the groups move rows."""
    joined = fact_by_order(t).join(orders_by_order(t).hint("merge"), "order_id")  # bucket by bucket, also where one side is small
    return joined.groupBy("order_id", "order_date", "customer_code").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("product_code").alias("n_skus"),
        F.sum("line_total").cast("double").alias("revenue"), F.max("line_total").cast("double").alias("largest_line"),
    )


@query("value_counts", "SELECT color, count(*) AS n FROM fact GROUP BY 1")
def _(t):
    return views.value_counts(t.fact("color"), "color")


@query(
    "active_entities_by_month",
    "SELECT fiscal_year, fiscal_month, count(DISTINCT customer_code) AS n_dealers FROM fact GROUP BY 1, 2",
)
def _(t):
    return views.active_customers_by_month(t.fact("fiscal_year", "fiscal_month", "customer_code"))


@query(
    "median_by_group",
    """SELECT region, count(*) AS n, avg(recency_days) AS avg_recency_days, avg(frequency) AS avg_frequency,
    CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_monetary,
    quantile_cont(monetary, 0.5) AS median_monetary FROM rfm GROUP BY 1""",
    rounded="avg_recency_days avg_frequency avg_monetary median_monetary",
    digits=4,
)
def _(t):
    return views.summary_by_group(customer_rfm(t), "region", "NULL")


MEDIANS = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median_{c}" for c in ("recency_days", "frequency", "monetary"))


@query(
    "median_by_region_and_tier",
    f"""SELECT 'region' AS level, region AS name, count(*) AS n, {MEDIANS} FROM rfm GROUP BY region
    UNION ALL SELECT 'tier', customer_tier, count(*), {MEDIANS} FROM rfm GROUP BY customer_tier""",
    rounded="median_recency_days median_frequency median_monetary",
    digits=4,
)
def _(t):
    rfm = customer_rfm(t).withColumnRenamed("customer_tier", "tier")
    return views.medians_by_level(rfm, ["region", "tier"], ["recency_days", "frequency", "monetary"])


@query(
    "quantile_by_group",
    """SELECT group_code, quantile_cont(qty, 0.1) AS p10 FROM (SELECT group_code, product_code,
    CAST(sum(quantity) AS DOUBLE) AS qty FROM blocks WHERE fiscal_year = 2001 GROUP BY 1, 2)
    WHERE qty > 0 GROUP BY 1""",
    rounded="p10",
)
def _(t):
    fact = t.block_fact("group_code", "product_code", "quantity").where(F.col("fiscal_year") == CALENDAR.year_b)
    skus = fact.groupBy("group_code", "product_code").agg(F.sum("quantity").cast("double").alias("qty"))
    return ranking.quantiles(skus.where("qty > 0"), ["group_code"], "qty", {"p10": 0.1})


@query(
    "share_of_total",
    """SELECT line_name, total_revenue, total_revenue / (SELECT CAST(sum(line_total) AS DOUBLE) FROM past) AS share
    FROM (SELECT line_name, CAST(sum(line_total) AS DOUBLE) AS total_revenue FROM past GROUP BY 1)""",
    rounded="share",
)
def _(t):
    lines = t.fact("line_name", "line_total", last=CALENDAR.as_of).groupBy("line_name").agg(
        F.sum("line_total").cast("double").alias("total_revenue")
    )
    return ranking.with_share(lines, "total_revenue", "share")


@query(
    "share_within_group",
    """SELECT group_code, product_code, qty, qty / sum(qty) OVER (PARTITION BY group_code) AS share_in_group FROM (
    SELECT group_code, product_code, CAST(sum(quantity) AS DOUBLE) AS qty FROM past GROUP BY 1, 2)""",
    rounded="share_in_group",
)
def _(t):
    skus = t.fact("group_code", "product_code", "quantity", last=CALENDAR.as_of).groupBy("group_code", "product_code").agg(
        F.sum("quantity").cast("double").alias("qty")
    )
    return views.share_within_group(skus, "group_code", "qty", "share_in_group")


@query(
    "mom_growth",
    """SELECT a.month, a.revenue, b.revenue AS previous_revenue, (a.revenue - b.revenue) / abs(b.revenue) AS growth
    FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(sum(line_total) AS DOUBLE) AS revenue
      FROM fact GROUP BY 1) a
    LEFT JOIN (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(sum(line_total) AS DOUBLE) AS revenue
      FROM fact GROUP BY 1) b ON b.month = a.month - INTERVAL 1 MONTH""",
    rounded="growth",
)
def _(t):
    return views.month_on_month(t.fact("order_date", "line_total"))


@query(
    "top_n_groups",
    """SELECT province_name, revenue, revenue / (SELECT CAST(sum(line_total) AS DOUBLE) FROM fact) AS share FROM (
    SELECT province_name, CAST(sum(line_total) AS DOUBLE) AS revenue FROM fact GROUP BY 1)
    WHERE province_name IS NOT NULL ORDER BY revenue DESC, province_name LIMIT 10""",
    rounded="share",
)
def _(t):
    return views.top_groups(t.fact("province_name", "line_total"), "province_name")


@query("bottom_n", "SELECT * FROM rfm ORDER BY monetary, customer_code LIMIT 10")
def _(t):
    return views.bottom_entities(customer_rfm(t), "monetary", "customer_code")


@query("top_by_recency", "SELECT * FROM rfm ORDER BY recency_days DESC, customer_code LIMIT 10")
def _(t):
    return views.top_entities(customer_rfm(t), "recency_days", "customer_code")


@query(
    "union_all_counts",
    """SELECT 'province' AS table_name, count(*) AS row_count FROM dim_province
    UNION ALL SELECT 'province_correction_map', count(*) FROM dim_correction
    UNION ALL SELECT 'province_clean', count(*) FROM dim_province
    UNION ALL SELECT 'customer', count(*) FROM dim_customer UNION ALL SELECT 'fact_sales', count(*) FROM fact""",
)
def _(t):
    return views.table_counts(
        {
            "province": t.province(),
            "province_correction_map": t.province_corrections(),
            "province_clean": t.province(),
            "customer": t.customer(),
            "fact_sales": t.fact("order_id"),
        }
    )


@query(
    "latest_per_key",
    """SELECT customer_code, order_date, so_number FROM (SELECT *, row_number() OVER (PARTITION BY customer_code
    ORDER BY order_date DESC, order_id DESC) AS rn FROM sales_order) WHERE rn = 1""",
)
def _(t):
    return views.latest_per_key(t.orders(), "customer_code", ["order_date", "order_id"], ["order_date", "so_number"])


@query(
    "asof_latest_price",
    """SELECT product_code, CAST(unit_price AS DOUBLE) AS unit_price, order_date AS effective_from FROM (
    SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY order_date DESC, order_id DESC, line_id DESC,
    unit_price DESC) AS rn FROM past) WHERE rn = 1""",
)
def _(t):
    latest = views.latest_price(t.product_price(last=CALENDAR.as_of), CALENDAR.as_of)
    return latest.withColumn("unit_price", F.col("unit_price").cast("double"))


@query(
    "pareto_top_share",
    """SELECT CAST(count(*) AS BIGINT) AS top_customers, CAST(sum(m) AS DOUBLE) AS top_revenue,
    (SELECT CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) FROM rfm) AS total_revenue,
    CAST(sum(m) AS DOUBLE) / (SELECT CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) FROM rfm) AS top_share
    FROM (SELECT CAST(monetary AS DECIMAL(20,2)) AS m, rank() OVER (ORDER BY monetary DESC) AS rk,
      count(*) OVER () AS n FROM rfm) WHERE rk <= ceil(n * 0.2)""",
    rounded="top_share",
)
def _(t):
    return views.pareto_top_share(customer_rfm(t), "monetary")


@query(
    "q1_yoy",
    """SELECT current, previous, (current - previous) / abs(previous) AS growth FROM (SELECT
    CAST(sum(line_total) FILTER (WHERE fiscal_year = 2001 AND fiscal_month <= 3) AS DOUBLE) AS current,
    CAST(sum(line_total) FILTER (WHERE fiscal_year = 2000 AND fiscal_month <= 3) AS DOUBLE) AS previous FROM past)""",
    rounded="growth",
)
def _(t):
    return views.quarter_growth(t.block_fact("line_total"), CALENDAR)


@query(
    "percent_rank_avg",
    """SELECT customer_code, frequency, (rank() OVER (ORDER BY frequency)
    + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0) / count(*) OVER () AS value_score FROM rfm""",
    rounded="value_score",
)
def _(t):
    base = customer_rfm(t).select("customer_code", "frequency")
    return ranking.average_rank_pct(base, "frequency", "value_score")


NTILE_SQL = """SELECT customer_code, recency_days, frequency, monetary,
  CAST((rn_r - 1) * 5 // n + 1 AS INTEGER) AS r_score, CAST((rn_f - 1) * 5 // n + 1 AS INTEGER) AS f_score,
  CAST((rn_m - 1) * 5 // n + 1 AS INTEGER) AS m_score FROM (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY recency_days, md5(customer_code)) AS rn_r,
  row_number() OVER (ORDER BY frequency DESC, md5(customer_code)) AS rn_f,
  row_number() OVER (ORDER BY monetary DESC, md5(customer_code)) AS rn_m FROM rfm)"""


def equal_size_scores(t):
    df = t.table("rfm", lambda: customer_rfm(t).select("customer_code", "recency_days", "frequency", "monetary"))
    scores = {"r_score": ("recency_days", False), "f_score": ("frequency", True), "m_score": ("monetary", True)}
    return ranking.equal_size_scores(df, "customer_code", scores)


cte("ntile_scores", NTILE_SQL)


@query("ntile_reference", "SELECT * FROM ntile_scores")
def _(t):
    return equal_size_scores(t)


@query(
    "spot_check_rows",
    """SELECT customer_code, monetary, position FROM (SELECT customer_code, monetary, count(*) OVER () AS n,
    row_number() OVER (ORDER BY monetary DESC, md5(customer_code)) - 1 AS position FROM rfm)
    WHERE position < 5 OR position >= n - 5 OR position BETWEEN n // 2 - 1 AND n // 2 + 1""",
)
def _(t):
    return views.spot_check(customer_rfm(t).select("customer_code", "monetary"), "monetary", "customer_code")


@query(
    "first_seen_age",
    """SELECT product_code, month, CAST(datediff('month', first_month, month) AS INTEGER) AS months_since_first_seen,
    CASE WHEN month = first_month THEN 1 ELSE 0 END AS is_new_sku FROM (
      SELECT product_code, month, min(month) OVER (PARTITION BY product_code) AS first_month FROM (
        SELECT DISTINCT product_code, CAST(date_trunc('month', order_date) AS DATE) AS month FROM fact))""",
)
def _(t):
    months = t.fact("product_code", "order_date").select(
        "product_code", dates.month_start(F.col("order_date")).alias("month")
    ).distinct()
    first = F.min("month").over(Window.partitionBy("product_code"))
    age = F.months_between("month", first).cast("int")
    return months.select(
        "product_code", "month", age.alias("months_since_first_seen"), dates.flag(age == 0).alias("is_new_sku")
    )


@query("except_keys", "SELECT product_code FROM order_line EXCEPT SELECT product_code FROM dim_product WHERE line_id_fk IS NOT NULL")
def _(t):
    return t.lines().select("product_code").subtract(t.product().where("line_id_fk is not null").select("product_code"))


@query("distinct_keys", "SELECT DISTINCT product_code, customer_code FROM fact")
def _(t):
    return t.fact("product_code", "customer_code").distinct()


@query("filter_period", "SELECT order_id, order_date, so_number FROM sales_order WHERE order_date BETWEEN DATE '2001-03-01' AND DATE '2001-03-31'")
def _(t):
    return t.orders(CALENDAR.last_month_start, CALENDAR.as_of).select("order_id", "order_date", "so_number")


@query(
    "filter_null_geo",
    """SELECT customer_code, so_number, product_code, CAST(line_total AS DOUBLE) AS line_total FROM fact
    WHERE province_id IS NULL OR province_name IS NULL OR region IS NULL""",
)
def _(t):
    fact = t.fact("customer_code", "so_number", "product_code", "line_total", "province_id", "province_name", "region")
    return fact.where(views.missing_geography()).select(
        "customer_code", "so_number", "product_code", F.col("line_total").cast("double").alias("line_total")
    )


@query("drop_raw_columns", "SELECT * EXCLUDE (product_name, color) FROM dim_product")
def _(t):
    return t.product().drop("product_name", "color")


@query("rfm_base", "SELECT * FROM rfm")
def _(t):
    return customer_rfm(t)


cte(
    "rfm_scored",
    """
SELECT *, CASE WHEN recency_days <= 30 THEN 5 WHEN recency_days <= 60 THEN 4 WHEN recency_days <= 90 THEN 3
    WHEN recency_days <= 180 THEN 2 ELSE 1 END AS r_score,
  CASE WHEN frequency >= 15 THEN 5 WHEN frequency >= 12 THEN 4 WHEN frequency >= 10 THEN 3 WHEN frequency >= 6 THEN 2
    ELSE 1 END AS f_score,
  CASE WHEN monetary >= 3000000 THEN 5 WHEN monetary >= 1900000 THEN 4 WHEN monetary >= 1500000 THEN 3
    WHEN monetary >= 1000000 THEN 2 ELSE 1 END AS m_score
FROM rfm""",
)
SEGMENT_CASE = """CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
    WHEN r_score >= 4 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal'
    WHEN r_score >= 3 AND f_score <= 2 AND m_score >= 4 THEN 'Big Spender'
    WHEN r_score >= 3 AND f_score >= 2 AND m_score >= 2 THEN 'Potential'
    WHEN r_score >= 4 AND f_score = 1 AND m_score <= 3 THEN 'New'
    WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
    WHEN r_score <= 2 AND (f_score >= 2 OR m_score >= 2) THEN 'Hibernating' ELSE 'Lost' END AS rfm_segment"""
cte("rfm_segmented", f"SELECT *, r_score + f_score + m_score AS rfm_total, {SEGMENT_CASE} FROM rfm_scored")


@query("rfm_scores", "SELECT * FROM rfm_scored")
def _(t):
    return dealers.rfm_scores(customer_rfm(t), THRESHOLDS)


@query("rfm_segments", "SELECT * FROM rfm_segmented")
def _(t):
    return dealers.rfm_segments(customer_rfm(t), THRESHOLDS)


@query("rfm_segment_counts", "SELECT rfm_segment, count(*) AS n_customers FROM rfm_segmented GROUP BY 1")
def _(t):
    return dealers.segment_counts(dealers.rfm_segments(customer_rfm(t), THRESHOLDS))
