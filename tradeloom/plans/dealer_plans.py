"""Dealer snapshots, scores and rules; distributions; ranking metrics of a score."""

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates
from tradeloom.operators import dealers, stats
from tradeloom.plans.registry import cte, query
from tradeloom.plans.view_plans import SEGMENT_CASE, customer_rfm, equal_size_scores
from tradeloom.sources.star import CALENDAR, THRESHOLDS, StarTables

LAST = replace(CALENDAR, snapshot_dates=CALENDAR.snapshot_dates[-1:])
VALIDATION = replace(CALENDAR, snapshot_dates=CALENDAR.snapshot_dates[3:4])


def snapshots(t: StarTables, cal=CALENDAR):
    fact = t.fact(
        "customer_code", "order_date", "order_id", "product_code", "group_code", "quantity", "line_total",
        last=max(cal.snapshot_dates) + timedelta(days=30),
    )
    return dealers.snapshot_features(fact, cal, THRESHOLDS)


def with_probability(snap):
    """A fixed stand-in for the model's probability, so that SQL can state the same result."""
    return snap.withColumn("p_order_next_30d", F.exp(-F.col("recency_days") / 60.0))


def ranking(t: StarTables):
    """Scored last snapshot; written before ranking because the value rank reads it twice."""
    return dealers.priority_ranking(with_probability(t.table("snapshot", lambda: snapshots(t, LAST))))


def validation_scores(t: StarTables):
    columns = ["customer_code", "rfm_segment", "target_active_next_30d", "recency_days"]
    snap = t.table("validation", lambda: snapshots(t, VALIDATION).select(*columns))
    return with_probability(snap).withColumnRenamed("target_active_next_30d", "y").withColumnRenamed("p_order_next_30d", "p")


cte(
    "cutoffs",
    """SELECT * FROM (VALUES (DATE '2000-01-31'), (DATE '2000-02-29'), (DATE '2001-01-31'), (DATE '2001-02-28'),
    (DATE '2001-03-31')) v(d)""",
)
PAST = "f.order_date <= c.d"


def amount(cond: str, column: str, name: str) -> str:
    return f"CAST(coalesce(sum({column}) FILTER (WHERE {cond}), 0) AS DOUBLE) AS {name}"


LAST_30 = f"{PAST} AND f.order_date > c.d - 30"
BEFORE_30 = "f.order_date <= c.d - 30 AND f.order_date > c.d - 60"
IN_Q = f"{PAST} AND c.d >= DATE '2001-03-31' AND f.order_date BETWEEN DATE "
cte(
    "snap_raw",
    f"""
SELECT f.customer_code, c.d AS snapshot_date, max(f.order_date) FILTER (WHERE {PAST}) AS last_order_date,
  min(f.order_date) FILTER (WHERE {PAST}) AS first_order_date,
  max(CASE WHEN f.order_date > c.d THEN 1 ELSE 0 END) AS target_active_next_30d,
  {amount(PAST, 'line_total', 'monetary')}, {amount(PAST, 'quantity', 'total_qty')},
  {amount(LAST_30, 'quantity', 'quantity_recent_30d')}, {amount(BEFORE_30, 'quantity', 'quantity_previous_30d')},
  {amount(LAST_30, 'line_total', 'revenue_recent_30d')}, {amount(BEFORE_30, 'line_total', 'revenue_previous_30d')},
  {amount(IN_Q + "'2001-01-01' AND DATE '2001-03-31'", 'quantity', 'quantity_q1_current')},
  {amount(IN_Q + "'2000-01-01' AND DATE '2000-03-31'", 'quantity', 'quantity_q1_previous')},
  count(DISTINCT order_id) FILTER (WHERE {PAST}) AS frequency, count(DISTINCT product_code) FILTER (WHERE {PAST}) AS n_skus_bought,
  count(DISTINCT group_code) FILTER (WHERE {PAST}) AS n_groups_bought,
  count(DISTINCT order_id) FILTER (WHERE {PAST} AND f.order_date > c.d - 90) AS orders_recent_90d
FROM fact f JOIN cutoffs c ON f.order_date <= c.d + 30 GROUP BY 1, 2""",
)
cte(
    "snap",
    f"""
SELECT * EXCLUDE (r_score, f_score, m_score), {SEGMENT_CASE} FROM (
SELECT *, CAST(snapshot_date - last_order_date AS INTEGER) AS recency_days, monetary / frequency AS avg_order_size,
  monetary / total_qty AS avg_unit_price, CASE WHEN snapshot_date - first_order_date <= 30 THEN 1 ELSE 0 END AS is_new_dealer,
  ln(1 + quantity_recent_30d) - ln(1 + quantity_previous_30d) AS qty_momentum,
  ln(1 + revenue_recent_30d) - ln(1 + revenue_previous_30d) AS revenue_momentum,
  CASE WHEN quantity_q1_previous > 0 THEN ln(1 + quantity_q1_current) - ln(1 + quantity_q1_previous) ELSE 0 END AS yoy_momentum,
  CASE WHEN snapshot_date - last_order_date <= 30 THEN 5 WHEN snapshot_date - last_order_date <= 60 THEN 4
    WHEN snapshot_date - last_order_date <= 90 THEN 3 WHEN snapshot_date - last_order_date <= 180 THEN 2 ELSE 1 END AS r_score,
  CASE WHEN frequency >= 15 THEN 5 WHEN frequency >= 12 THEN 4 WHEN frequency >= 10 THEN 3 WHEN frequency >= 6 THEN 2 ELSE 1 END AS f_score,
  CASE WHEN monetary >= 3000000 THEN 5 WHEN monetary >= 1900000 THEN 4 WHEN monetary >= 1500000 THEN 3
    WHEN monetary >= 1000000 THEN 2 ELSE 1 END AS m_score
FROM snap_raw WHERE last_order_date IS NOT NULL)""",
)
cte(
    "trend",
    """
SELECT *, 100 * (0.35::DOUBLE * short_term_score + 0.25::DOUBLE * yoy_score + 0.25::DOUBLE * recency_score
  + 0.15::DOUBLE * frequency_score) AS purchase_trend_score FROM (
SELECT *, exp(-recency_days / 60.0::DOUBLE) AS p_order_next_30d,
  0.5::DOUBLE / (1 + exp(-qty_momentum)) + 0.5::DOUBLE / (1 + exp(-revenue_momentum)) AS short_term_score,
  1 / (1 + exp(-yoy_momentum)) AS yoy_score, exp(-recency_days / 45.0::DOUBLE) AS recency_score,
  least(greatest(orders_recent_90d / 3.0::DOUBLE, 0), 1) AS frequency_score
FROM snap WHERE snapshot_date = DATE '2001-03-31')""",
)
cte(
    "scored",
    """
SELECT *, 100 * least(greatest((0.45::DOUBLE * p_order_next_30d * value_score + 0.35::DOUBLE * churn_risk_score * value_score
    * greatest(0, 1 - purchase_trend_score / 100) + 0.20::DOUBLE * p_order_next_30d * purchase_trend_score / 100)
    * segment_weight, 0), 1) AS marketing_priority_score
FROM (SELECT *, 1 - p_order_next_30d AS churn_risk_score, CAST((rank() OVER (ORDER BY monetary)
    + (count(*) OVER (PARTITION BY monetary) - 1) / 2.0) / count(*) OVER () AS DOUBLE) AS value_score,
  CAST(CASE rfm_segment WHEN 'Champions' THEN 1.25 WHEN 'Loyal' THEN 1.15 WHEN 'Big Spender' THEN 1.25 WHEN 'Potential' THEN 1.0
    WHEN 'New' THEN 0.85 WHEN 'At Risk' THEN 1.2 WHEN 'Hibernating' THEN 0.8 WHEN 'Lost' THEN 0.5 ELSE 0.75 END AS DOUBLE)
    AS segment_weight FROM trend)""",
)
A = params.ACTIONS
cte(
    "ranked",
    f"""
SELECT *, CASE WHEN rfm_segment IN ('Champions', 'Loyal') AND churn_risk_score < 0.4 THEN '{A["protect"]}'
  WHEN rfm_segment = 'Big Spender' THEN '{A["account"]}'
  WHEN churn_risk_score >= 0.7 AND value_score >= 0.7 THEN '{A["win_back"]}'
  WHEN purchase_trend_score < 40 AND value_score >= 0.5 THEN '{A["decline"]}'
  WHEN p_order_next_30d >= 0.65 AND value_score >= 0.5 THEN '{A["restock"]}'
  WHEN rfm_segment = 'New' THEN '{A["New"]}' WHEN rfm_segment = 'Potential' THEN '{A["Potential"]}'
  WHEN rfm_segment = 'At Risk' THEN '{A["At Risk"]}' WHEN rfm_segment = 'Hibernating' THEN '{A["Hibernating"]}'
  WHEN rfm_segment = 'Lost' THEN '{A["Lost"]}' ELSE '{A["monitor"]}' END AS recommended_action,
  CASE WHEN churn_risk_score >= 0.7 AND value_score >= 0.7 THEN 'Win-back priority'
  WHEN marketing_priority_score >= 75 THEN 'High priority' WHEN churn_risk_score >= 0.7 THEN 'High churn risk'
  WHEN purchase_trend_score < 40 THEN 'Declining activity'
  WHEN p_order_next_30d >= 0.65 AND purchase_trend_score >= 60 THEN 'Growth opportunity' ELSE 'Monitor' END AS risk_segment
FROM scored""",
)
cte(
    "valid",
    """SELECT customer_code, rfm_segment, target_active_next_30d AS y, exp(-recency_days / 60.0::DOUBLE) AS p
    FROM snap WHERE snapshot_date = DATE '2001-02-28'""",
)

BASIC = ["customer_code", "snapshot_date", "recency_days", "frequency", "monetary", "n_skus_bought", "n_groups_bought",
         "total_qty", "avg_order_size", "avg_unit_price", "is_new_dealer", "rfm_segment"]
MOMENTUM = ["customer_code", "snapshot_date", "quantity_recent_30d", "quantity_previous_30d", "revenue_recent_30d",
            "revenue_previous_30d", "orders_recent_90d", "quantity_q1_current", "quantity_q1_previous", "qty_momentum",
            "revenue_momentum", "yoy_momentum"]


@query("snapshot_features", f"SELECT {', '.join(BASIC)} FROM snap", rounded="avg_order_size avg_unit_price")
def _(t):
    return snapshots(t).select(*BASIC)


@query("activity_target", "SELECT customer_code, snapshot_date, target_active_next_30d FROM snap")
def _(t):
    return snapshots(t).select("customer_code", "snapshot_date", "target_active_next_30d")


@query("window_momentum", f"SELECT {', '.join(MOMENTUM)} FROM snap", rounded="qty_momentum revenue_momentum yoy_momentum")
def _(t):
    return snapshots(t).select(*MOMENTUM)


@query(
    "log_momentum",
    """SELECT a.month, ln(1 + a.qty) - ln(1 + b.qty) AS momentum FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
    CAST(sum(quantity) AS DOUBLE) AS qty FROM fact GROUP BY 1) a JOIN (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month,
    CAST(sum(quantity) AS DOUBLE) AS qty FROM fact GROUP BY 1) b ON b.month = a.month - INTERVAL 1 MONTH""",
    rounded="momentum",
)
def _(t):
    monthly = t.fact("order_date", "quantity").groupBy(dates.month_start(F.col("order_date")).alias("month")).agg(
        F.sum("quantity").cast("double").alias("qty")
    )
    before = monthly.select(F.add_months("month", 1).alias("month"), F.col("qty").alias("before"))
    return monthly.join(before, "month").select(
        "month", dealers.log_momentum(F.col("qty"), F.col("before")).alias("momentum")
    )


@query(
    "sigmoid_decay_clip",
    """SELECT customer_code, 1 / (1 + exp(-(recency_days - 30) / 100.0::DOUBLE)) AS s, exp(-recency_days / 45.0::DOUBLE) AS decay,
    least(greatest(frequency / 3.0::DOUBLE, 0), 1) AS clipped FROM rfm""",
    rounded="s decay clipped",
)
def _(t):
    return customer_rfm(t).select(
        "customer_code",
        dealers.sigmoid((F.col("recency_days") - 30) / 100.0).alias("s"),
        F.exp(-F.col("recency_days") / 45.0).alias("decay"),
        dealers.clip(F.col("frequency") / 3.0, 0.0, 1.0).alias("clipped"),
    )


TREND = ["customer_code", "short_term_score", "yoy_score", "recency_score", "frequency_score", "purchase_trend_score"]


@query("purchase_trend_score", f"SELECT {', '.join(TREND)} FROM trend", rounded=" ".join(TREND[1:]))
def _(t):
    return dealers.trend_scores(snapshots(t, LAST)).select(*TREND)


PRIORITY = ["customer_code", "value_score", "churn_risk_score", "segment_weight", "marketing_priority_score"]


@query("marketing_priority", f"SELECT {', '.join(PRIORITY)} FROM ranked", rounded=" ".join(PRIORITY[1:]))
def _(t):
    return ranking(t).select(*PRIORITY)


@query("recommended_action", "SELECT customer_code, recommended_action FROM ranked")
def _(t):
    return ranking(t).select("customer_code", "recommended_action")


@query("risk_segment", "SELECT customer_code, risk_segment FROM ranked")
def _(t):
    return ranking(t).select("customer_code", "risk_segment")


TOP = ["customer_code", "churn_risk_score", "value_score", "recommended_action"]


@query(
    "top_k_filtered",
    f"""SELECT {', '.join(TOP)} FROM ranked WHERE churn_risk_score >= 0.7 AND value_score >= 0.7
    ORDER BY churn_risk_score DESC, value_score DESC, customer_code LIMIT 20""",
    rounded="churn_risk_score value_score",
)
def _(t):
    return dealers.top_win_back(ranking(t)).select(*TOP)


@query(
    "top_k_priority",
    """SELECT customer_code, marketing_priority_score, recommended_action FROM ranked
    ORDER BY marketing_priority_score DESC, customer_code LIMIT 20""",
    rounded="marketing_priority_score",
)
def _(t):
    return dealers.top_priority(ranking(t)).select("customer_code", "marketing_priority_score", "recommended_action")


@query(
    "segment_value",
    """SELECT rfm_segment, count(*) AS n_customers, CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) AS revenue,
    avg(marketing_priority_score) AS avg_priority, CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE)
      / (SELECT CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) FROM ranked) AS revenue_share,
    CAST(sum(CAST(monetary AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_revenue FROM ranked GROUP BY 1""",
    rounded="avg_priority revenue_share avg_revenue",
)
def _(t):
    return dealers.segment_value(t.table("ranking", lambda: ranking(t)))


# distributions ---------------------------------------------------------------------

MEASURES = ["recency_days", "frequency", "monetary"]
DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS minimum, max(v) AS maximum,
    avg(v * v * v) AS m3, avg(v * v) AS m2, """
    + ", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in params.DESCRIBE_PERCENTS)
    + f" FROM (SELECT CAST({m} AS DOUBLE) AS v FROM rfm)"
    for m in MEASURES
)


@query(
    "describe_distribution",
    f"""SELECT * EXCLUDE (m2, m3), CASE WHEN std = 0 THEN 0 ELSE (m3 - 3 * mean * m2 + 2 * mean ** 3) / std ** 3 END AS skew
    FROM ({DESCRIBE})""",
    rounded="mean:3 std:3 skew:4 " + " ".join(f"p{p}" for p in params.DESCRIBE_PERCENTS),
)
def _(t):
    return stats.describe_distribution(customer_rfm(t), MEASURES)


def bins_sql(bins, value: str, extra: str = "") -> str:
    tops = ["'Infinity'" if hi is None else hi for _, hi in bins]
    rows = ", ".join(f"({i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for i, ((lo, _), hi) in enumerate(zip(bins, tops)))
    whole = "(SELECT count(*) FROM rfm)"
    return f"""SELECT *, 100.0 * n / {whole} AS share_pct, 100.0 * sum(n) OVER (ORDER BY bin) / {whole} AS cumulative_pct
    FROM (SELECT b.bin, b.low, b.high, count(r.customer_code) AS n{extra} FROM (VALUES {rows}) b(bin, low, high)
    LEFT JOIN rfm r ON {value} GROUP BY 1, 2, 3)"""


@query(
    "bin_counts_closed",
    bins_sql(params.RECENCY_BINS, "r.recency_days BETWEEN b.low AND b.high"),
    rounded="share_pct cumulative_pct",
)
def _(t):
    return stats.closed_bins(customer_rfm(t), "recency_days", params.RECENCY_BINS)


#: Edges that fit the revenue of the test customers.
EDGES = [0, 2e5, 5e5, 1e6, 1.5e6, 2e6, 3e6, 5e6]
UPPER = [*EDGES[1:], "'Infinity'"]


@query(
    "bin_counts_half_open",
    bins_sql(
        list(zip(EDGES, UPPER)),
        "r.monetary >= b.low AND r.monetary < b.high",
        ", CAST(coalesce(sum(CAST(r.monetary AS DECIMAL(28,2))), 0) AS DOUBLE) AS revenue",
    ),
    rounded="share_pct cumulative_pct",
)
def _(t):
    return stats.half_open_bins(customer_rfm(t), "monetary", EDGES)


@query(
    "cumulative_share",
    bins_sql(params.FREQUENCY_BINS, "r.frequency BETWEEN b.low AND b.high"),
    rounded="share_pct cumulative_pct",
)
def _(t):
    return stats.closed_bins(customer_rfm(t), "frequency", params.FREQUENCY_BINS)


@query(
    "last_purchase_month",
    """SELECT period, n_customers, 100.0 * n_customers / sum(n_customers) OVER () AS share_pct FROM (
    SELECT strftime(last, '%Y-T%m') AS period, count(*) AS n_customers FROM (SELECT customer_code, max(order_date) AS last
    FROM fact GROUP BY 1) GROUP BY 1)""",
    rounded="share_pct",
)
def _(t):
    return stats.last_purchase_month(t.fact("customer_code", "order_date"))


@query(
    "score_method_compare",
    """SELECT measure, method, score, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY measure, method) AS share_pct FROM (
    SELECT 'recency' AS measure, 'equal_size' AS method, r_score AS score FROM ntile_scores
    UNION ALL SELECT 'frequency', 'equal_size', f_score FROM ntile_scores UNION ALL SELECT 'monetary', 'equal_size', m_score FROM ntile_scores
    UNION ALL SELECT 'recency', 'threshold', r_score FROM rfm_scored UNION ALL SELECT 'frequency', 'threshold', f_score FROM rfm_scored
    UNION ALL SELECT 'monetary', 'threshold', m_score FROM rfm_scored) GROUP BY 1, 2, 3""",
    rounded="share_pct",
)
def _(t):
    names = {"recency": "r_score", "frequency": "f_score", "monetary": "m_score"}
    both = equal_size_scores(t).withColumnsRenamed({c: f"e_{c}" for c in names.values()})
    scored = dealers.rfm_scores(both, THRESHOLDS)
    return stats.score_histogram(scored, {m: (f"e_{c}", c) for m, c in names.items()})


@query("monthly_trend", "SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(line_total) AS DOUBLE) AS revenue FROM fact GROUP BY 1")
def _(t):
    return stats.monthly_trend(t.fact("order_date", "line_total"))


@query(
    "region_share",
    """SELECT region, revenue, 100 * revenue / (SELECT CAST(sum(line_total) AS DOUBLE) FROM fact) AS share_pct FROM (
    SELECT region, CAST(sum(line_total) AS DOUBLE) AS revenue FROM fact GROUP BY 1) WHERE region IS NOT NULL""",
    rounded="share_pct",
)
def _(t):
    return stats.region_share(t.fact("region", "line_total"))


# ranking metrics -------------------------------------------------------------------


@query(
    "roc_auc",
    """SELECT (SELECT count(*) FROM valid) AS n, (SELECT CAST(sum(y) AS BIGINT) FROM valid) AS positives,
    avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS roc_auc
    FROM valid a, valid b WHERE a.y = 1 AND b.y = 0""",
    rounded="roc_auc",
)
def _(t):
    return stats.roc_auc(validation_scores(t), "y", "p")


AP = """SELECT {seg} sum(pos * found / seen) / sum(pos) AS average_precision FROM (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC) AS found,
  sum(n) OVER ({part} ORDER BY p DESC) AS seen FROM (SELECT {seg} p, sum(y) AS pos, count(*) AS n FROM valid GROUP BY ALL)) GROUP BY ALL"""


@query("average_precision", AP.format(seg="", part=""), rounded="average_precision")
def _(t):
    return stats.average_precision(validation_scores(t), "y", "p")


@query(
    "metrics_by_rfm_segment",
    f"""SELECT a.rfm_segment, a.n, a.positives, a.roc_auc, b.average_precision FROM (
    SELECT s.rfm_segment, s.n, s.positives, (SELECT avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END)
      FROM valid x, valid z WHERE x.y = 1 AND z.y = 0 AND x.rfm_segment = s.rfm_segment AND z.rfm_segment = s.rfm_segment) AS roc_auc
    FROM (SELECT rfm_segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM valid GROUP BY 1) s
    WHERE s.positives > 0 AND s.positives < s.n) a JOIN ({AP.format(seg="rfm_segment,", part="PARTITION BY rfm_segment")}) b ON b.rfm_segment = a.rfm_segment""",
    rounded="roc_auc average_precision",
)
def _(t):
    return stats.metrics_by_segment(validation_scores(t), "y", "p", "rfm_segment")


@query(
    "precision_recall_at_k",
    """SELECT CAST(k AS INTEGER) AS k, sum(y) / k AS precision, sum(y) / (SELECT sum(y) FROM valid) AS recall FROM (
    SELECT y, row_number() OVER (ORDER BY p DESC, customer_code) AS rn FROM valid), (VALUES (50), (100), (200)) v(k)
    WHERE rn <= k AND k <= (SELECT count(*) FROM valid) GROUP BY k""",
    rounded="precision recall",
)
def _(t):
    return stats.precision_recall_at(validation_scores(t), "y", "p", "customer_code")


EDGE_LIST = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(11))


@query(
    "decile_calibration",
    f"""SELECT CAST(greatest((SELECT count(DISTINCT e) FROM unnest(edges) u(e) WHERE e < p) - 1, 0) AS INTEGER) AS decile,
    count(*) AS n, avg(y) AS actual_rate, avg(p) AS mean_score FROM valid, (SELECT [{EDGE_LIST}] AS edges FROM valid) q GROUP BY 1""",
    rounded="actual_rate mean_score",
)
def _(t):
    return stats.decile_calibration(validation_scores(t), "y", "p")
