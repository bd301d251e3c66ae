"""Dealer analytics: RFM, snapshots without look-ahead, trend and priority scores, rules."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions.dates import flag
from tradeloom.functions.rules import first_match, score_ladder
from tradeloom.operators.common import DOUBLE, explode_rows, rate
from tradeloom.operators.ranking import average_rank_pct, with_share


def rfm_base(fact: DataFrame, customers: DataFrame, provinces: DataFrame, as_of: date) -> DataFrame:
    """Recency, frequency and revenue per customer, then its attributes."""
    per_customer = fact.groupBy("customer_code").agg(
        F.max("order_date").alias("last_order_date"),
        F.countDistinct("so_number").alias("frequency"),
        F.sum("line_total").cast(DOUBLE).alias("monetary"),
    )
    return (
        per_customer.join(customers.select("customer_code", "customer_name", "customer_tier", "province_id"), "customer_code")
        .join(provinces, "province_id", "left")
        .select(
            "customer_code",
            "customer_name",
            "customer_tier",
            F.coalesce("province_name", F.lit(params.UNKNOWN_LABEL)).alias("province_name"),
            F.coalesce("region", F.lit(params.UNKNOWN_LABEL)).alias("region"),
            "last_order_date",
            F.datediff(F.lit(as_of), "last_order_date").alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


def rfm_scores(base: DataFrame, limits: params.RfmThresholds) -> DataFrame:
    return base.withColumns(
        {
            "r_score": score_ladder(F.col("recency_days"), limits.recency, True),
            "f_score": score_ladder(F.col("frequency"), limits.frequency, False),
            "m_score": score_ladder(F.col("monetary"), limits.monetary, False),
        }
    )


def segment_label(r: Column, f: Column, m: Column) -> Column:
    """Eight ordered segments."""
    return first_match(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
            ((r >= 4) & (f >= 3) & (m >= 3), "Loyal"),
            ((r >= 3) & (f <= 2) & (m >= 4), "Big Spender"),
            ((r >= 3) & (f >= 2) & (m >= 2), "Potential"),
            ((r >= 4) & (f == 1) & (m <= 3), "New"),
            ((r <= 2) & (f >= 3) & (m >= 3), "At Risk"),
            ((r <= 2) & ((f >= 2) | (m >= 2)), "Hibernating"),
        ],
        "Lost",
    )


def rfm_segments(base: DataFrame, limits: params.RfmThresholds) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return rfm_scores(base, limits).withColumns(
        {"rfm_total": r + f + m, "rfm_segment": segment_label(r, f, m)}
    )


def segment_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("n_customers"))


def segment_value(scored: DataFrame) -> DataFrame:
    """Customers, revenue, its share and mean priority per segment."""
    grouped = scored.groupBy("rfm_segment").agg(
        F.countDistinct("customer_code").alias("n_customers"),
        F.sum(F.col("monetary").cast("decimal(20,2)")).cast(DOUBLE).alias("revenue"),
        F.avg("marketing_priority_score").alias("avg_priority"),
    )
    return with_share(grouped, "revenue", "revenue_share").withColumn(
        "avg_revenue", rate(F.col("revenue"), F.col("n_customers"))
    )


def _cutoff_rows(cutoffs: tuple[date, ...], cal: params.SalesCalendar) -> list[dict]:
    return [{"snapshot_date": c, "compare_years": c >= cal.as_of} for c in cutoffs]


def snapshot_features(fact: DataFrame, cal: params.SalesCalendar, limits: params.RfmThresholds) -> DataFrame:
    """One row per customer and cutoff from rows up to the cutoff, plus the 30-day target.

    The fact is reduced twice before the cutoffs multiply it: to one row per customer and
    day for the sums, and to the first date of each order, SKU and group of a customer for
    the distinct counts (an order, SKU or group counts at every cutoff from that date on).
    """
    types = {"snapshot_date": "date", "compare_years": "boolean"}
    cutoffs = _cutoff_rows(cal.snapshot_dates, cal)
    fact = fact.where(F.col("customer_code").isNotNull())
    keys = ["customer_code", "snapshot_date"]
    cut, day = F.col("snapshot_date"), F.col("order_date")

    daily = fact.groupBy("customer_code", "order_date").agg(
        F.sum("quantity").alias("quantity"), F.sum("line_total").alias("line_total")
    )
    past = day <= cut
    last_30 = past & (day > F.date_sub(cut, 30))
    before_30 = (day <= F.date_sub(cut, 30)) & (day > F.date_sub(cut, 60))

    def in_quarter(year: int) -> Column:
        first = date(year, cal.block_months[0], 1)
        last = date(year, cal.as_of.month, cal.as_of.day)
        return past & F.col("compare_years") & day.between(F.lit(first), F.lit(last))

    def amount(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0)).cast(DOUBLE)

    sums = (
        explode_rows(daily, cutoffs, types)
        .where(day <= F.date_add(cut, 30))
        .groupBy(*keys)
        .agg(
            F.max(F.when(past, day)).alias("last_order_date"),
            F.min(F.when(past, day)).alias("first_order_date"),
            F.max(flag(day > cut)).alias("target_active_next_30d"),
            amount(past, "line_total").alias("monetary"),
            amount(past, "quantity").alias("total_qty"),
            amount(last_30, "quantity").alias("quantity_recent_30d"),
            amount(before_30, "quantity").alias("quantity_previous_30d"),
            amount(last_30, "line_total").alias("revenue_recent_30d"),
            amount(before_30, "line_total").alias("revenue_previous_30d"),
            amount(in_quarter(cal.year_b), "quantity").alias("quantity_q1_current"),
            amount(in_quarter(cal.year_a), "quantity").alias("quantity_q1_previous"),
        )
        .where(F.col("last_order_date").isNotNull())
    )

    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("item"))
            for kind, column in (("order", "order_id"), ("sku", "product_code"), ("group", "group_code"))
        ]
    )
    first_seen = (
        fact.select("customer_code", "order_date", F.explode(kinds).alias("k"))
        .where(F.col("k.item").isNotNull())
        .groupBy("customer_code", F.col("k.kind").alias("kind"), F.col("k.item").alias("item"))
        .agg(F.min("order_date").alias("order_date"))
        .groupBy("customer_code", "kind", "order_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def number(kind: str, cond: Column, name: str) -> Column:
        hit = (F.col("kind") == kind) & cond
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(name)

    # all cutoffs side by side in one pass, then one row per customer and cutoff
    per_cutoff = []
    for c in cal.snapshot_dates:
        known = day <= F.lit(c)
        recent = known & (day > F.lit(c - timedelta(days=90)))
        per_cutoff.append(
            F.struct(
                F.lit(c).alias("snapshot_date"),
                number("order", known, "frequency"),
                number("sku", known, "n_skus_bought"),
                number("group", known, "n_groups_bought"),
                number("order", recent, "orders_recent_90d"),
            )
        )
    counts = (
        first_seen.groupBy("customer_code")
        .agg(F.array(*per_cutoff).alias("s"))
        .select("customer_code", F.explode("s").alias("s"))
        .select("customer_code", "s.*")
    )
    snap = sums.join(counts, keys).withColumns(
        {
            "recency_days": F.datediff(cut, "last_order_date"),
            "avg_order_size": rate(F.col("monetary"), F.col("frequency")),
            "avg_unit_price": rate(F.col("monetary"), F.col("total_qty")),
            "is_new_dealer": flag(F.datediff(cut, "first_order_date") <= 30),
            "qty_momentum": log_momentum(F.col("quantity_recent_30d"), F.col("quantity_previous_30d")),
            "revenue_momentum": log_momentum(F.col("revenue_recent_30d"), F.col("revenue_previous_30d")),
            "yoy_momentum": F.when(
                F.col("quantity_q1_previous") > 0,
                log_momentum(F.col("quantity_q1_current"), F.col("quantity_q1_previous")),
            ).otherwise(F.lit(0.0)),
        }
    )
    scored = rfm_scores(snap, limits)
    label = segment_label(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    return scored.withColumn("rfm_segment", label).drop("r_score", "f_score", "m_score")


def log_momentum(recent: Column, previous: Column) -> Column:
    return F.log1p(recent) - F.log1p(previous)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def trend_scores(snap: DataFrame) -> DataFrame:
    """0 to 100 from short-term and yearly momentum, recency and order frequency."""
    with_parts = snap.withColumns(
        {
            "short_term_score": sigmoid(F.col("qty_momentum")) * 0.5 + sigmoid(F.col("revenue_momentum")) * 0.5,
            "yoy_score": sigmoid(F.col("yoy_momentum")),
            "recency_score": F.exp(-F.col("recency_days") / 45.0),
            "frequency_score": clip(F.col("orders_recent_90d") / 3.0, 0.0, 1.0),
        }
    )
    score = (
        F.col("short_term_score") * 0.35
        + F.col("yoy_score") * 0.25
        + F.col("recency_score") * 0.25
        + F.col("frequency_score") * 0.15
    ) * 100
    return with_parts.withColumn("purchase_trend_score", score)


def marketing_priority(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Needs ``p_order_next_30d`` and the trend score; adds value, churn and priority."""
    weights = weights or params.SEGMENT_WEIGHTS
    ranked = average_rank_pct(scored, "monetary", "value_score").withColumns(
        {
            "churn_risk_score": F.lit(1.0) - F.col("p_order_next_30d"),
            "segment_weight": first_match(
                [(F.col("rfm_segment") == s, w) for s, w in weights.items()], params.DEFAULT_SEGMENT_WEIGHT
            ),
        }
    )
    p, value, trend = F.col("p_order_next_30d"), F.col("value_score"), F.col("purchase_trend_score") / 100
    retention = F.col("churn_risk_score") * value * F.greatest(F.lit(0.0), F.lit(1.0) - trend)
    raw = p * value * 0.45 + retention * 0.35 + p * trend * 0.20
    score = clip(raw * F.col("segment_weight"), 0.0, 1.0) * 100
    return ranked.withColumn("marketing_priority_score", score)


def recommended_action() -> Column:
    """Eleven ordered rules."""
    a = params.ACTIONS
    rfm, churn, value = F.col("rfm_segment"), F.col("churn_risk_score"), F.col("value_score")
    rules = [
        (rfm.isin("Champions", "Loyal") & (churn < 0.40), a["protect"]),
        (rfm == "Big Spender", a["account"]),
        ((churn >= 0.70) & (value >= 0.70), a["win_back"]),
        ((F.col("purchase_trend_score") < 40) & (value >= 0.50), a["decline"]),
        ((F.col("p_order_next_30d") >= 0.65) & (value >= 0.50), a["restock"]),
    ]
    by_segment = [(rfm == s, a[s]) for s in ("New", "Potential", "At Risk", "Hibernating", "Lost")]
    return first_match(rules + by_segment, a["monitor"])


def risk_segment() -> Column:
    """Six ordered rules."""
    churn, trend = F.col("churn_risk_score"), F.col("purchase_trend_score")
    return first_match(
        [
            ((churn >= 0.70) & (F.col("value_score") >= 0.70), "Win-back priority"),
            (F.col("marketing_priority_score") >= 75, "High priority"),
            (churn >= 0.70, "High churn risk"),
            (trend < 40, "Declining activity"),
            ((F.col("p_order_next_30d") >= 0.65) & (trend >= 60), "Growth opportunity"),
        ],
        "Monitor",
    )


def priority_ranking(snapshot: DataFrame) -> DataFrame:
    """Scores, rule-based action and risk segment for one snapshot that has a probability."""
    return marketing_priority(trend_scores(snapshot)).withColumns(
        {"recommended_action": recommended_action(), "risk_segment": risk_segment()}
    )


def top_priority(ranked: DataFrame, n: int = 20) -> DataFrame:
    return ranked.orderBy(F.desc("marketing_priority_score"), "customer_code").limit(n)


def top_win_back(ranked: DataFrame, n: int = 20) -> DataFrame:
    """Highest churn risk among the valuable customers."""
    return (
        ranked.where((F.col("churn_risk_score") >= 0.70) & (F.col("value_score") >= 0.70))
        .orderBy(F.desc("churn_risk_score"), F.desc("value_score"), "customer_code")
        .limit(n)
    )
