"""Demand baselines, error metrics, price cascade, scenario allocation, colour and slow movers."""

from __future__ import annotations

import re

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions.rules import first_match
from tradeloom.operators.common import DOUBLE, join_null_safe, rate
from tradeloom.operators.features import mean_of_available
from tradeloom.operators.ranking import quantiles
from tradeloom.operators.views import latest_per_key, latest_price

MODELS = ["naive_last", "jan_feb_avg", "group_share_proportional"]


def exact_sum(column: str | Column, digits: int = 6) -> Column:
    """Sum of doubles through decimals, so that the order of rows does not matter."""
    value = F.col(column) if isinstance(column, str) else column
    return F.sum(value.cast(f"decimal(28,{digits})")).cast(DOUBLE)


def volume_segments(panel: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """High when the quantity of the first two months of the current block reaches the P75 over SKUs."""
    early = panel.where(F.col("period_month").isin(*cal.periods_b[:2]))
    skus = early.groupBy("product_code").agg(F.sum("total_quantity").alias("early_quantity"))
    p75 = quantiles(skus, [], "early_quantity", {"p75": 0.75}).select("p75").scalar()
    high = F.col("early_quantity") >= p75
    return skus.withColumn("volume_segment", F.when(high, "High Volume").otherwise("Low Volume"))


def baseline_predictions(features: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Three baselines for the last observed month."""
    early = features.where(F.col("period_month").isin(*cal.periods_b[:2]))
    whole = early.agg(
        F.struct(
            F.sum("total_quantity").alias("quantity"), F.countDistinct("period_month").alias("months")
        ).alias("t")
    ).scalar()
    volumes = volume_segments(features, cal).select("product_code", "early_quantity", "volume_segment")
    rows = features.where(F.col("period_month") == cal.periods_b[-1]).join(volumes, "product_code", "left")
    share = F.coalesce(F.try_divide(F.col("early_quantity"), whole.getField("quantity")), F.lit(0.0))
    monthly_total = whole.getField("quantity") / whole.getField("months")
    two_months = mean_of_available([F.col("qty_lag_1"), F.col("qty_lag_2")])
    return rows.select(
        "product_code",
        "group_code_clean",
        "total_quantity",
        F.coalesce("volume_segment", F.lit("Low Volume")).alias("volume_segment"),
        F.coalesce("qty_lag_1", F.lit(0.0)).alias("naive_last"),
        F.coalesce(two_months, F.lit(0.0)).alias("jan_feb_avg"),
        F.coalesce(monthly_total * share, F.lit(0.0)).alias("group_share_proportional"),
    )


def unpivot_models(predictions: DataFrame, models: list[str]) -> DataFrame:
    keys = [c for c in predictions.columns if c not in models]
    return predictions.unpivot(keys, models, "model", "predicted")


def metric_columns(actual: str = "total_quantity", predicted: str = "predicted") -> list[Column]:
    """MAE, RMSE, WMAPE, SMAPE, mean error and bias ratio."""
    y, p = F.col(actual), F.col(predicted)
    gap = F.abs(y - p)
    half = (F.abs(y) + F.abs(p)) / 2
    return [
        F.avg(gap).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.try_divide(F.sum(gap), F.sum(F.abs(y))).alias("wmape"),
        F.avg(F.when(half == 0, 0.0).otherwise(F.try_divide(gap, half))).alias("smape"),
        F.avg(p - y).alias("mean_error"),
        F.try_divide(F.sum(p - y), F.when(F.sum(y) > 0, F.sum(y))).alias("bias_ratio"),
    ]


def forecast_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(*metric_columns())


def metrics_by_segment(rows: DataFrame) -> DataFrame:
    """Metrics overall, per group and per volume segment in one pass (grouping sets)."""
    model, group, volume = F.col("model"), F.col("group_code_clean"), F.col("volume_segment")
    grouped = rows.groupingSets(
        [[model], [model, group], [model, volume]], model, group, volume
    ).agg(
        F.grouping("group_code_clean").alias("no_group"),
        F.grouping("volume_segment").alias("no_volume"),
        *metric_columns(),
    )
    segment = (
        F.when(F.col("no_group") == 0, F.concat(F.lit("Group: "), group))
        .when(F.col("no_volume") == 0, F.concat(F.lit("Volume: "), volume))
        .otherwise("Overall")
    )
    return grouped.withColumn("segment", segment).drop("no_group", "no_volume", "group_code_clean", "volume_segment")


def asp_cascade(
    metadata: DataFrame, prices: DataFrame, panel: DataFrame, cutoff: date, last_period: int
) -> DataFrame:
    """Price per SKU from the first source that has one, with the name of that source."""
    skus = metadata.select("product_code", F.col("group_code_clean").alias("group_code"))
    own = latest_price(prices, cutoff).select("product_code", F.col("unit_price").cast(DOUBLE).alias("own_effective"))
    history = panel.where(F.col("period_month") <= last_period)
    traded = latest_per_key(
        history.where(F.col("implied_price").isNotNull()), "product_code", ["period_month"], ["implied_price"]
    ).withColumnRenamed("implied_price", "own_transaction")
    group_effective = (
        own.join(skus, "product_code")
        .groupBy("group_code")
        .agg((exact_sum("own_effective", 2) / F.count(F.lit(1))).alias("group_effective"))
    )
    newest = history.agg(F.max("period_month")).scalar()
    latest = history.where(F.col("period_month") == newest)
    revenue_per_unit = F.try_divide(
        exact_sum("total_revenue", 2), F.when(F.sum("total_quantity") > 0, F.sum("total_quantity"))
    )
    group_traded = latest.groupBy(F.col("group_code_clean").alias("group_code")).agg(
        revenue_per_unit.alias("group_transaction")
    )
    overall = latest.agg(F.coalesce(revenue_per_unit, F.lit(0.0))).scalar()
    levels = ["own_effective", "own_transaction", "group_effective", "group_transaction"]
    joined = skus.join(own, "product_code", "left").join(traded, "product_code", "left")
    joined = join_null_safe(joined, group_effective, ["group_code"], "left")
    joined = join_null_safe(joined, group_traded, ["group_code"], "left")
    source = first_match(
        [(F.col(c).isNotNull(), name) for c, name in zip(levels, params.ASP_SOURCES)], params.ASP_SOURCES[-1]
    )
    return joined.select(
        "product_code",
        F.coalesce(*levels, overall).alias("asp_used"),
        source.alias("asp_source"),
        F.lit(cutoff).alias("asp_cutoff_date"),
    )


def quantity_shares(panel: DataFrame, metadata: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Group share of the market and SKU share of the group over the current block, for every SKU."""
    sold = (
        panel.where(F.col("period_month").isin(*cal.periods_b))
        .groupBy("product_code")
        .agg(F.sum("total_quantity").alias("sku_quantity"))
    )
    skus = metadata.select("product_code", "group_code_clean").join(sold, "product_code", "left")
    skus = skus.withColumn("sku_quantity", F.coalesce("sku_quantity", F.lit(0.0)))
    groups = skus.groupBy("group_code_clean").agg(F.sum("sku_quantity").alias("group_quantity"))
    whole = skus.agg(F.sum("sku_quantity")).scalar()
    groups = groups.withColumn("group_share", F.coalesce(F.try_divide(F.col("group_quantity"), whole), F.lit(0.0)))
    joined = join_null_safe(skus, groups, ["group_code_clean"])
    share = F.coalesce(rate(F.col("sku_quantity"), F.col("group_quantity")), F.lit(0.0))
    return joined.withColumn("sku_share_in_group", share)


def keep_all_skus(sold: DataFrame, metadata: DataFrame) -> DataFrame:
    """Right join to the product master: unsold SKUs get 0, an unknown group its label."""
    joined = sold.join(metadata.select("product_code", "group_code_clean"), "product_code", "right")
    return joined.na.fill(0.0).withColumn(
        "group_code_clean", F.coalesce("group_code_clean", F.lit(params.UNKNOWN_CODE))
    )


def group_share_forecast(
    panel: DataFrame, metadata: DataFrame, asp: DataFrame, totals: dict[str, Column | float], cal: params.SalesCalendar
) -> DataFrame:
    """Scenario total -> group -> SKU -> equal months, valued at the cascaded price."""
    scenarios = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), (v if isinstance(v, Column) else F.lit(float(v))).alias("total"))
            for name, v in totals.items()
        ]
    )
    months = F.array(*[F.lit(m) for m in cal.future_months])
    quantity = (
        F.col("s.total") * F.col("group_share") * F.col("sku_share_in_group") / F.lit(float(len(cal.future_months)))
    )
    static = metadata.select("product_code", "product_name", "line_id_clean", "base_color")
    return (
        quantity_shares(panel, metadata, cal)
        .join(static, "product_code", "left")
        .join(asp, "product_code", "left")
        .withColumn("s", F.explode(scenarios))
        .withColumn("fiscal_month", F.explode(months))
        .select(
            "product_code",
            "product_name",
            "group_code_clean",
            "line_id_clean",
            "base_color",
            F.lit(cal.year_b).alias("fiscal_year"),
            "fiscal_month",
            F.col("s.scenario").alias("scenario"),
            quantity.alias("predicted_quantity"),
            "asp_used",
            "asp_source",
            "asp_cutoff_date",
            (quantity * F.col("asp_used")).alias("estimated_revenue"),
            F.lit("core_baseline").alias("method_type"),
            F.lit("group_share_proportional").alias("model_name"),
        )
    )


def scenario_summary(forecast: DataFrame, months: int = 3) -> DataFrame:
    sums = forecast.groupBy("scenario").agg(
        exact_sum("predicted_quantity", 10).alias("total_quantity"), exact_sum("estimated_revenue", 8).alias("total_revenue")
    )
    return sums.withColumns(
        {
            "monthly_avg_quantity": F.col("total_quantity") / months,
            "monthly_avg_revenue": F.col("total_revenue") / months,
        }
    )


def scenario_delta(summary: DataFrame, base: str = "Base") -> DataFrame:
    """Difference of quantity and revenue against the base scenario."""
    reference = summary.where(F.col("scenario") == base).select(F.struct("total_quantity", "total_revenue")).scalar()
    return summary.select(
        "scenario",
        "total_quantity",
        "total_revenue",
        (F.col("total_quantity") - reference.getField("total_quantity")).alias("delta_quantity"),
        (F.col("total_revenue") - reference.getField("total_revenue")).alias("delta_revenue"),
    )


# colour ------------------------------------------------------------------------


def enrich_missing(forecast: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill absent or missing attributes from the metadata; colours then fall back to UNKNOWN."""
    names = ["product_name", "group_code_clean", "line_id_clean", "base_color", "color"]
    meta = metadata.select("product_code", *[F.col(n).alias(f"__m_{n}") for n in names])
    joined = forecast.join(meta, "product_code", "left")
    filled = {
        n: F.coalesce(F.col(n), F.col(f"__m_{n}")) if n in forecast.columns else F.col(f"__m_{n}") for n in names
    }
    for n in ("base_color", "color"):
        filled[n] = F.coalesce(filled[n], F.lit(params.UNKNOWN_CODE))
    return joined.withColumns(filled).drop(*[f"__m_{n}" for n in names])


def sku_totals(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("product_code", "base_color", "color").agg(
        F.sum("predicted_quantity").alias("predicted_quantity"), F.sum("estimated_revenue").alias("estimated_revenue")
    )


def rescale_to_total(skus: DataFrame, target: Column | float, label: str) -> DataFrame:
    """Scale quantity and revenue so that the quantity adds up to ``target``."""
    wanted = target if isinstance(target, Column) else F.lit(float(target))
    current = skus.agg(F.sum("predicted_quantity")).scalar()
    ratio = F.try_divide(wanted, current)
    return skus.select(
        "product_code",
        "base_color",
        "color",
        (F.col("predicted_quantity") * ratio).alias("predicted_quantity"),
        (F.col("estimated_revenue") * ratio).alias("estimated_revenue"),
        F.lit(label).alias("model_scenario"),
    )


def color_forecast(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model_scenario", "base_color", "color").agg(
        exact_sum("predicted_quantity", 10).alias("predicted_quantity"),
        exact_sum("estimated_revenue", 8).alias("estimated_revenue"),
    )


def reconcile_totals(rows: DataFrame, expected: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Expected against actual quantity per scenario."""
    actual = rows.groupBy("model_scenario").agg(exact_sum("predicted_quantity", 10).alias("actual"))
    gap = F.abs(F.col("expected") - F.coalesce("actual", F.lit(0.0)))
    return expected.join(actual, "model_scenario", "left").withColumn(
        "status", F.when(gap <= tolerance, "PASS").otherwise("FAIL")
    )


def require_pass(checks: DataFrame) -> DataFrame:
    """Raise when any check failed."""
    failed = checks.where(F.col("status") != "PASS").limit(5).collect()
    if failed:
        raise ValueError(f"checks failed: {[r.asDict() for r in failed]}")
    return checks


def quarter_change(panel: DataFrame, skus: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Quantities of both quarters and the months of the current one, with the yearly change."""
    p = F.col("period_month")

    def quantity(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("total_quantity"))), F.lit(0.0))

    first, second, third = cal.periods_b
    sums = panel.groupBy("product_code").agg(
        quantity(p.isin(*cal.periods_a)).alias("q1_previous"),
        quantity(p.isin(*cal.periods_b)).alias("q1_current"),
        quantity(p == first).alias("month_1"),
        quantity(p == second).alias("month_2"),
        quantity(p == third).alias("month_3"),
    )
    names = ["q1_previous", "q1_current", "month_1", "month_2", "month_3"]
    joined = skus.join(sums, "product_code", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    change = (F.col("q1_current") - F.col("q1_previous")) / F.col("q1_previous")
    return joined.withColumn("q1_yoy_change", F.when(F.col("q1_previous") > 0, change))


def _number_text(value: Column) -> Column:
    whole = F.concat(value.cast("bigint").cast("string"), F.lit(".0"))
    return F.when(value == F.floor(value), whole).otherwise(value.cast("string"))


def slow_moving_flags(panel: DataFrame, metadata: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Ordered rules on the quarter quantities against max(10, P10 of the group)."""
    skus = metadata.select("product_code", "group_code_clean", "base_color", "color")
    rows = quarter_change(panel, skus, cal)
    p10 = quantiles(rows.where("q1_current > 0"), ["group_code_clean"], "q1_current", {"p10": 0.1})
    rows = join_null_safe(rows, p10, ["group_code_clean"], "left")
    now, before, change = F.col("q1_current"), F.col("q1_previous"), F.col("q1_yoy_change")
    limit = F.greatest(F.lit(10.0), F.coalesce("p10", F.lit(10.0)))
    limit_text = F.when(limit == 10.0, F.lit("10")).otherwise(_number_text(limit))
    is_new = (before == 0) & (F.col("month_1") == 0) & (F.col("month_2") == 0)
    cases = [
        (is_new, "new_or_uncertain"),
        (now == 0, "red_no_demand"),
        (now <= limit, "amber_slow_moving"),
        ((before >= 10) & (change <= -0.5), "declining_activity"),
    ]
    flag = first_match(cases, "healthy")
    drop = F.format_string("%.1f", F.bround(F.abs(change * 100), 1))
    names = {
        "month": cal.as_of.strftime("%b%y"),
        "quarter": f"Q{cal.quarter}_{cal.year_b}",
        "before": f"Q{cal.quarter}_{cal.year_a}",
        "before_short": f"Q{cal.quarter}_{cal.year_a % 100:02d}",
        "next": f"Q{cal.quarter % 4 + 1}",
    }
    values = {"quantity": _number_text(now), "limit": limit_text, "drop": drop}

    def sentence(pattern: str) -> Column:
        """Text with period names filled in; ``<name>`` stands for a column."""
        parts = re.split(r"<(\w+)>", pattern.format(**names))
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])

    reasons = {k: sentence(v) for k, v in params.SLOW_MOVING_REASONS.items()}
    actions = {k: v.format(**names) for k, v in params.SLOW_MOVING_ACTIONS.items()}
    named = F.col("slow_moving_flag")
    return (
        rows.withColumn("slow_moving_flag", flag)
        .withColumn("slow_moving_reason", first_match([(named == k, v) for k, v in reasons.items()], params.SLOW_MOVING_NORMAL))
        .withColumn("recommended_action", first_match([(named == k, v) for k, v in actions.items()], params.SLOW_MOVING_DEFAULT.format(**names)))
        .drop("p10")
    )


def color_contribution(rows: DataFrame, scenario: str, n: int = 10) -> DataFrame:
    """Largest base colours of one scenario with their quantity and revenue shares."""
    colors = (
        rows.where(F.col("model_scenario") == scenario)
        .groupBy("base_color")
        .agg(
            exact_sum("predicted_quantity", 10).alias("quantity"), exact_sum("estimated_revenue", 8).alias("revenue")
        )
    )
    whole = colors.agg(F.struct(F.sum("quantity").alias("q"), F.sum("revenue").alias("r"))).scalar()
    return (
        colors.withColumn("quantity_share", F.try_divide(F.col("quantity"), whole.getField("q")))
        .withColumn("revenue_share", F.try_divide(F.col("revenue"), whole.getField("r")))
        .orderBy(F.desc("quantity"), "base_color")
        .limit(n)
    )
