"""Gap-aware features of the SKU panels and their continuation into the forecast quarter."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates
from tradeloom.operators.common import explode_rows, join_null_safe, rate
from tradeloom.operators.panels import STATIC, week_of_month
from tradeloom.operators.ranking import quantiles

MONTHLY_LAGS = [
    "qty_lag_1", "qty_lag_2", "n_dealers_lag1", "median_unit_price_lag1", "implied_price_lag1", "n_provinces_lag1",
    "n_regions_lag1",
]
WEEKLY_LAGS = [
    "qty_lag_1w", "qty_lag_2w", "qty_lag_4w", "n_dealers_lag_1w", "median_unit_price_lag_1w",
    "implied_price_lag_1w", "qty_roll_mean_2w", "qty_roll_mean_4w",
]


def safe_lag(value: str, distance: int, period: str, key: str = "product_code") -> Column:
    """Value exactly ``distance`` periods earlier; NULL when that period has no row.

    All lags of one key share the window, hence one shuffle and one sort. A window holds the
    periods of one SKU, so its size is bounded by the calendar.
    """
    window = Window.partitionBy(key).orderBy(period).rangeBetween(-distance, -distance)
    return F.avg(value).over(window)


def mean_of_available(values: list[Column]) -> Column:
    """Mean of the values that are not NULL, NULL when there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [dates.flag(v.isNotNull()) for v in values])
    return F.try_divide(total, present.cast("double"))


def safe_rolling_mean(value: str, width: int, period: str, key: str = "product_code") -> Column:
    """Mean of the lags 1..width that exist; the current row is left out."""
    return mean_of_available([safe_lag(value, i, period, key) for i in range(1, width + 1)])


def calendar_features(df: DataFrame, days: bool = True) -> DataFrame:
    month = F.col("fiscal_month")
    new = {
        "month_sin": dates.month_sin(month),
        "month_cos": dates.month_cos(month),
        "is_q1": dates.flag(month.isin(1, 2, 3)),
        "is_q2": dates.flag(month.isin(4, 5, 6)),
    }
    if days:
        new["days_in_month"] = dates.days_in_month(F.col("fiscal_year"), month)
    return df.withColumns(new)


def lifecycle(df: DataFrame, period: str = "period_month") -> DataFrame:
    first = F.min(period).over(Window.partitionBy("product_code"))
    return df.withColumn("months_since_first_seen", F.col(period) - first).withColumn(
        "is_new_sku", dates.flag(F.col("months_since_first_seen") == 0)
    )


def monthly_lags(df: DataFrame) -> DataFrame:
    period = "period_month"
    return df.withColumns(
        {
            "qty_lag_1": safe_lag("total_quantity", 1, period),
            "qty_lag_2": safe_lag("total_quantity", 2, period),
            "n_dealers_lag1": safe_lag("n_dealers", 1, period),
            "median_unit_price_lag1": safe_lag("median_unit_price", 1, period),
            "implied_price_lag1": safe_lag("implied_price", 1, period),
            "n_provinces_lag1": safe_lag("n_provinces", 1, period),
            "n_regions_lag1": safe_lag("n_regions", 1, period),
        }
    )


def hierarchy_lags(df: DataFrame) -> DataFrame:
    """Group and market totals one month earlier, shares, price position and dealer intensity.

    Totals belong to a SKU's row of that month, so a SKU without a row one month earlier has
    no lagged total. The market totals have one row per month and are broadcast.
    """
    period = "period_month"
    quantity = F.coalesce(F.sum("total_quantity"), F.lit(0.0))
    group = ["group_code_clean", period]
    groups = df.groupBy(*group).agg(quantity.alias("group_total_qty"))
    prices = quantiles(df, group, "median_unit_price", {"group_median_price": 0.5})
    market = df.groupBy(period).agg(quantity.alias("market_total_qty"))
    wide = join_null_safe(df, groups, group)
    wide = join_null_safe(wide, prices, group, "left")
    wide = wide.join(F.broadcast(market), period)
    wide = wide.withColumns(
        {
            "group_total_quantity_lagged": safe_lag("group_total_qty", 1, period),
            "market_total_lagged": safe_lag("market_total_qty", 1, period),
            "group_median_price_lagged": safe_lag("group_median_price", 1, period),
        }
    )
    return wide.withColumns(
        {
            "sku_share_in_group_lagged": rate(F.col("qty_lag_1"), F.col("group_total_quantity_lagged")),
            "sku_share_total_lagged": rate(F.col("qty_lag_1"), F.col("market_total_lagged")),
            "price_vs_group_median_lag1": rate(F.col("median_unit_price_lag1"), F.col("group_median_price_lagged")),
            "avg_qty_per_dealer_lag1": rate(F.col("qty_lag_1"), F.col("n_dealers_lag1")),
        }
    ).drop("group_total_qty", "market_total_qty", "group_median_price", "market_total_lagged", "group_median_price_lagged")


def with_metadata(panel: DataFrame, metadata: DataFrame) -> DataFrame:
    extra = metadata.select("product_code", "color", "is_cold_start_march_sku")
    return panel.join(extra, "product_code", "left").withColumn(
        "is_unknown_hierarchy", dates.flag(F.col("group_code_clean") == params.UNKNOWN_CODE)
    )


def monthly_features(panel: DataFrame, metadata: DataFrame) -> DataFrame:
    return hierarchy_lags(monthly_lags(lifecycle(calendar_features(with_metadata(panel, metadata)))))


LONGEST_WEEKLY_LAG = 4


def weekly_lags(df: DataFrame, period: str = "period_week") -> DataFrame:
    return df.withColumns(
        {
            "qty_lag_1w": safe_lag("total_quantity", 1, period),
            "qty_lag_2w": safe_lag("total_quantity", 2, period),
            "qty_lag_4w": safe_lag("total_quantity", 4, period),
            "n_dealers_lag_1w": safe_lag("n_dealers", 1, period),
            "median_unit_price_lag_1w": safe_lag("median_unit_price", 1, period),
            "implied_price_lag_1w": safe_lag("implied_price", 1, period),
            "qty_roll_mean_2w": safe_rolling_mean("total_quantity", 2, period),
            "qty_roll_mean_4w": safe_rolling_mean("total_quantity", 4, period),
        }
    )


def weekly_features(panel: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = with_metadata(panel, metadata).withColumns(
        {"month_sin": dates.month_sin(F.col("fiscal_month")), "month_cos": dates.month_cos(F.col("fiscal_month"))}
    )
    rows = week_of_month(rows, "week_start_date", ["product_code", "fiscal_year", "fiscal_month"])
    return weekly_lags(rows)


def static_columns(metadata: DataFrame) -> DataFrame:
    return metadata.select("product_code", *STATIC, "color", "is_cold_start_march_sku").withColumn(
        "is_unknown_hierarchy", dates.flag(F.col("group_code_clean") == params.UNKNOWN_CODE)
    )


def future_monthly_rows(panel: DataFrame, metadata: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Every SKU for each month of the forecast quarter; targets are NULL, lags come from history."""
    months = [
        {"fiscal_year": cal.year_b, "fiscal_month": m, "period_month": cal.period(cal.year_b, m), "block_id": "B"}
        for m in cal.future_months
    ]
    types = {"fiscal_year": "int", "fiscal_month": "int", "period_month": "int", "block_id": "string"}
    future = explode_rows(static_columns(metadata), months, types)
    history = with_metadata(panel, metadata)
    both = calendar_features(history.unionByName(future, allowMissingColumns=True))
    out = hierarchy_lags(monthly_lags(lifecycle(both)))
    return out.where(F.col("period_month") >= cal.periods_future[0])


def future_segments(cal: params.SalesCalendar) -> list[dict]:
    """Week-by-month segments of the forecast quarter (at most 17 entries of calendar arithmetic)."""
    segments: dict[tuple, dict] = {}
    day: date = cal.future_start
    while day <= cal.future_end:
        iso_year, iso_week, _ = day.isocalendar()
        entry = segments.setdefault(
            (iso_year, iso_week, day.month),
            {
                "year_week": f"{iso_year}-W{iso_week:02d}",
                "fiscal_year": cal.year_b,
                "fiscal_month": day.month,
                "segment_start_date": day,
                "days_in_segment": 0,
                "period_week": (iso_year - cal.year_a) * 52 + iso_week,
                "block_id": "B",
            },
        )
        entry["segment_end_date"] = day
        entry["days_in_segment"] += 1
        day += timedelta(days=1)
    for entry in segments.values():
        entry["is_partial_week"] = int(entry["days_in_segment"] < 7)
    return list(segments.values())


def future_weekly_rows(
    panel: DataFrame, metadata: DataFrame, cal: params.SalesCalendar, null_future: bool = False
) -> DataFrame:
    """Every SKU for each week segment of the forecast quarter.

    Lags come from week totals, and only from weeks that the longest lag of a future week can reach. A future week has
    the total 0, as a sum over missing values; ``null_future`` leaves it unknown instead.
    """
    types = {
        "year_week": "string", "fiscal_year": "int", "fiscal_month": "int", "segment_start_date": "date",
        "segment_end_date": "date", "days_in_segment": "int", "period_week": "int", "block_id": "string",
        "is_partial_week": "int",
    }
    segments = future_segments(cal)
    future = explode_rows(static_columns(metadata), segments, types)
    oldest = min(s["period_week"] for s in segments) - LONGEST_WEEKLY_LAG
    history = panel.where(F.col("period_week") >= oldest).select(
        "product_code", "period_week", "total_quantity", "n_dealers", "median_unit_price", "implied_price"
    )
    blank = future.select("product_code", "period_week")
    total = F.sum("total_quantity")
    weeks = (
        history.unionByName(blank, allowMissingColumns=True)
        .groupBy("product_code", "period_week")
        .agg(
            (total if null_future else F.coalesce(total, F.lit(0.0))).alias("total_quantity"),
            F.max("n_dealers").alias("n_dealers"),
            F.median("median_unit_price").alias("median_unit_price"),
            F.avg("implied_price").alias("implied_price"),
        )
    )
    lagged = weekly_lags(weeks).select("product_code", "period_week", *WEEKLY_LAGS)
    rows = week_of_month(future, "segment_start_date", ["product_code", "fiscal_month"]).withColumns(
        {
            "month_sin": dates.month_sin(F.col("fiscal_month")),
            "month_cos": dates.month_cos(F.col("fiscal_month")),
            "total_quantity": F.lit(None).cast("double"),
            "total_revenue": F.lit(None).cast("double"),
        }
    )
    return rows.join(lagged, ["product_code", "period_week"], "left")


def zero_fill_panel(panel: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """0 for months without sales after a SKU's first sale, inside the observed blocks only."""
    periods = [{"period_month": p} for p in cal.periods_a + cal.periods_b]
    first = panel.groupBy("product_code").agg(F.min("period_month").alias("first_period"))
    grid = explode_rows(first, periods, {"period_month": "int"}).where("period_month >= first_period")
    sold = panel.select("product_code", "period_month", "total_quantity", "total_revenue")
    return grid.join(sold, ["product_code", "period_month"], "left").select(
        "product_code",
        "period_month",
        F.coalesce("total_quantity", F.lit(0.0)).alias("total_quantity"),
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        dates.flag(F.col("total_quantity").isNull()).alias("is_zero_sales_row"),
    )


def feature_registry(spark) -> DataFrame:
    rows = [(*r[:4], True, *r[4:6], "low", r[6], r[6]) for r in params.FEATURE_REGISTRY]
    return spark.createDataFrame(
        rows,
        "feature_name string, feature_family string, grain string, dtype string, allowed_for_model boolean, "
        "model_candidate_minimal boolean, model_candidate_extended boolean, leakage_risk string, "
        "requires_shift boolean, block_aware boolean",
    )


def select_features(df: DataFrame, feature_set: str) -> DataFrame:
    return df.select(*params.FEATURE_SETS[feature_set])


def align_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename a source column only where its target is absent."""
    for source, target in (aliases or params.FUTURE_ALIASES).items():
        if target not in df.columns and source in df.columns:
            df = df.withColumnRenamed(source, target)
    return df


def usable_features(train: DataFrame, future: DataFrame, names: list[str]) -> list[str]:
    """Features of a set without target-derived ones; raises when a side lacks one."""
    out = []
    for name in names:
        if name in ("total_quantity", "total_revenue", "is_zero_sales_row"):
            continue
        for side, df in (("train", train), ("future", future)):
            if name not in df.columns:
                raise ValueError(f"feature '{name}' is missing in the {side} data")
        out.append(name)
    return out
