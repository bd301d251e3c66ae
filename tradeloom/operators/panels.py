"""SKU panels by month and by ISO week, product metadata and period summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates
from tradeloom.operators.common import DOUBLE, rate
from tradeloom.operators.ranking import quantiles

STATIC = ["product_name", "base_color", "group_code_clean", "group_name_clean", "line_id_clean", "line_name_clean"]


def product_metadata(
    products: DataFrame, lines: DataFrame, groups: DataFrame, fact: DataFrame, last_month: date
) -> DataFrame:
    """Product hierarchy with the source of each mapping and the cold-start flag."""
    meta = (
        products.select("product_code", "product_name", "color", "base_color", F.col("line_id_fk").alias("line_id_original"))
        .join(
            lines.select(
                F.col("line_id").alias("line_id_original"),
                F.col("line_name").alias("line_name_original"),
                F.col("group_code").alias("group_code_original"),
            ),
            "line_id_original",
            "left",
        )
        .join(
            groups.select(
                F.col("group_code").alias("group_code_original"), F.col("group_name").alias("group_name_original")
            ),
            "group_code_original",
            "left",
        )
    )
    source = (
        F.when(F.col("line_id_original").isNull(), "original_null")
        .when(F.col("line_name_original").isNull(), "join_failed")
        .otherwise("dimension_join")
    )
    joined = source == "dimension_join"

    def clean(name: str) -> Column:
        return F.when(joined, F.col(f"{name}_original")).otherwise(F.lit(params.UNKNOWN_CODE))

    first_sale = fact.groupBy("product_code").agg(F.min("order_date").alias("first_sale"))
    return meta.join(first_sale, "product_code", "left").select(
        "product_code",
        "product_name",
        "color",
        "base_color",
        "line_id_original",
        "line_name_original",
        "group_code_original",
        "group_name_original",
        F.when(joined, F.col("line_id_original")).alias("line_id_clean"),
        clean("line_name").alias("line_name_clean"),
        clean("group_code").alias("group_code_clean"),
        clean("group_name").alias("group_name_clean"),
        source.alias("mapping_source"),
        F.lit("high").alias("mapping_confidence"),
        F.lit(False).alias("needs_manual_review"),
        F.coalesce(F.col("first_sale") >= F.lit(last_month), F.lit(False)).alias("is_cold_start_march_sku"),
    )


def panel(fact: DataFrame, periods: list[str], with_median: bool = True) -> DataFrame:
    """Sums, distinct counts and the median price per SKU and period.

    The first aggregate brings the fact to one row per SKU, period and dealer; an order
    belongs to one dealer, so the order counts add up. Only the reduced rows take part in
    the distinct counts of dealers, provinces and regions.
    """
    keys = ["product_code", *periods]
    per_dealer = fact.groupBy(*keys, "customer_code", "province_name", "region").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("line_total").alias("line_total"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.countDistinct("so_number").alias("n_orders"),
    )
    sums = per_dealer.groupBy(*keys).agg(
        F.sum("quantity").cast(DOUBLE).alias("total_quantity"),
        F.sum("line_total").cast(DOUBLE).alias("total_revenue"),
        F.sum("n_orders").alias("n_orders"),
        F.sum("n_transactions").alias("n_transactions"),
        F.countDistinct("customer_code").alias("n_dealers"),
        F.countDistinct("province_name").alias("n_provinces"),
        F.countDistinct("region").alias("n_regions"),
    )
    sums = sums.withColumn("implied_price", rate(F.col("total_revenue"), F.col("total_quantity")))
    if not with_median:
        return sums
    medians = quantiles(fact, keys, "unit_price", {"median_unit_price": 0.5})
    return sums.join(medians, keys, "left")


def monthly_panel(
    fact: DataFrame, metadata: DataFrame, cal: params.SalesCalendar, with_median: bool = True
) -> DataFrame:
    year, month = F.col("fiscal_year"), F.col("fiscal_month")
    rows = panel(fact, ["fiscal_year", "fiscal_month"], with_median).withColumns(
        {
            "block_id": dates.block_label(year, month, cal),
            "period_month": dates.period_month(year, month, cal),
        }
    )
    return rows.join(metadata.select("product_code", *STATIC), "product_code", "left")


def weekly_panel(
    fact: DataFrame, metadata: DataFrame, cal: params.SalesCalendar, with_median: bool = True
) -> DataFrame:
    """ISO week and month together: a week across a month end gives two rows."""
    start = F.col("week_start_date")
    source = fact.withColumn("week_start_date", dates.week_start(F.col("order_date")))
    year, month = F.col("fiscal_year"), F.col("fiscal_month")
    rows = panel(source, ["fiscal_year", "fiscal_month", "week_start_date"], with_median).withColumns(
        {
            "week_end_date": F.date_add(start, 6),
            "iso_year": dates.iso_year(start),
            "iso_week": F.weekofyear(start),
            "year_week": dates.year_week(start),
            "block_id": dates.block_label(year, month, cal),
            "period_month": dates.period_month(year, month, cal),
            "period_week": dates.period_week(dates.iso_year(start), F.weekofyear(start), cal),
        }
    )
    return rows.join(metadata.select("product_code", *STATIC), "product_code", "left")


def period_summary(panel_rows: DataFrame, periods: list[str]) -> DataFrame:
    return panel_rows.groupBy(*periods).agg(
        F.countDistinct("product_code").alias("n_skus"),
        F.sum("total_quantity").alias("sum_qty"),
        F.sum(F.col("total_revenue").cast("decimal(20,2)")).cast(DOUBLE).alias("sum_rev"),
    )


def week_of_month(rows: DataFrame, start: str, keys: list[str]) -> DataFrame:
    """Rank of the week inside the month of a SKU, with first and last flags."""
    by_month = Window.partitionBy(*keys)
    ranked = rows.withColumn("week_of_month", F.dense_rank().over(by_month.orderBy(start)))
    return ranked.withColumns(
        {
            "is_month_start_week": dates.flag(F.col("week_of_month") == 1),
            "is_month_end_week": dates.flag(F.col("week_of_month") == F.max("week_of_month").over(by_month)),
        }
    )


def week_segments(days: DataFrame, day: str = "day") -> DataFrame:
    """Days cut by ISO week and month: first day, last day, number of days, partial flag."""
    d = F.col(day)
    return (
        days.groupBy(dates.year_week(d).alias("year_week"), F.month(d).alias("fiscal_month"))
        .agg(
            F.min(day).alias("segment_start_date"),
            F.max(day).alias("segment_end_date"),
            F.count(F.lit(1)).alias("days_in_segment"),
        )
        .withColumn("is_partial_week", dates.flag(F.col("days_in_segment") < 7))
    )
