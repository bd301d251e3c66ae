"""Serving views: aggregates, shares, top-k and set operations over the sales fact.

Facts are aggregated on their own keys first (map-side partial sums) and dimension
attributes are joined to the small result, so a hot key never travels as raw rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates
from tradeloom.functions.rules import first_match
from tradeloom.operators.common import DOUBLE, join_null_safe, rate
from tradeloom.operators.ranking import cumulate, quantiles, row_numbers, with_share

def sums() -> list[Column]:
    return [
        F.sum("quantity").cast(DOUBLE).alias("total_qty"),
        F.sum("line_total").cast(DOUBLE).alias("total_revenue"),
    ]


def order_count() -> Column:
    return F.countDistinct("so_number").alias("order_count")


def monthly_by_group(fact: DataFrame) -> DataFrame:
    mean_price = F.round(F.sum("unit_price").cast(DOUBLE) / F.count("unit_price"), 0)
    return fact.groupBy("fiscal_year", "fiscal_month", "group_code", "group_name").agg(
        order_count(), *sums(), mean_price.alias("avg_unit_price")
    )


def customer_period(fact: DataFrame) -> DataFrame:
    keys = ["fiscal_year", "fiscal_quarter", "customer_code", "customer_name", "province_name", "region"]
    return fact.groupBy(*keys).agg(
        order_count(),
        *sums(),
        F.max("order_date").alias("last_order_date"),
        F.min("order_date").alias("first_order_date"),
    )


def sku_monthly(fact: DataFrame) -> DataFrame:
    keys = ["fiscal_year", "fiscal_month", "product_code", "product_name", "color", "line_name", "group_code"]
    return fact.groupBy(*keys).agg(*sums(), order_count())


def customer_activity(
    customers: DataFrame, orders: DataFrame, lines: DataFrame, provinces: DataFrame, as_of: date
) -> DataFrame:
    """Lifetime activity of every customer, also of those without orders."""
    per_order = lines.groupBy("order_id").agg(F.sum("line_total").alias("revenue"))
    activity = (
        orders.join(per_order, "order_id", "left")
        .groupBy("customer_code")
        .agg(
            F.countDistinct("so_number").alias("total_orders"),
            F.sum("revenue").cast(DOUBLE).alias("total_revenue"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    return (
        customers.select("customer_code", "customer_name", "province_id")
        .join(provinces, "province_id", "left")
        .join(activity, "customer_code", "left")
        .select(
            "customer_code",
            "customer_name",
            "province_id",
            "province_name",
            "region",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            "total_revenue",
            "first_order_date",
            "last_order_date",
            F.datediff(F.lit(as_of), "last_order_date").alias("days_since_last_order"),
        )
    )


def order_rollup(orders: DataFrame, lines: DataFrame, truncate: bool = False) -> DataFrame:
    """Header totals from the lines; 0 for an order without lines.

    ``truncate`` drops the fraction of every line before summing, as the loader does.
    """
    amount, quantity = F.col("line_total"), F.col("quantity")
    if truncate:
        amount, quantity = amount.cast("bigint"), quantity.cast("bigint")
    per_order = lines.groupBy("order_id").agg(
        F.sum(amount).alias("amount"), F.sum(quantity).alias("qty"), F.count(F.lit(1)).alias("n")
    )
    return (
        orders.select("order_id")
        .join(per_order, "order_id", "left")
        .select(
            "order_id",
            F.coalesce(F.col("amount").cast(DOUBLE), F.lit(0.0)).alias("total_amount"),
            F.coalesce(F.col("qty").cast("bigint"), F.lit(0)).alias("total_quantity"),
            F.coalesce("n", F.lit(0)).alias("line_count"),
        )
    )


def quarter_revenue_by_line(fact: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Revenue of the compared quarter in both years, in one pass."""

    def quarter(year: int) -> Column:
        hit = (F.col("fiscal_year") == year) & F.col("fiscal_month").isin(*cal.block_months)
        return F.coalesce(F.sum(F.when(hit, F.col("line_total"))), F.lit(0)).cast(DOUBLE)

    keys = [
        F.coalesce("line_name", F.lit(params.UNCLASSIFIED_LABEL)).alias("line_name"),
        F.coalesce("group_code", F.lit(params.UNKNOWN_CODE)).alias("group_code"),
        F.coalesce("group_name", F.lit(params.UNCLASSIFIED_LABEL)).alias("group_name"),
    ]
    return fact.groupBy(*keys).agg(
        quarter(cal.year_a).alias("rev_previous"), quarter(cal.year_b).alias("rev_current"), *sums()
    )


def bcg_matrix(fact: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Portfolio category per line from growth (one decimal) and revenue against the median."""
    growth = F.round(
        F.try_divide((F.col("rev_current") - F.col("rev_previous")) * 100.0, F.col("rev_previous")), 1
    )
    lines = quarter_revenue_by_line(fact, cal).withColumn("growth_pct_yoy", growth)
    median = quantiles(lines, [], "total_revenue", {"median": 0.5}).select("median").scalar()
    shared = with_share(lines, "total_revenue", "share", 100.0).select(
        *lines.columns, F.round("share", 1).alias("revenue_share_pct"), median.alias("median_revenue")
    )
    big = F.col("total_revenue") > F.col("median_revenue")
    grows = F.coalesce("growth_pct_yoy", F.lit(0.0)) > 0
    category = first_match(
        [
            ((F.col("rev_previous") == 0) & (F.col("rev_current") > 0), "New Launch"),
            (big & grows, "Stars"),
            (big, "Cash Cows"),
            (grows, "Question Marks"),
        ],
        "Dogs",
    )
    return shared.withColumn("bcg_category", category)


def top_growth(bcg: DataFrame, n: int = 10) -> DataFrame:
    return (
        bcg.select("line_name", "rev_previous", "rev_current", "growth_pct_yoy")
        .orderBy(F.col("growth_pct_yoy").desc_nulls_last(), "line_name")
        .limit(n)
    )


def missing_geography() -> Column:
    return F.col("province_id").isNull() | F.col("province_name").isNull() | F.col("region").isNull()


def missing_geography_counts(fact: DataFrame) -> DataFrame:
    return fact.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("province_id", "province_name", "region")]
    )


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("processing_status").agg(F.count(F.lit(1)).alias("email_count"))


def region_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.coalesce("region", F.lit(params.UNKNOWN_LABEL)).alias("region")).agg(
        F.count(F.lit(1)).alias("fact_rows"), *sums()
    )


def kpi_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.sum("line_total").cast(DOUBLE).alias("revenue"),
        F.sum("quantity").cast(DOUBLE).alias("quantity"),
        F.countDistinct("so_number").alias("orders"),
        F.countDistinct("customer_code").alias("customers"),
    ).withColumn("avg_order_value", rate(F.col("revenue"), F.col("orders")))


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that have NULLs, with the number of them; one pass over the data."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, n_null)").where("n_null > 0")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def active_customers_by_month(fact: DataFrame) -> DataFrame:
    return fact.groupBy("fiscal_year", "fiscal_month").agg(F.countDistinct("customer_code").alias("n_dealers"))


def summary_by_group(entities: DataFrame, group: str, label: str) -> DataFrame:
    """Count, means and the median of revenue per group of customers."""
    rows = entities.withColumn(group, F.coalesce(group, F.lit(label)))
    means = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.avg(F.col(c).cast("decimal(20,2)")).cast(DOUBLE).alias(f"avg_{c}")
            for c in ("recency_days", "frequency", "monetary")
        ],
    )
    medians = quantiles(rows, [group], "monetary", {"median_monetary": 0.5})
    return join_null_safe(means, medians, [group], "left")


def medians_by_level(entities: DataFrame, levels: list[str], measures: list[str]) -> DataFrame:
    """Count and medians for the groups of each level (say region and tier), as rows (level, name)."""
    cast = entities.select(*levels, *[F.col(m).cast(DOUBLE) for m in measures])
    long = cast.unpivot(measures, levels, "level", "name")
    out = long.groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"))
    for m in measures:
        out = join_null_safe(out, quantiles(long, ["level", "name"], m, {f"median_{m}": 0.5}), ["level", "name"], "left")
    return out


def pivot_sums(df: DataFrame, keys: list[str], by: str, values: list[str], measures: dict[str, str]) -> DataFrame:
    """One column per (value, measure), 0 where nothing was found."""
    wide = df.groupBy(*keys).pivot(by, values).agg(*[F.sum(m).alias(s) for m, s in measures.items()])
    return wide.select(
        *keys,
        *[F.coalesce(F.col(f"`{v}_{s}`"), F.lit(0.0)).alias(f"{v}_{s}") for v in values for s in measures.values()]
        if len(measures) > 1
        else [F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"{v}_{s}") for v in values for s in measures.values()],
    )


def share_within_group(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Share of the group total; totals are aggregated and joined so that a hot group stays spread."""
    totals = df.groupBy(group).agg(F.sum(value).alias("__total"))
    joined = join_null_safe(df, totals, [group])
    return joined.withColumn(name, rate(F.col(value), F.col("__total"))).drop("__total")


def month_on_month(fact: DataFrame) -> DataFrame:
    """Growth against the previous calendar month; NULL when that month has no sales."""
    monthly = fact.groupBy(dates.month_start(F.col("order_date")).alias("month")).agg(
        F.sum("line_total").cast(DOUBLE).alias("revenue")
    )
    previous = monthly.select(F.add_months("month", 1).alias("month"), F.col("revenue").alias("previous_revenue"))
    return monthly.join(previous, "month", "left").withColumn(
        "growth", rate(F.col("revenue") - F.col("previous_revenue"), F.abs("previous_revenue"))
    )


def top_groups(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Largest groups by revenue with their share of the whole; rows without the key count in the whole."""
    grouped = df.groupBy(key).agg(F.sum("line_total").cast(DOUBLE).alias("revenue"))
    shared = with_share(grouped, "revenue", "share")
    return shared.where(F.col(key).isNotNull()).orderBy(F.desc("revenue"), key).limit(n)


def bottom_entities(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(value).asc(), key).limit(n)


def top_entities(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(value).desc(), key).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_per_key(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Values of the last row per key; a partial aggregate, no sort."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"__last.{v}").alias(v) for v in values])


def latest_price(prices: DataFrame, cutoff: date) -> DataFrame:
    """Latest price in force on ``cutoff`` per product."""
    valid = prices.where(F.col("effective_from") <= F.lit(cutoff))
    return latest_per_key(
        valid, "product_code", ["effective_from", "order_id", "line_id", "unit_price"], ["unit_price", "effective_from"]
    )


def pareto_top_share(customers: DataFrame, value: str, fraction: float = 0.2) -> DataFrame:
    """Revenue share of the top ``fraction`` of customers, ties at the border included."""
    counts = customers.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulate(counts, [], value, ["n"])
    ahead = F.col("all_n") - F.col("before_n") - F.col("n")
    inside = ahead < F.ceil(F.col("all_n") * F.lit(fraction))
    worth = F.col(value).cast("decimal(20,2)") * F.col("n")
    return ranked.agg(
        F.sum(F.when(inside, F.col("n"))).alias("top_customers"),
        F.sum(F.when(inside, worth)).cast(DOUBLE).alias("top_revenue"),
        F.sum(worth).cast(DOUBLE).alias("total_revenue"),
    ).withColumn("top_share", rate(F.col("top_revenue"), F.col("total_revenue")))


def quarter_growth(fact: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    def quarter(year: int) -> Column:
        hit = (F.col("fiscal_year") == year) & F.col("fiscal_month").isin(*cal.block_months)
        return F.sum(F.when(hit, F.col("line_total"))).cast(DOUBLE)

    return fact.agg(quarter(cal.year_b).alias("current"), quarter(cal.year_a).alias("previous")).withColumn(
        "growth", rate(F.col("current") - F.col("previous"), F.abs("previous"))
    )


def cumulative_bins(binned: DataFrame, order: str, count: str) -> DataFrame:
    """Share and running share in percent over a fixed handful of bins, of ``all_rows`` if it is there."""
    whole = F.col("all_rows") if "all_rows" in binned.columns else F.sum(count).over(Window.partitionBy(F.lit(0)))
    running = F.sum(count).over(
        Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return binned.withColumn("share_pct", rate(F.col(count) * 100, whole)).withColumn(
        "cumulative_pct", rate(running * 100, whole)
    ).drop("all_rows")


def spot_check(customers: DataFrame, value: str, key: str, edge: int = 5) -> DataFrame:
    """First and last ``edge`` rows and the three middle ones by descending value."""
    placed = row_numbers(customers, value, key, "position", descending=True)
    middle = F.floor(F.col("position_of") / 2)
    pos = F.col("position")
    keep = (
        (pos < edge) | (pos >= F.col("position_of") - edge) | ((pos >= middle - 1) & (pos <= middle + 1))
    )
    return placed.where(keep).drop("position_of")
