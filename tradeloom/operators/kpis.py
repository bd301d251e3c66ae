"""Business indicators that are defined by a formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import dates
from tradeloom.operators.common import DOUBLE, join_null_safe, rate
from tradeloom.operators.forecast import exact_sum
from tradeloom.operators.ranking import quantiles

MONTH = ["fiscal_year", "fiscal_month"]


def active_dealer_rate(fact: DataFrame, customers: DataFrame) -> DataFrame:
    whole = customers.agg(F.count(F.lit(1))).scalar()
    return (
        fact.groupBy(*MONTH)
        .agg(F.countDistinct("customer_code").alias("active"))
        .withColumn("active_rate", F.try_divide(F.col("active").cast(DOUBLE), whole.cast(DOUBLE)))
    )


def group_mix_share(fact: DataFrame) -> DataFrame:
    """Revenue share of each group in its quarter."""
    quarter = ["fiscal_year", "fiscal_quarter"]
    groups = fact.groupBy(*quarter, "group_code").agg(F.sum("line_total").cast(DOUBLE).alias("revenue"))
    whole = groups.groupBy(*quarter).agg(exact_sum("revenue", 2).alias("all_revenue"))
    joined = groups.join(F.broadcast(whole), quarter)
    return joined.withColumn("share", rate(F.col("revenue"), F.col("all_revenue"))).drop("all_revenue")


def new_dealers_by_month(fact: DataFrame) -> DataFrame:
    first = fact.groupBy("customer_code").agg(F.min("order_date").alias("first"))
    return first.groupBy(dates.month_start(F.col("first")).alias("month")).agg(F.count(F.lit(1)).alias("new_dealers"))


def orders_and_quantity_per_dealer(fact: DataFrame) -> DataFrame:
    per_dealer = fact.groupBy(*MONTH, "customer_code").agg(
        F.countDistinct("so_number").alias("orders"), F.sum("quantity").alias("quantity")
    )
    return (
        per_dealer.groupBy(*MONTH)
        .agg(F.count(F.lit(1)).alias("dealers"), F.sum("orders").alias("orders"), F.sum("quantity").cast(DOUBLE).alias("quantity"))
        .withColumn("orders_per_dealer", rate(F.col("orders"), F.col("dealers")))
        .withColumn("quantity_per_dealer", rate(F.col("quantity"), F.col("dealers")))
    )


def zero_sales_sku_share(fact: DataFrame, products: DataFrame) -> DataFrame:
    """SKUs without a sale in the month against all SKUs; no SKU x month grid is needed."""
    whole = products.agg(F.count(F.lit(1))).scalar()
    sold = fact.groupBy(*MONTH).agg(F.countDistinct("product_code").alias("sold_skus"))
    return sold.withColumn("all_skus", whole).withColumn(
        "zero_share", rate(F.col("all_skus") - F.col("sold_skus"), F.col("all_skus"))
    )


def hhi_concentration(fact: DataFrame) -> DataFrame:
    """Sum of squared revenue shares of the dealers."""
    dealers = fact.groupBy("customer_code").agg(F.sum("line_total").cast(DOUBLE).alias("revenue"))
    return dealers.agg(
        F.count(F.lit(1)).alias("dealers"),
        F.try_divide(F.sum(F.col("revenue") * F.col("revenue")), F.sum("revenue") * F.sum("revenue")).alias("hhi"),
    )


def sku_penetration(fact: DataFrame, provinces: DataFrame) -> DataFrame:
    whole = provinces.agg(F.count(F.lit(1))).scalar()
    sold = fact.groupBy("product_code").agg(F.countDistinct("province_id").alias("n_provinces"))
    return sold.withColumn("penetration", F.try_divide(F.col("n_provinces").cast(DOUBLE), whole.cast(DOUBLE)))


def cross_sell_index(fact: DataFrame) -> DataFrame:
    return fact.groupBy("customer_code").agg(F.countDistinct("group_code").alias("n_groups"))


def price_realization(fact: DataFrame, list_prices: DataFrame) -> DataFrame:
    """Mean transaction price against the list price per SKU."""
    paid = fact.groupBy("product_code").agg(
        (F.sum("unit_price").cast(DOUBLE) / F.count("unit_price")).alias("avg_price")
    )
    return paid.join(list_prices.select("product_code", "list_price"), "product_code").withColumn(
        "realization", rate(F.col("avg_price"), F.col("list_price"))
    )


def order_velocity(orders: DataFrame) -> DataFrame:
    """Mean days between consecutive order dates per customer.

    The gaps add up to last minus first date, so no window over a customer's orders is needed.
    """
    span = orders.groupBy("customer_code").agg(
        F.countDistinct("order_date").alias("n_dates"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
    )
    gap = rate(F.datediff("last", "first"), F.col("n_dates") - 1)
    return span.select("customer_code", "n_dates", gap.alias("mean_days_between_orders"))


def demand_variation(panel: DataFrame) -> DataFrame:
    """Sample deviation over mean of the monthly quantity per SKU."""
    return panel.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.try_divide(F.stddev_samp("total_quantity"), F.avg("total_quantity")).alias("cv"),
    )


def region_monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*MONTH, "region").agg(
        F.sum("quantity").cast(DOUBLE).alias("total_qty"), F.sum("line_total").cast(DOUBLE).alias("total_revenue")
    )


def dealer_sku_monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy("customer_code", "product_code", *MONTH).agg(
        F.sum("quantity").cast(DOUBLE).alias("total_qty"), F.sum("line_total").cast(DOUBLE).alias("total_revenue")
    )


def price_change_log(prices: DataFrame) -> DataFrame:
    """Events at which a SKU's price differs from its previous one.

    Rows are compared inside one SKU and day; the last price of the day before comes from a
    table with one row per SKU and day, whose windows are bounded by the calendar.
    """
    order = ["order_id", "line_id", "unit_price"]
    day = ["product_code", "effective_from"]
    last = prices.groupBy(*day).agg(F.max_by("unit_price", F.struct(*order)).alias("__last"))
    per_sku = Window.partitionBy("product_code").orderBy("effective_from")
    carried = last.withColumn("__carried", F.lag("__last").over(per_sku)).drop("__last")
    inside = F.lag("unit_price").over(Window.partitionBy(*day).orderBy(*order))
    events = prices.withColumn("__inside", inside).join(carried, day)
    previous = F.coalesce("__inside", "__carried")
    return (
        events.withColumn("previous_price", previous)
        .where(F.col("previous_price").isNull() | (F.col("previous_price") != F.col("unit_price")))
        .select(
            "product_code",
            "effective_from",
            "order_id",
            "line_id",
            F.col("unit_price").cast(DOUBLE).alias("unit_price"),
            F.col("previous_price").cast(DOUBLE).alias("previous_price"),
        )
    )


def price_volatility(prices: DataFrame) -> DataFrame:
    """Population deviation over mean of the prices of a SKU."""
    price = F.col("unit_price").cast(DOUBLE)
    return prices.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.stddev_pop(price), F.avg(price)).alias("volatility")
    )


def winsorize(df: DataFrame, group: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Cap values at the group's percentiles; no row is dropped."""
    bounds = quantiles(df, [group], value, {"__low": low, "__high": high})
    joined = join_null_safe(df, bounds, [group], "left")
    capped = F.least(F.greatest(F.col(value).cast(DOUBLE), F.col("__low")), F.col("__high"))
    return joined.withColumn(f"{value}_capped", capped).drop("__low", "__high")
