"""Data-quality, reconciliation and leakage checks; most return (check, status, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates
from tradeloom.operators.common import DOUBLE, join_null_safe, rate
from tradeloom.operators.views import missing_geography

def rows() -> Column:
    return F.count(F.lit(1))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def status(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def checks(row: DataFrame, tests: list[tuple[str, Column, Column]]) -> DataFrame:
    """One check row per test on a one-row frame."""
    entries = [
        F.struct(
            F.lit(name).alias("check"), status(ok).alias("status"), detail.cast("string").alias("detail")
        )
        for name, ok, detail in tests
    ]
    return row.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def dq_summary(customers: DataFrame, fact: DataFrame) -> DataFrame:
    """Four issues with their number and the revenue they touch."""
    no_tax = F.col("tax_code").isNull() | (F.trim("tax_code") == "")
    people = customers.agg(
        F.count_if(F.col("province_id").isNull()).alias("province"), F.count_if(no_tax).alias("tax")
    )
    no_group = F.col("line_id_fk").isNull() | F.col("group_code").isNull()

    def revenue(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("line_total"))).cast(DOUBLE)

    sales = fact.agg(
        F.count_if(missing_geography()).alias("geo_rows"),
        revenue(missing_geography()).alias("geo_revenue"),
        F.countDistinct(F.when(no_group, F.col("product_code"))).alias("skus"),
        revenue(no_group).alias("sku_revenue"),
    )

    def issues(df: DataFrame, entries: list[tuple[str, str, str | None]]) -> DataFrame:
        items = [
            F.struct(
                F.lit(issue).alias("issue"),
                F.col(n).cast("bigint").alias("issue_count"),
                (F.col(r) if r else F.lit(None).cast(DOUBLE)).alias("affected_revenue"),
            )
            for issue, n, r in entries
        ]
        return df.select(F.explode(F.array(*items)).alias("i")).select("i.*")

    return issues(
        people,
        [("customers_missing_province", "province", None), ("customers_missing_tax_code", "tax", None)],
    ).unionByName(
        issues(
            sales,
            [("fact_rows_missing_geography", "geo_rows", "geo_revenue"), ("sku_missing_group", "skus", "sku_revenue")],
        )
    )


def row_count_check(tables: dict[str, DataFrame], expected: dict[str, Column | int]) -> DataFrame:
    """Rows per table against the number that is expected."""
    parts = []
    for name, df in tables.items():
        wanted = expected[name] if isinstance(expected[name], Column) else F.lit(expected[name])
        counted = df.agg(rows().alias("actual")).withColumn("expected", wanted.cast("bigint"))
        parts.append(
            counted.select(
                F.lit(name).alias("table_name"),
                "actual",
                "expected",
                status(F.col("actual") == F.col("expected")).alias("status"),
            )
        )
    return union_all(parts)


def cross_table_totals(orders: DataFrame, lines: DataFrame, fact: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Header against line against fact totals."""
    line_sums = lines.agg(F.struct(F.sum("line_total").alias("amount"), F.sum("quantity").alias("quantity"))).scalar()
    fact_sums = fact.agg(F.struct(F.sum("line_total").alias("amount"), F.sum("quantity").alias("quantity"))).scalar()
    row = orders.agg(
        F.sum("total_amount").cast(DOUBLE).alias("header_amount"), F.sum("total_quantity").cast(DOUBLE).alias("header_quantity")
    ).withColumns(
        {
            "line_amount": line_sums.getField("amount").cast(DOUBLE),
            "line_quantity": line_sums.getField("quantity").cast(DOUBLE),
            "fact_amount": fact_sums.getField("amount").cast(DOUBLE),
            "fact_quantity": fact_sums.getField("quantity").cast(DOUBLE),
        }
    )
    entries = []
    for left, right in (("header", "line"), ("fact", "line")):
        for what in ("amount", "quantity"):
            a, b = F.col(f"{left}_{what}"), F.col(f"{right}_{what}")
            entries.append(
                F.struct(
                    F.lit(f"{left}_vs_{right}_{what}").alias("check"),
                    status(F.abs(a - b) < tolerance).alias("status"),
                    a.alias("left_value"),
                    b.alias("right_value"),
                )
            )
    return row.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def merge_loss_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row count and sums before and after an enrichment."""

    def totals(df: DataFrame) -> Column:
        return F.struct(
            rows().alias("n"), F.sum("quantity").alias("quantity"), F.sum("line_total").alias("amount")
        )

    other = after.agg(totals(after)).scalar()
    row = before.agg(totals(before).alias("b")).select("b.*", other.alias("a"))
    return checks(
        row,
        [
            ("row count unchanged", F.col("n") == F.col("a.n"), F.col("a.n")),
            ("quantity unchanged", F.col("quantity") == F.col("a.quantity"), F.col("a.quantity").cast("bigint")),
            ("revenue unchanged", F.col("amount") == F.col("a.amount"), F.col("a.amount").cast("decimal(38,2)")),
        ],
    )


def week_month_reconcile(weekly: DataFrame, monthly: DataFrame, tolerance: float = 1.0) -> DataFrame:
    def by_period(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("period_month").agg(F.sum("total_quantity").alias(name))

    joined = join_null_safe(by_period(weekly, "weekly_quantity"), by_period(monthly, "monthly_quantity"), ["period_month"])
    gap = F.abs(F.col("weekly_quantity") - F.col("monthly_quantity"))
    return joined.withColumn("difference", gap).withColumn("status", status(F.col("difference") <= tolerance))


def unknown_impact(fact: DataFrame) -> DataFrame:
    """Rows, quantity and revenue of unmapped SKUs per month and, with ``is_total``, over all months, with their shares."""
    unmapped = F.col("line_id_fk").isNull()
    monthly = fact.groupBy(dates.month_start(F.col("order_date")).alias("month")).agg(
        F.count_if(unmapped).alias("unknown_rows"),
        rows().alias("all_rows"),
        F.coalesce(F.sum(F.when(unmapped, F.col("quantity"))), F.lit(0)).alias("unknown_quantity"),
        F.sum("quantity").alias("all_quantity"),
        F.coalesce(F.sum(F.when(unmapped, F.col("line_total"))), F.lit(0)).alias("unknown_revenue"),
        F.sum("line_total").alias("all_revenue"),
    )
    sums = [c for c in monthly.columns if c != "month"]
    both = monthly.rollup("month").agg(*[F.sum(c).alias(c) for c in sums], (F.grouping("month") == 1).alias("is_total"))
    return both.select(
        "month",
        "is_total",
        "unknown_rows",
        F.col("unknown_quantity").cast(DOUBLE).alias("unknown_quantity"),
        F.col("unknown_revenue").cast(DOUBLE).alias("unknown_revenue"),
        *[
            rate(F.col(f"unknown_{c}") * 100, F.col(f"all_{c}")).alias(f"{c}_share_pct")
            for c in ("rows", "quantity", "revenue")
        ],
    )


def unknown_sku_detail(fact: DataFrame, last_month) -> DataFrame:
    """Sums per unmapped SKU; cold start when nothing was sold before ``last_month``."""
    return (
        fact.where(F.col("line_id_fk").isNull())
        .groupBy("product_code")
        .agg(
            F.min("product_name").alias("product_name"),
            F.sum("quantity").cast(DOUBLE).alias("quantity"),
            F.sum("line_total").cast(DOUBLE).alias("line_total"),
            (F.min("order_date") >= F.lit(last_month)).alias("is_cold_start_march"),
        )
    )


def match_rate(fact: DataFrame, keys: DataFrame, fact_key: Column, key: Column) -> DataFrame:
    """Percent of fact rows whose normalised key exists; counted per key before the join."""
    used = fact.groupBy(fact_key.alias("k")).agg(rows().alias("n"))
    known = keys.select(key.alias("k")).where(F.col("k").isNotNull()).distinct().withColumn("hit", F.lit(True))
    joined = used.join(known, "k", "left")
    matched = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    return joined.agg(F.sum("n").alias("fact_rows"), matched.alias("matched_rows")).withColumn(
        "match_rate_percent", rate(F.col("matched_rows") * 100, F.col("fact_rows"))
    )


def missing_key_impact(fact: DataFrame, key: str) -> DataFrame:
    missing = F.col(key).isNull()
    return fact.agg(
        F.count_if(missing).alias("missing_rows"),
        F.coalesce(F.sum(F.when(missing, F.col("quantity"))), F.lit(0)).cast(DOUBLE).alias("missing_quantity"),
        F.sum("quantity").cast(DOUBLE).alias("all_quantity"),
    ).withColumn("quantity_share_pct", rate(F.col("missing_quantity") * 100, F.col("all_quantity")))


def dirty_values(df: DataFrame, column: str, longest: int = 15, label: str = params.UNKNOWN_LABEL) -> DataFrame:
    """Distinct values that carry the unknown label or are too long."""
    value = F.col(column)
    return df.select(column).distinct().where(value.isNotNull() & (value.contains(label) | (F.length(value) > longest)))


def damaged_share(df: DataFrame, damaged: Column) -> DataFrame:
    return df.agg(F.count_if(damaged).alias("damaged_rows"), rows().alias("all_rows")).withColumn(
        "damaged_pct", rate(F.col("damaged_rows") * 100, F.col("all_rows"))
    )


def unresolved_by_customer(fact: DataFrame, customers: DataFrame) -> DataFrame:
    counts = fact.where(missing_geography()).groupBy("customer_code").agg(rows().alias("fact_rows"))
    return counts.join(customers.select("customer_code", "customer_name", "address"), "customer_code")


def column_presence(df: DataFrame, required: list[str], spark) -> DataFrame:
    found = [(c, "PASS" if c in df.columns else "FAIL", "present" if c in df.columns else "missing") for c in required]
    return spark.createDataFrame(found, "check string, status string, detail string")


def panel_audit(panel: DataFrame, weekly: DataFrame, future: DataFrame, future_weekly: DataFrame, fact: DataFrame) -> DataFrame:
    """Both SKU panels against the sales they come from: rows, SKUs, sums, UNKNOWN share, empty future targets.

    ``fact`` has the lines of the panels' months: product_code, group_code, quantity, line_total.
    """
    unknown = F.col("group_code_clean") == params.UNKNOWN_CODE

    def targets(df: DataFrame) -> Column:
        return df.agg(F.struct(rows().alias("n"), F.count("total_quantity").alias("targets"))).scalar()

    def totals(df: DataFrame) -> list[Column]:
        return [rows().alias("n"), F.sum("total_quantity").alias("quantity"), F.sum("total_revenue").alias("revenue")]

    sales = fact.agg(
        F.struct(
            F.countDistinct("product_code").alias("skus"),
            F.sum("quantity").cast(DOUBLE).alias("quantity"),
            F.sum("line_total").cast(DOUBLE).alias("revenue"),
            F.coalesce(F.sum(F.when(F.col("group_code").isNull(), F.col("line_total"))), F.lit(0)).cast(DOUBLE).alias("unmapped"),
        )
    ).scalar()
    row = panel.agg(
        *totals(panel),
        F.countDistinct("product_code").alias("n_skus"),
        F.coalesce(F.sum(F.when(unknown, F.col("total_revenue"))), F.lit(0.0)).alias("unknown_revenue"),
    ).select("*", sales.alias("s"), weekly.agg(F.struct(*totals(weekly))).scalar().alias("w"), targets(future).alias("f"), targets(future_weekly).alias("fw"))

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= 1

    def whole(c: Column) -> Column:
        return F.round(c).cast("bigint")

    return checks(
        row,
        [
            ("monthly panel has rows", F.col("n") > 0, F.col("n")),
            ("weekly panel has no fewer rows", F.col("w.n") >= F.col("n"), F.col("w.n")),
            ("SKU count matches sales", F.col("n_skus") == F.col("s.skus"), F.col("n_skus")),
            ("monthly quantity matches sales", close(F.col("quantity"), F.col("s.quantity")), whole(F.col("quantity"))),
            ("weekly quantity matches sales", close(F.col("w.quantity"), F.col("s.quantity")), whole(F.col("w.quantity"))),
            ("monthly revenue matches sales", close(F.col("revenue"), F.col("s.revenue")), whole(F.col("revenue"))),
            ("weekly revenue matches sales", close(F.col("w.revenue"), F.col("s.revenue")), whole(F.col("w.revenue"))),
            ("unknown revenue matches unmapped sales", close(F.col("unknown_revenue"), F.col("s.unmapped")), whole(F.col("unknown_revenue"))),
            ("monthly future targets are empty", F.col("f.targets") == 0, F.col("f.n")),
            ("weekly future targets are empty", F.col("fw.targets") == 0, F.col("fw.n")),
        ],
    )


def period_set_check(panel: DataFrame, cal: params.SalesCalendar) -> DataFrame:
    """Observed periods equal the two blocks; the gap stays empty."""
    expected = cal.periods_a + cal.periods_b
    observed = panel.select("period_month").distinct().agg(F.sort_array(F.collect_set("period_month")).alias("p"))
    return checks(
        observed,
        [
            ("periods match", F.col("p") == F.array(*[F.lit(p) for p in expected]), F.concat_ws(",", "p")),
            (
                "gap is untouched",
                ~F.exists("p", lambda x: (x > cal.periods_a[-1]) & (x < cal.periods_b[0])),
                F.size("p"),
            ),
        ],
    )


def cross_gap_lag_audit(panel: DataFrame, lags: list[str], period: str, periods: list[int]) -> DataFrame:
    """NULL rate of every lag at the first periods after the gap; a value in the first one is a violation."""
    picked = panel.where(F.col(period).isin(*periods)).select(period, *[F.col(c).cast(DOUBLE) for c in lags])
    long = picked.unpivot([period], lags, "feature", "value")
    grouped = long.groupBy("feature", period).agg(rows().alias("total_rows"), F.count("value").alias("non_null_count"))
    violation = (
        F.when(F.col(period) != periods[0], "N/A (intra-block)")
        .when(F.col("non_null_count") > 0, "YES - CRITICAL VIOLATION")
        .otherwise("NO")
    )
    return grouped.withColumns(
        {
            "null_count": F.col("total_rows") - F.col("non_null_count"),
            "null_rate_pct": rate((F.col("total_rows") - F.col("non_null_count")) * 100, F.col("total_rows")),
            "cross_gap_violation": violation,
        }
    )


def future_lag_audit(future: DataFrame, lags: list[str], first: int, period: str = "fiscal_month") -> DataFrame:
    """Lag coverage per future period; values beyond the first one must be frozen per SKU."""
    long = future.select("product_code", period, *[F.col(c).cast(DOUBLE) for c in lags]).unpivot(
        ["product_code", period], lags, "feature", "value"
    )
    per_sku = long.groupBy("feature", "product_code").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    spread = per_sku.groupBy("feature").agg(F.max("v").alias("max_variance"))
    later = long.where((F.col(period) > first) & F.col("value").isNotNull())
    beyond = later.groupBy("feature").agg(rows().alias("beyond"))
    grouped = long.groupBy("feature", period).agg(rows().alias("total_rows"), F.count("value").alias("non_null_count"))
    risk = (
        F.when((F.col("non_null_count") == 0) | (F.coalesce("beyond", F.lit(0)) == 0), "NO")
        .when(F.col("max_variance") == 0, "NO")
        .otherwise("POSSIBLE CASCADE")
    )
    empty = F.col("total_rows") - F.col("non_null_count")
    return (
        grouped.join(F.broadcast(spread), "feature")
        .join(F.broadcast(beyond), "feature", "left")
        .withColumn("null_count", empty)
        .withColumn("null_rate_pct", rate(empty * 100, F.col("total_rows")))
        .withColumn("cascade_risk", risk)
        .drop("max_variance", "beyond")
    )


def feature_set_check(spark, train: DataFrame, future: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Missing, disallowed and target-derived features per set."""
    found = []
    for name, wanted in sets.items():
        gaps = [[f for f in wanted if f not in df.columns] for df in (train, future)]
        leaks = [f for f in wanted if f in params.TARGET_DERIVED]
        ok = not gaps[0] and not gaps[1] and not leaks
        found.append((name, "PASS" if ok else "FAIL", len(wanted), *[",".join(x) or "None" for x in (*gaps, leaks)]))
    return spark.createDataFrame(
        found,
        "feature_set string, status string, feature_count int, missing_in_train string, missing_in_future string, "
        "leakage string",
    )


def line_total_identity(fact: DataFrame, bound: float = 1000.0) -> DataFrame:
    gap = F.max(F.abs(F.col("line_total") - F.col("quantity") * F.col("unit_price"))).cast(DOUBLE)
    return fact.agg(gap.alias("max_difference")).withColumn("status", status(F.col("max_difference") < bound))


def duplicate_lines(fact: DataFrame) -> DataFrame:
    return fact.groupBy("order_id", "product_code").agg(rows().alias("n")).where("n > 1")


def orphan_count(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    keys = parent.select(F.col(key).alias(column)).distinct()
    lost = child.where(F.col(column).isNotNull()).select(column).join(keys, column, "left_anti")
    return lost.agg(rows().alias("violations")).withColumn("check", F.lit(name))


def predicate_count(df: DataFrame, broken: Column, name: str) -> DataFrame:
    return df.agg(F.count_if(broken).alias("violations")).withColumn("check", F.lit(name))


def fk_check(parts: list[DataFrame]) -> DataFrame:
    """Declared keys and value rules as counts of violations."""
    return union_all(parts).select("check", "violations", status(F.col("violations") == 0).alias("status"))
