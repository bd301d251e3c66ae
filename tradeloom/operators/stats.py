"""Distribution analysis and ranking metrics of a binary score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions.rules import first_match
from tradeloom.operators.common import DOUBLE, join_null_safe, rate
from tradeloom.operators.forecast import exact_sum
from tradeloom.operators.ranking import cumulate, quantiles, with_share
from tradeloom.operators.views import cumulative_bins


def describe_distribution(df: DataFrame, columns: list[str], percents: list[int] | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes, skewness and exact percentiles per column.

    All columns are described in one pass over the unpivoted values.
    """
    percents = percents or params.DESCRIBE_PERCENTS
    long = df.select(*[F.col(c).cast(DOUBLE) for c in columns]).unpivot([], columns, "measure", "value")
    long = long.where(F.col("value").isNotNull())
    moments = long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.coalesce(F.skewness("value"), F.lit(0.0)).alias("skew"),
    )
    cuts = quantiles(long, ["measure"], "value", {f"p{p}": p / 100 for p in percents})
    return moments.join(F.broadcast(cuts), "measure")


def closed_bins(df: DataFrame, column: str, bins: list[tuple[int, int | None]]) -> DataFrame:
    """Rows per closed integer bin with share and running share of all rows; empty bins are kept.

    A last bin without an upper end (``None``) takes all that is larger.
    """
    value = F.col(column)
    rules = [(value >= lo if hi is None else value.between(lo, hi), i) for i, (lo, hi) in enumerate(bins)]
    bounds = [(lo, float("inf") if hi is None else hi) for lo, hi in bins]
    counted = _counts_with_empty(df, first_match(rules, None), bounds, [])
    return cumulative_bins(counted, "bin", "n")


def half_open_bins(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Rows and revenue per bin [edge, next edge) with shares of all rows; the last bin has no upper end."""
    value = F.col(column)
    uppers = [*edges[1:], None]
    rules = [
        ((value >= lo) & (value < hi) if hi is not None else (value >= lo), i)
        for i, (lo, hi) in enumerate(zip(edges, uppers))
    ]
    bins = list(zip(edges, [float("inf") if u is None else u for u in uppers]))
    counted = _counts_with_empty(df, first_match(rules, None), bins, [exact_sum(column, 2).alias("revenue")])
    return cumulative_bins(counted, "bin", "n")


def _counts_with_empty(df: DataFrame, number: Column, bins: list[tuple], extra: list[Column]) -> DataFrame:
    """Counts by bin, and ``all_rows``, which rows outside all bins belong to as well."""
    grouped = df.withColumn("bin", number).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *extra)
    whole = grouped.agg(F.sum("n")).scalar()  # at most one row more than there are bins
    all_bins = df.sparkSession.createDataFrame(
        [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(bins)], "bin int, low double, high double"
    )
    joined = all_bins.join(grouped, "bin", "left")
    fill = {"n": 0, "revenue": 0.0}
    filled = joined.na.fill({k: v for k, v in fill.items() if k in joined.columns})
    return filled.withColumn("all_rows", whole)


def last_purchase_month(fact: DataFrame) -> DataFrame:
    """Customers by the month of their last order."""
    last = fact.groupBy("customer_code").agg(F.max("order_date").alias("last"))
    counted = last.groupBy(F.date_format("last", "yyyy-'T'MM").alias("period")).agg(F.count(F.lit(1)).alias("n_customers"))
    return with_share(counted, "n_customers", "share_pct", 100.0)


def score_histogram(scored: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows per score under the equal-size and the threshold method.

    ``columns`` maps a measure to its (equal size, threshold) score columns.
    """
    pairs = ", ".join(
        f"'{measure}', 'equal_size', {a}, '{measure}', 'threshold', {b}" for measure, (a, b) in columns.items()
    )
    long = scored.selectExpr(f"stack({2 * len(columns)}, {pairs}) as (measure, method, score)")
    counted = long.groupBy("measure", "method", "score").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("measure", "method").agg(F.sum("n").alias("__all"))
    joined = counted.join(F.broadcast(totals), ["measure", "method"])
    return joined.withColumn("share_pct", rate(F.col("n") * 100, F.col("__all"))).drop("__all")


def monthly_trend(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.sum("line_total").cast(DOUBLE).alias("revenue")
    )


def region_share(fact: DataFrame) -> DataFrame:
    """Revenue per region; rows without a region only count in the whole."""
    grouped = fact.groupBy("region").agg(F.sum("line_total").cast(DOUBLE).alias("revenue"))
    return with_share(grouped, "revenue", "share_pct", 100.0).where(F.col("region").isNotNull())


# ranking metrics -----------------------------------------------------------------


def _by_score(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return cumulate(counts, keys, score, ["pos", "n"])


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    keys = keys or []
    ranked = _by_score(df, label, score, keys)
    neg_before, neg = F.col("before_n") - F.col("before_pos"), F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos") * (neg_before + neg / F.lit(2.0)))
    pairs = F.max("all_pos") * (F.max("all_n") - F.max("all_pos"))
    return ranked.groupBy(*keys).agg(
        F.max("all_n").alias("n"), F.max("all_pos").alias("positives"), F.try_divide(wins, pairs.cast(DOUBLE)).alias("roc_auc")
    )


def average_precision(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores of the recall step times the precision reached."""
    keys = keys or []
    ranked = _by_score(df, label, score, keys)
    found = F.col("all_pos") - F.col("before_pos")
    seen = F.col("all_n") - F.col("before_n")
    steps = F.sum(F.col("pos") * found / seen)
    return ranked.groupBy(*keys).agg(F.try_divide(steps, F.max("all_pos").cast(DOUBLE)).alias("average_precision"))


def metrics_by_segment(df: DataFrame, label: str, score: str, segment: str) -> DataFrame:
    """AUC and average precision for the segments in which both classes occur."""
    auc = roc_auc(df, label, score, [segment]).where((F.col("positives") > 0) & (F.col("positives") < F.col("n")))
    ap = average_precision(df, label, score, [segment])
    return join_null_safe(auc, ap, [segment])


def precision_recall_at(df: DataFrame, label: str, score: str, key: str, ks: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Precision and recall of the k best scores, for each k that does not exceed the rows."""
    whole = df.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    ).scalar()
    best = df.select(score, key, F.col(label).cast("bigint").alias("y")).orderBy(F.desc(score), key).limit(max(ks))
    position = F.row_number().over(Window.orderBy(F.desc(score), key))
    ranked = best.withColumn("position", position).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return (
        ranked.where(F.col("position") <= F.col("k"))
        .groupBy("k")
        .agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("taken"))
        .where(F.col("taken") == F.col("k"))
        .withColumn("n", whole.getField("n"))
        .withColumn("positives", whole.getField("positives"))
        .select(
            "k",
            rate(F.col("hits"), F.col("k")).alias("precision"),
            F.coalesce(rate(F.col("hits"), F.col("positives")), F.lit(0.0)).alias("recall"),
        )
    )


def decile_calibration(df: DataFrame, label: str, score: str, parts: int = 10) -> DataFrame:
    """Rows, actual rate and mean score per right-closed quantile bin, duplicate edges dropped."""
    cuts = quantiles(df, [], score, {f"e{i}": i / parts for i in range(parts + 1)})
    edges = cuts.select(F.array_distinct(F.array(*cuts.columns))).scalar()
    with_edges = df.withColumn("__edges", edges)
    number = F.greatest(F.size(F.filter("__edges", lambda e: e < F.col(score))) - 1, F.lit(0))
    return (
        with_edges.withColumn("decile", number)
        .groupBy("decile")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(label).cast(DOUBLE)).alias("actual_rate"),
            F.avg(score).alias("mean_score"),
        )
    )
