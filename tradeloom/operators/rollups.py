"""Totals and distinct counts that are kept up or rolled up without reading the lines again.

*Order totals.* Each order's totals are sums, so a change adds its signed amounts: +1 for an inserted line, -1 for
a deleted one, both for an update. The totals are stored by a hash of the order, and an update rewrites only the
parts in which an order changed, in one step.

*Distinct counts.* Counts of different values do not add up, sets do. A set is stored as bitmaps over dense
numbers of the values, in buckets of a fixed number of bits, so sets of days or months unite to those of
quarters and years by a bitwise or that Spark combines before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators.ranking import row_numbers
from tradeloom.sources import versions

#: Parts in which order totals are stored.
PARTS = 64
TOTALS = {"amount": "decimal(38,2)", "quantity": "decimal(38,2)", "line_count": "bigint"}


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _order_sums(lines: DataFrame, sign: Column) -> DataFrame:
    """Signed sums per order."""
    values = {"amount": F.col("line_total") * sign, "quantity": F.col("quantity") * sign, "line_count": sign}
    return lines.groupBy("order_id").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast(TOTALS[c]).alias(c) for c, v in values.items()])


def start_order_totals(lines: DataFrame, path: str, parts: int = PARTS) -> int:
    """Store the totals of all orders that have lines."""
    totals = _order_sums(lines, F.lit(1)).withColumn("part", _part(F.col("order_id"), parts))
    return versions.commit(totals.select("order_id", *TOTALS, "part"), path, ["part"])


def change_order_totals(changes: DataFrame, path: str, parts: int = PARTS) -> int:
    """Add changed lines, with +1 or -1 in ``sign``, to the stored totals; gives the new version.

    Totals of untouched orders are neither read nor written, unless they share a part with a changed one. An order
    whose last line goes is no longer stored.
    """
    spark = changes.sparkSession
    delta = _order_sums(changes, F.col("sign")).withColumn("part", _part(F.col("order_id"), parts))
    touched = sorted(r["part"] for r in delta.select("part").distinct().collect())  # at most ``parts``
    old = versions.read(spark, path).where(F.col("part").isin(touched))
    sums = old.unionByName(delta).groupBy("order_id", "part").agg(*[F.sum(c).cast(kind).alias(c) for c, kind in TOTALS.items()])
    kept = sums.where("line_count > 0").select("order_id", *TOTALS, "part")
    return versions.commit(kept, path, ["part"], replaced=[(p,) for p in touched])


def order_totals(spark: SparkSession, orders: DataFrame, path: str) -> DataFrame:
    """Header totals as of the last change; 0 for an order without lines."""
    stored = versions.read(spark, path)
    return orders.select("order_id").join(stored, "order_id", "left").select(
        "order_id", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.col("quantity").cast("bigint"), F.lit(0)).alias("total_quantity"), F.coalesce("line_count", F.lit(0)).alias("line_count"),
    )


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, id): the different values, numbered from 0 without gaps."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    values = values.withColumn("__same", F.lit(0)).withColumn("__text", F.col(column).cast("string"))
    return row_numbers(values, "__same", "__text", "id").select(column, F.col("id").cast("bigint").alias("id"))


def distinct_sets(df: DataFrame, keys: list[str], column: str, ids: DataFrame) -> DataFrame:
    """(keys, bucket, bits): for each group the set of its values, NULL left out."""
    numbered = df.select(*keys, column).distinct().join(ids, column).select(*keys, "id")
    bucket, position = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    return numbered.groupBy(*keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bits"))


def unite(sets: DataFrame, keys: list[str]) -> DataFrame:
    """The sets of coarser groups."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_sizes(sets: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of different values in each group of ``keys``."""
    return unite(sets, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def sizes_by_grain(sets: DataFrame, grains: dict[str, list[str]], keys: list[str], name: str) -> DataFrame:
    """Sizes for several grains from one table of sets; ``keys`` that a grain lacks are NULL."""

    def of(grain: str, own: list[str]) -> DataFrame:
        found = set_sizes(sets, own, name)
        return found.select(F.lit(grain).alias("grain"), *[F.col(k) if k in own else F.lit(None).cast("int").alias(k) for k in keys], name)

    return reduce(DataFrame.unionByName, [of(g, k) for g, k in grains.items()])
