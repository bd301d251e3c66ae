"""Helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLE = "double"


def rate(numerator: Column, denominator: Column) -> Column:
    """Quotient of two numbers as double; NULL when the denominator is 0."""
    return F.try_divide(numerator.cast(DOUBLE), denominator.cast(DOUBLE))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; the keys of ``left`` are kept."""
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def explode_rows(df: DataFrame, rows: list[dict], types: dict[str, str]) -> DataFrame:
    """Repeat every row once per entry of a short literal list, adding the entry's fields."""
    entries = [
        F.struct(*[F.lit(row[name]).cast(kind).alias(name) for name, kind in types.items()]) for row in rows
    ]
    return df.withColumn("__entry", F.explode(F.array(*entries))).select(*df.columns, "__entry.*")


def shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
