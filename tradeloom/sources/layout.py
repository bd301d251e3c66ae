"""Tables laid out by a key, so that joins and groups on it move no rows.

A table is written in buckets of its key, sorted inside. Two tables with the same number of buckets join on it
bucket by bucket, and grouping by it, or by it and more, needs no shuffle either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradeloom.operators.common import shuffle_partitions
from tradeloom.storage import write_buckets


def laid_out(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """``df`` written by ``key`` and read back."""
    dealt = df.repartition(shuffle_partitions(df), key)
    return df.sparkSession.table(write_buckets(dealt, key, label, sort=True))
