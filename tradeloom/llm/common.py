"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may carry to a Python worker. Texts can be long, so the
#: bound on bytes is what keeps a worker's memory flat.
BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20

#: White space that separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Cap what one Arrow batch holds, by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted`` or, if a column of that name exists (case does not matter), a free variant."""
    lower = {c.lower() for c in taken}
    name, n = wanted, 0
    while name.lower() in lower:
        n += 1
        name = f"{wanted}_{n}"
    return name


def utf8(column: str | Column) -> Column:
    """The text as bytes; a null is the empty text."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def blobs(array: pa.Array) -> Iterator[bytes]:
    """The values of a binary array, one at a time."""
    for value in array:
        yield value.as_py() or b""


def parts_for(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_by_hash(df: DataFrame, size: int, seed: int, *columns: str) -> DataFrame:
    """At most ``size`` rows: those first in a seeded order of ``columns``.

    Rows that lie far back in the order are left out before anything is sorted, so what one task
    sorts stays near ``size`` however long the table is. Equal rows have one place, so places are
    shared out by the number of different ones.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40))
    near = int((1 << 40) * min(1.0, 1.3 * (size + 100) / max(1, df.select(*columns).distinct().count())))
    return df.filter(place <= near).orderBy(place, *columns).limit(size)
