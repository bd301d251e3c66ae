"""Intermediate tables that are read more than once.

``materialize`` writes a frame to the shared folder the cluster names in
``spark.checkpoint.dir`` and reads it back. That cuts the lineage, survives the loss of
executors, and gives the planner real sizes for its join choices.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_used: set[str] = set()
_named: list[str] = []


def _drop_at_exit(spark: SparkSession) -> None:
    """Delete the application's tables when its driver ends, if the session is still there."""
    try:
        for name in _named:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_tables(spark)
    except Exception:  # the session is gone: the tables stay until the folder is cleaned
        pass


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a temporary one only in local mode."""
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and shared.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is a folder of one machine; name one that all executors can reach")
    if shared:
        if spark.sparkContext.applicationId not in _used:
            _used.add(spark.sparkContext.applicationId)
            atexit.register(_drop_at_exit, spark)
        return f"{shared.rstrip('/')}/tradeloom/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tradeloom-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def write_buckets(df: DataFrame, key: str, label: str, sort: bool = False) -> str:
    """Write ``df``, which is dealt by ``key`` already or not, in buckets of it; gives the table's name, which is forgotten at the end.

    The number of buckets is that of shuffle partitions, so that a frame dealt by the key makes one file for each.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    (writer.sortBy(key) if sort else writer).option("path", f"{work_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    _named.append(name)
    return name


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative trainers cut their lineage; keeps a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark))
