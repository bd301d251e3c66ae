"""SHA-256 of input files, each read as a stream by a task.

The driver lists names and sizes only. A task opens its files one after the other and holds one
chunk and the state of the hash, so a file may have any size, none included. Files in stores that
the tasks cannot open by themselves are read by Spark's text source in pieces of raw bytes between
line feeds, which a task for each file hashes in their order; what stands between two line feeds is
then a row, and must fit in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.sources import splits

CHUNK = 4 << 20
#: Schemes that tasks open by themselves.
OPENED = ("file", "s3", "gs", "hdfs", "abfs")
BOM = b"\xef\xbb\xbf"
LISTED = "path string, file_name string, n_bytes bigint"
HASHED = "file_name string, n_bytes bigint, sha256 string"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, n_bytes), the path as a URI, of the files of a folder, empty ones too; hidden ones (``.`` and ``_``) are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    files = [(f.getPath().toUri().toString(), f.getPath().getName(), f.getLen()) for f in found if f.isFile()]
    return spark.createDataFrame([f for f in files if f[1][0] not in "._"], LISTED)


def _hashes(names: list, sizes: list, digests: list) -> pa.RecordBatch:
    columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file_name", "n_bytes", "sha256"])


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + unquote(path[5:]).lstrip("/"), compression=None)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner, compression=None)


def _stream(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, size in zip(*(c.to_pylist() for c in batch.columns)):
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                yield _hashes([name], [size], [digest.hexdigest()])

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (path, file_name, n_bytes, piece) sorted by file and place; a line feed stands between pieces, and may end the file."""
    now, states, fed = None, (), 0

    def done() -> pa.RecordBatch:
        _, name, size = now
        bare, marked = states  # the text source leaves out a byte order mark at the start
        state, missing = (bare, size - fed) if size - fed < len(BOM) else (marked, size - fed - len(BOM))
        state.update(b"\n" * missing)
        return _hashes([name], [size], [state.hexdigest()])

    for batch in batches:
        for path, name, size, piece in zip(*batch.columns):
            key = (path.as_py(), name.as_py(), size.as_py())
            if key != now:
                if now is not None:
                    yield done()
                now, states, fed, between = key, (hashlib.sha256(), hashlib.sha256(BOM)), 0, b""
            data = between + (piece.as_py() or b"")
            between, fed = b"\n", fed + len(data)
            for state in states:
                state.update(data)
    if now is not None:
        yield done()


def input_manifest(spark: SparkSession, folder: str, pattern: str = "*", chunk: int = CHUNK, opened: tuple[str, ...] = OPENED) -> DataFrame:
    """File name, size and SHA-256 of every file of a folder."""
    files = list_files(spark, folder, pattern)
    direct = F.substring_index("path", ":", 1).isin(*opened)
    n = max(1, files.count())
    out = files.where(direct).repartition(n, "path").mapInArrow(_stream(chunk), HASHED)
    rest = files.where(~direct)
    if rest.isEmpty():
        return out
    pieces = splits.pieces(spark, f"{folder.rstrip('/')}/{pattern}", "\n").withColumn("text", F.col("text").cast("binary"))
    told = rest.join(pieces, rest.path == pieces.file, "left").select("path", "file_name", "n_bytes", "start", "place", "text")
    told = told.repartition(n, "path").sortWithinPartitions("path", "start", "place")
    return out.unionByName(told.select("path", "file_name", "n_bytes", "text").mapInArrow(_in_order, HASHED))
