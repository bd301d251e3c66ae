"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one point with a number of copies. In each pass every point gets a key,
the signs of its projections on ``KEY_BITS`` random directions in a row, other ones in every pass.
Points of a label are ordered by their keys, and each is compared with the ``window`` that follow it.
Pairs that reach the cosine are links; the links of all passes are united into components.

Two points at the cosine agree in the leading bits of their keys with a known chance. So many
bits are looked at that about ``window`` evenly spread points agree in them, and passes are added
until the chance that a pair never does is below ``MISS``. Points that agree in them lie in one stretch
of the order. A stretch no longer than a window is covered by the windows of its points. Where points
stand close together a stretch is longer: one of up to ``block`` points is compared as a whole, and
one beyond that, counted first, is cut into chunks by a hash, every pair of chunks being a task
of its own. So what lies around a pair never hides it. Only spanning forests leave a task.

The order is dealt to tasks in parts of the key's range that hold a few whole stretches, so that a part
is no longer than a few blocks, and the result does not depend on the number of partitions.

Then the links are counted: within each component every point is compared with every other, in
blocks of at most twice ``BLOCK`` points that are tasks of their own. Only counts and labels of
components leave a task, never the pairs of a group.

Rules: only points with equal, not null labels and equal dimension are compared; vectors that are
null, zero or not finite link with nothing, their copies included; a row is ``kept`` if it has the
smallest id of its component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, parts_for
from tradeloom.llm.components import components, local_forest
from tradeloom.llm.vectors import as_doubles, matrix, runs, usable
from tradeloom.storage import materialize

COSINE = 0.98
WINDOW = 24
MISS = 1e-4
BLOCK = 1024
SEED = 42
#: Bits of a key, and by how many a part of the order has fewer than a stretch.
KEY_BITS, PART_BITS = 63, 3


def bits_for(points: int, window: int = WINDOW) -> int:
    return min(63, math.ceil(math.log2(max(1.0, points / window))))


def passes_for(points: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    hit = (1 - math.acos(cosine) / math.pi) ** bits_for(points, window)
    return max(4, math.ceil(math.log(miss) / math.log(1 - hit))) if hit < 1 else 4


def _planes(dimension: int, number: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dimension]).standard_normal((dimension, bits))


def _keys(n_passes: int, bits: int, seed: int, units: bool = True):
    """Adds a row for each pass with its key, the bits as one number; the vector at length 1 only with ``units``."""
    powers = 1 << np.arange(bits, dtype=np.int64)
    names = ["pass", "label", "size", "key", "id", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2)])
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                x = matrix(rows.column(2))
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                unit = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))] if units else []
                for number in range(n_passes):
                    key = ((x @ _planes(x.shape[1], number, bits, seed)) > 0) @ powers
                    columns = [pa.array(np.full(len(x), number, np.int32)), rows.column(1), pa.array(np.full(len(x), size, np.int32)), pa.array(key), rows.column(0)]
                    yield pa.RecordBatch.from_arrays(columns + unit, names=names[: 5 + units])

    return run


def _spanning(linked: np.ndarray) -> Iterator[np.ndarray]:
    """The members of each component of a symmetric matrix of links; points without links are left out."""
    waiting = linked.any(axis=1)
    while waiting.any():
        front = np.zeros(len(linked), bool)
        front[waiting.argmax()] = True
        reached = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~reached
            reached |= front
        waiting &= ~reached
        yield np.flatnonzero(reached)


def _links(cosine: float, window: int, bits: int):
    """Reads (pass, label, size, part, i, j, key, own, id, unit) sorted in this order; emits the task's links as a forest.

    A part of the order has i = -1: its points are compared in windows, long stretches as a whole. Others are pairs of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        n_links = 0

        def spanned(linked: np.ndarray, ids: np.ndarray) -> None:
            nonlocal n_links
            for members in _spanning(linked):
                left.append(np.full(len(members) - 1, ids[members[0]]))
                right.append(ids[members[1:]])
                n_links += len(members) - 1

        def whole(x: np.ndarray, ids: np.ndarray) -> None:
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            spanned(linked, ids)

        def ordered(x: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
            nonlocal n_links
            for step in range(1, min(window, len(x) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= cosine)
                left.append(ids[near])
                right.append(ids[near + step])
                n_links += len(near)
            starts, ends = runs((key >> (KEY_BITS - bits))[:, None])
            for s, e in zip(starts[ends - starts > window + 1].tolist(), ends[ends - starts > window + 1].tolist()):
                whole(x[s:e], ids[s:e])

        def settle(table: pa.Table, last: bool) -> pa.Table:
            table = table.combine_chunks()
            keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(6)], axis=1)
            key, own, ids = (table.column(k).to_numpy() for k in (6, 7, 8))
            values, at = table.column(9).chunk(0).flatten().to_numpy(), np.concatenate([[0], np.cumsum(keys[:, 2])])
            starts, ends = runs(keys)
            several = np.flatnonzero(ends - starts > 1)
            for s, e in zip(starts[several].tolist(), ends[several].tolist()):
                if e == len(keys) and not last:
                    continue
                x, i, j = values[at[s] : at[e]].reshape(e - s, -1), keys[s, 4], keys[s, 5]
                if i < 0:
                    ordered(x, key[s:e], ids[s:e])
                elif i == j:
                    whole(x, ids[s:e])
                else:
                    first, other = np.flatnonzero(own[s:e] == i), np.flatnonzero(own[s:e] == j)
                    linked = np.zeros((e - s, e - s), bool)
                    linked[np.ix_(first, other)] = x[first] @ x[other].T >= cosine
                    spanned(linked | linked.T, ids[s:e])
            return table.slice(int(starts[-1]))

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal n_links
            if n_links >= least:
                u, v = local_forest(np.concatenate(left), np.concatenate(right))
                left.clear()
                right.clear()
                n_links = 0
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            held = settle(table, False) if len(table) else held
            yield from flush(1 << 20)
        if held is not None:
            settle(held, True)
        yield from flush(1)

    return run


def _counts(cosine: float):
    """Reads (component, i, j, own, id, copies, unit) sorted by block; emits each point's linked copies and links in the block."""

    def settle(own: np.ndarray, i: int, j: int, ids, copies, units) -> Iterator[pa.RecordBatch]:
        a = np.flatnonzero(own == i)
        b = a if i == j else np.flatnonzero(own == j)
        linked = units[a] @ units[b].T >= cosine
        if i == j:
            np.fill_diagonal(linked, False)
        pieces = [(ids[a], linked @ copies[b], linked.any(axis=1))]
        if i != j:
            pieces.append((ids[b], linked.T @ copies[a], linked.any(axis=0)))
        for who, n, _ in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n.astype(np.int64))], names=["id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            starts, ends = runs(keys)
            for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist()):
                yield from _block(table.slice(s, e - s), settle)
            held = table.slice(int(starts[-1]))
        if held is not None:
            yield from _block(held, settle)

    return run


def _block(table: pa.Table, settle) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
    own, ids, copies = (table.column(k).to_numpy() for k in (3, 4, 5))
    yield from settle(own, i, j, ids, copies, matrix(table.column(6).chunk(0)))


def near_duplicates(
    df: DataFrame, cosine: float = COSINE, window: int = WINDOW, ids: str = "vec_id", vector: str = "embedding", label: str = "label",
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept."""
    bound_batches(df.sparkSession)
    spark, n_parts = df.sparkSession, parts_for(df)
    rows = df.select(F.col(f"`{ids}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").alias("v"))
    good = usable("v") & F.col("label").isNotNull()
    rows = rows.select("vec_id", "label", good.alias("good"), F.when(good, as_doubles("v")).alias("v"))
    points = rows.filter("good").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()), "vector-points")
    n = points.count()
    bits, n_passes = bits_for(n, window), passes_for(n, cosine, window)
    schema, group = "pass int, label bigint, size int, key bigint, id bigint", ["pass", "label", "size", "stretch"]
    bare, stretch = points.select("id", "label", "v"), F.shiftright("key", KEY_BITS - bits)
    counts = bare.mapInArrow(_keys(n_passes, KEY_BITS, seed, False), schema).groupBy(*group[:3], stretch.alias("stretch")).count()
    hot = counts.filter(F.col("count") > block).select(*group, F.ceil(F.col("count") / block).cast("int").alias("chunks"))
    hot = materialize(hot, "vector-hot")
    schema += ", unit array<double>"
    keyed = bare.mapInArrow(_keys(n_passes, KEY_BITS, seed), schema).withColumn("stretch", stretch).join(hot, group, "left")
    long, none = F.col("chunks").isNotNull(), F.lit(-1)
    keyed = keyed.withColumn("own", F.when(long, F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).otherwise(none))
    others = F.when(long, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(none))
    keyed = keyed.withColumn("other", F.explode(others))
    part = F.when(long, F.col("stretch")).otherwise(F.shiftright("key", KEY_BITS - max(0, bits - PART_BITS))).alias("part")
    ends = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    dealt = keyed.select(*group[:3], part, *ends, "key", "own", "id", "unit")
    pairs = ["pass", "label", "size", "part", "i", "j"]
    dealt = dealt.repartition(n_parts, *pairs).sortWithinPartitions(*pairs, "key", "id")
    roots = components(dealt.mapInArrow(_links(cosine, window, bits), "u bigint, v bigint"), "vectors")
    roots = materialize(roots.select(F.col("node").alias("id"), "root"), "vector-roots")
    members = roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("size"))
    units = points.join(members.select("id"), "id", "left_semi").select("id", "label", "v").mapInArrow(_keys(1, 0, seed), schema)
    member = members.join(sizes, "root").join(units.select("id", "unit"), "id").join(points.select("id", "copies"), "id")
    member = member.withColumn("chunks", F.ceil(F.col("size") / block).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    blocks = member.withColumn("other", other).select(
        F.col("root"), F.least("own", "other").cast("bigint").alias("i"), F.greatest("own", "other").cast("bigint").alias("j"),
        F.col("own").cast("bigint").alias("own"), "id", "copies", "unit",
    )
    blocks = blocks.repartition(n_parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    linked = blocks.mapInArrow(_counts(cosine), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    least = members.join(points.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("component"))
    of = members.join(least, "root").select("id", "component")
    found = points.join(linked, "id", "left").join(of, "id", "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")
    )
    joined = rows.filter("good").join(found, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The contract of query 5 over any table like embeddings."""
    return near_duplicates(vectors)
