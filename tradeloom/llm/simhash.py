"""SimHash near-duplicates by pivot distance tables.

A fingerprint takes the majority of each bit over the hashes of a text's word shingles. Equal
fingerprints are one point. Two points link when at most ``max_bits`` bits differ.

*Routing.* The Hamming distances of 64-bit fingerprints to fixed references crowd around 32, so the
distances alone cannot spread points over tasks: cells of their grid that are wide enough to keep
every link would hold nearly everything. Points are therefore routed by blocks of bits: with
``max_bits + keep`` blocks, two linked points agree in ``keep`` of them, so they meet in one of the
routes made from every choice of ``keep`` blocks. Nothing is lost and nothing is compared twice
across the whole table.

*Pivots.* In a route each point carries a table of its Hamming distances to many reference
fingerprints. Points are sorted by the first distance; only points in the range of ``max_bits``
around it are looked at, pairs whose distances to any reference differ by more than ``max_bits``
are discarded (the triangle inequality), and the survivors are verified bit by bit. A point that
is reached leaves the list, so a dense group of near copies costs little more than its size, and
a task emits a spanning forest, never all pairs.

*Hot routes.* Points of a route are counted first. A route of more than ``chunk`` points is cut
into chunks by a hash, and every pair of chunks is a task of its own, which bounds what one task
holds without losing a pair.

Rules: a null text is the empty text; a text without words has fingerprint zero and links like any
other; a row keeps its place however often it is repeated; the smallest id of a component ignores
null ids unless there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, free_name, parts_for, utf8
from tradeloom.llm.components import components, local_forest
from tradeloom.storage import materialize

KEEP_BLOCKS = 3
CHUNK = 4096
PIVOTS = 24
#: Routes of at most so many points are compared together, longer ones one by one.
SHORT = 24
SEED = 42


def fingerprint_of(text: bytes, words: int, seed: int) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # on bytes both touch ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, seed: int = SEED, name: str = "fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a signed long, under a free name like ``name``."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def fp(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint_of(x.as_py(), words, seed) for x in batch], pa.int64())

    return df.withColumn(free_name(df.columns, name), fp.asNondeterministic()(utf8(text)))


def block_masks(max_bits: int, keep: int) -> list[int]:
    """For every choice of ``keep`` of ``max_bits + keep`` blocks of bits, the mask of their bits."""
    n = max_bits + keep
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [sum(choice) for choice in combinations(blocks, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_references(n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(points: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances, one row for each reference."""
    return np.stack([np.bitwise_count(points ^ r) for r in references]).astype(np.int8)


def forest_of(points: np.ndarray, max_bits: int, references: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among distinct points, found with a pivot distance table."""
    first = np.bitwise_count(points ^ references[0]).astype(np.int8)
    order = np.argsort(first, kind="stable")
    points, first = points[order], first[order]
    table = pivot_table(points, references)
    waiting = np.arange(len(points))
    left: list[int] = []
    right: list[int] = []
    frontier: list[int] = []
    while len(waiting):
        if not frontier:
            frontier, waiting = [int(waiting[0])], waiting[1:]
        p = frontier.pop()
        lo = np.searchsorted(first[waiting], first[p] - max_bits, "left")
        hi = np.searchsorted(first[waiting], first[p] + max_bits, "right")
        near = waiting[lo:hi]
        for row in table[1:]:
            if not len(near):
                break
            near = near[np.abs(row[near] - row[p]) <= max_bits]
        if len(near):
            near = near[np.bitwise_count(points[near] ^ points[p]) <= max_bits]
        if len(near):
            left += [int(points[p])] * len(near)
            right += points[near].tolist()
            frontier += near.tolist()
            waiting = waiting[~np.isin(waiting, near, assume_unique=True)]
    return left, right


def _forests(max_bits: int, references: np.ndarray):
    """Reads (route..., fp) sorted by route, one run per route; emits the task's links as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        held: np.ndarray | None = None

        def settle(block: np.ndarray) -> None:
            edges = np.flatnonzero((block[1:, :-1] != block[:-1, :-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(block)]])
            points = block[:, -1].view(np.uint64)
            for a, b in zip(starts[ends - starts > SHORT].tolist(), ends[ends - starts > SHORT].tolist()):
                x, y = forest_of(points[a:b], max_bits, references)
                left.extend(x)
                right.extend(y)
            run_of = np.repeat(np.arange(len(starts)), ends - starts)
            short = np.flatnonzero(((ends - starts > 1) & (ends - starts <= SHORT))[run_of])
            points, run_of = points[short], run_of[short]
            table = pivot_table(points, references)
            for step in range(1, SHORT):
                at = np.flatnonzero(run_of[step:] == run_of[:-step])
                if not len(at):
                    break
                for row in table:
                    at = at[np.abs(row[at + step] - row[at]) <= max_bits]
                at = at[np.bitwise_count(points[at] ^ points[at + step]) <= max_bits]
                left.extend(points[at].tolist())
                right.extend(points[at + step].tolist())

        def flush(force: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left, right
            if left and (force or len(left) > 1 << 20):
                u, v = local_forest(np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64))
                left, right = [], []
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            block = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held is not None:
                block = np.concatenate([held, block])
            other = np.flatnonzero((block[:, :-1] != block[-1, :-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                settle(np.ascontiguousarray(block[:cut]))
            held = block[cut:]
            yield from flush(False)
        if held is not None and len(held):
            settle(np.ascontiguousarray(held))
        yield from flush(True)

    return run


def link_points(points: DataFrame, max_bits: int = 4, keep: int = KEEP_BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for all distinct fingerprints that are not the smallest of their component."""
    bound_batches(points.sparkSession)
    masks = block_masks(max_bits, keep)
    routes = F.array(*[F.struct(F.lit(i).alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    routed = points.select("fp", F.explode(routes).alias("r")).select("fp", "r.route", "r.key")
    hot = routed.groupBy("route", "key").count().filter(F.col("count") > chunk)
    hot = materialize(hot.select("route", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "simhash-hot")
    routed = routed.join(hot, ["route", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    dealt = (
        routed.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("route", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    n = parts_for(points)
    spread = dealt.repartition(n, "route", "key", "i", "j").sortWithinPartitions("route", "key", "i", "j", "fp")
    links = spread.mapInArrow(_forests(max_bits, pivot_references()), "u bigint, v bigint")
    return components(links, "simhash")


def classes(marked: DataFrame, max_bits: int = 4, ids: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of all points, root being the component's least fingerprint; ``marked`` has ``fp`` and the id column."""
    points = materialize(marked.groupBy("fp").agg(F.min(ids).alias("least_id")), "simhash-points")
    roots = link_points(points.select("fp"), max_bits)
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract of query 1 over any table with doc_id and text."""
    marked = materialize(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash-marked")
    found = marked.join(classes(marked), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = 4, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id (a null id last); all columns as they were."""
    kept = docs.columns
    row, fp = free_name(kept, "row_uid"), free_name(kept, "fp")
    marked = fingerprints(docs, text, name=fp).withColumn(row, F.monotonically_increasing_id())
    marked = materialize(marked, "simhash-rows")
    slim = marked.select(F.col(f"`{ids}`").alias("id"), F.col(row).alias("uid"), F.col(fp).alias("fp"))
    found = slim.join(classes(slim, max_bits, "id"), "fp")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))).alias("m"))
    return marked.join(first.select(F.col("m.uid").alias(row)), row, "left_semi").select(*[f"`{c}`" for c in kept])
