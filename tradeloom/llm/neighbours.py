"""Approximate nearest neighbours by balanced posting lists.

Nearness is the largest inner product. Adding one coordinate turns that into the smallest distance:
points get what their norm lacks to the largest norm, queries get zero.

*Index.* Centroids are fitted on at most ``SAMPLE`` points, those first in a seeded order; every
point is put into posting lists: that of its nearest centroid and, if it lies near a boundary, those
of up to ``COPIES`` centroids that are at most ``BOUNDARY`` farther. Lists are balanced: one that holds
more than ``BLOCK`` points is cut into blocks by a hash, and each block is a piece of work of its own.

*Search.* A graph links every centroid to its nearest ones. It has at most ``LISTS`` nodes and is held
in memory. A query walks it best first, and takes every list whose centroid is at most ``RATIO``
farther than the nearest, or more if these hold too few points. Queries are sent to the blocks of their lists; each task keeps, for a query,
the best of all its blocks. The scores are inner products of the original vectors in double precision.

Equal vectors are one point. With ties going to smaller ids, only its ``k`` + 1 smallest ids can be
among the ``k`` nearest of anything, so only these are carried; equal queries are searched once. Both are
exact. Rules: vectors that are null, zero or not finite take no part; vectors of another dimension than
a query's are no candidates; repeated rows count once; rows without an id take no part; a query with fewer candidates than ``k`` gets them all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, first_by_hash, parts_for
from tradeloom.llm.vectors import as_doubles, matrix, usable
from tradeloom.storage import materialize

SAMPLE = 20_000
LIST_SIZE = 256
LISTS = 2048
COPIES = 4
BOUNDARY = 0.03
RATIO = 0.2
BLOCK = 8192
LINKS = 16
SEED = 42


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Points with the coordinate that makes their norms equal."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, largest**2 - (x**2).sum(axis=1)))])


def scaled(x: np.ndarray, exponent: np.ndarray | int) -> np.ndarray:
    """Rows times a power of two, which changes no digit; squares of what is left fit a double."""
    return np.ldexp(x, -np.asarray(exponent))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(0.0, d))


def centroids(sample: np.ndarray, k: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Lloyd's centroids of a sample; a centroid that loses all its points moves to a far one."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own, off = np.empty(len(sample), np.int64), np.empty(len(sample))
        for at in range(0, len(sample), 2048):
            d = distances(sample[at : at + 2048], centres)
            own[at : at + 2048], off[at : at + 2048] = d.argmin(axis=1), d.min(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
        far = np.argsort(-off)
        centres[~held] = sample[far[: (~held).sum()]]
    return centres


class Graph:
    """Centroids linked to their nearest ones, searched best first."""

    def __init__(self, centres: np.ndarray, links: int = LINKS):
        self.centres = centres
        n = len(centres)
        near = np.argsort(distances(centres, centres), axis=1)[:, 1 : links + 1]
        both = [set(row.tolist()) for row in near]
        for i, row in enumerate(near.tolist()):
            for j in row:
                both[j].add(i)
        for i in range(n - 1):  # a chain keeps the graph in one piece
            both[i].add(i + 1)
            both[i + 1].add(i)
        self.links = [np.array(sorted(b), np.int64) for b in both]
        #: Entry points spread over the centroids.
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def search(self, query: np.ndarray, ratio: float, sizes: dict[int, int], need: int) -> list[int]:
        """Centroids at most ``ratio`` farther than the nearest one found, and the next ones until their lists hold ``need`` entries."""

        def far(which: np.ndarray) -> np.ndarray:
            return np.sqrt(((self.centres[which] - query) ** 2).sum(axis=1))

        seen = np.zeros(len(self.centres), bool)
        seen[self.entries] = True
        queue = list(zip(far(self.entries).tolist(), self.entries.tolist()))
        heapq.heapify(queue)
        found: list[tuple[float, int]] = []
        best, held = math.inf, 0
        patience = 32  # steps that may be taken beyond the ratio, so that the walk crosses small gaps
        while queue:
            d, i = heapq.heappop(queue)
            best = min(best, d)
            if d > best * (1 + ratio) and held >= need:
                patience -= 1
                if not patience:
                    break
            found.append((d, i))
            held += sizes.get(i, 0)
            new = self.links[i][~seen[self.links[i]]]
            if len(new):
                seen[new] = True
                for pair in zip(far(new).tolist(), new.tolist()):
                    heapq.heappush(queue, pair)
        taken, held = [], 0
        for d, i in sorted(found):
            if d > best * (1 + ratio) and held >= need:
                break
            taken.append(i)
            held += sizes.get(i, 0)
        return taken


def _assign(shipped):
    """Points to (list, point): the nearest centroid, and others that are hardly farther."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, largest = shipped.value["graph"].centres, shipped.value["largest"]
        copies = min(COPIES, len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = scaled(matrix(part.column(1)), shipped.value["exponent"])
                d = distances(lift(x, largest), centres)
                near = np.argsort(d, axis=1)[:, :copies]
                close = np.take_along_axis(d, near, axis=1)
                rows, which = np.nonzero(close <= close[:, :1] * (1 + BOUNDARY))
                flat = x[rows]
                vectors = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, x.shape[1], dtype=np.int32), pa.array(flat.ravel()))
                took = part.take(pa.array(rows)).set_column(1, "v", vectors)
                lists = pa.array(near[rows, which].astype(np.int32))
                yield pa.RecordBatch.from_arrays([lists, *took.columns], names=["list", "id", "v", "least"])

    return run


def _probe(shipped):
    """Queries to (list, block, query) for every block of every list that the search takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, blocks, sizes, need = (shipped.value[x] for x in ("graph", "blocks", "sizes", "need"))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = matrix(part.column(1))
                x = scaled(x, np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # a query's length changes no order
                vectors = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                part = part.set_column(1, "v", vectors)
                x = np.column_stack([x, np.zeros(len(x))])
                rows, lists, cells = [], [], []
                for r, query in enumerate(x):
                    for i in graph.search(query, RATIO, sizes, need):
                        for b in range(blocks.get(i, 0)):
                            rows.append(r)
                            lists.append(i)
                            cells.append(b)
                took = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), pa.array(cells, pa.int32()), pa.array(np.ones(len(rows), np.int32)), *took.columns],
                    names=["list", "block", "kind", "id", "v", "least"],
                )

    return run


def _scan(k: int):
    """Reads blocks, points before queries; emits for each query the best of all the task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        here: tuple | None = None
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        joined = None
        for batch in batches:
            head = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]], axis=1)
            edges = np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(head)]):
                part = batch.slice(a, b - a)
                ids, x = part.column(3).to_numpy(zero_copy_only=False), matrix(part.column(4))
                if (cell := tuple(head[a, :2])) != here:
                    here, points, joined = cell, [], None
                if head[a, 2] == 0:
                    points.append((ids, part.column(5).to_numpy(zero_copy_only=False), x))
                    continue
                if not points:
                    continue
                if joined is None:
                    joined = tuple(np.concatenate(c) for c in zip(*points))
                who, least, y = joined
                for at in range(0, len(ids), 256):
                    scores = x[at : at + 256] @ y.T
                    if len(who) > k:
                        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                        edge = np.take_along_axis(scores, top, axis=1).min(axis=1)
                    for r, q in enumerate(ids[at : at + 256].tolist()):
                        s = scores[r]
                        # all that tie with the last are kept until they are ordered by id
                        pick = np.flatnonzero(s >= edge[r]) if len(who) > k else np.arange(len(who))
                        found = (s[pick], least[pick], who[pick])
                        if q in best:
                            found = tuple(np.concatenate(c) for c in zip(best[q], found))
                            _, one = np.unique(found[2], return_index=True)  # a point can be in several lists
                            found = tuple(c[one] for c in found)
                        order = np.lexsort((found[1], -found[0]))[:k]
                        best[q] = tuple(c[order] for c in found)
        if best:
            n = [len(v[0]) for v in best.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(best), np.int64), n)), *(pa.array(np.concatenate([v[c] for v in best.values()])) for c in (2, 1, 0))],
                names=["query", "id", "least", "near"],
            )

    return run


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, ids: str = "vec_id", vector: str = "embedding", seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds, its ``k`` nearest others."""
    bound_batches(df.sparkSession)
    spark, n_parts = df.sparkSession, parts_for(df)
    rows = df.select(F.col(f"`{ids}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable("v") & F.col("vec_id").isNotNull()).withColumn("v", as_doubles("v"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = rows.select("v", "vec_id").distinct().withColumn("place", place).filter(F.col("place") <= k + 1)  # cut before the shuffle, too
    points = members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"), F.min("vec_id").alias("least"))
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()), "ann-points")
    asking = rows.filter("asks").select("vec_id", "v").distinct()  # a row that is repeated asks once
    out = None
    for size in [r[0] for r in points.select(F.size("v").alias("s")).distinct().orderBy("s").collect()]:
        part = _search(spark, points.filter(F.size("v") == size), asking.filter(F.size("v") == size), k, n_parts, seed)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return out


def _search(spark: SparkSession, points: DataFrame, asking: DataFrame, k: int, n_parts: int, seed: int) -> DataFrame:
    n, peak = points.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    exponent = int(np.frexp(peak)[1])
    small = F.transform("v", lambda x: x * F.lit(2.0 ** -(exponent // 2)) * F.lit(2.0 ** -(exponent - exponent // 2)))
    largest = points.agg(F.max(F.sqrt(F.aggregate(small, F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = first_by_hash(points, SAMPLE, seed, "v").select("v").toArrow()
    lists = int(min(LISTS, max(1, math.ceil(n / LIST_SIZE))))
    graph = Graph(centroids(lift(scaled(matrix(sample.column(0).combine_chunks()), exponent), largest), lists, seed))
    shipped = spark.sparkContext.broadcast({"graph": graph, "largest": largest, "exponent": exponent})  # at most ``LISTS`` centroids
    posted = points.select("id", "v", "least")
    posted = posted.mapInArrow(_assign(shipped), "list int, id bigint, v array<double>, least bigint")
    posted = materialize(posted, "ann-lists")
    counts = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    blocks = {i: math.ceil(c / BLOCK) for i, c in counts.items()}
    cut = F.create_map(*[F.lit(x) for i, b in blocks.items() if b > 1 for x in (i, b)]) if max(blocks.values(), default=1) > 1 else None
    n_blocks = F.coalesce(cut[F.col("list")], F.lit(1)) if cut is not None else F.lit(1)
    posted = posted.select("list", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v", "least")
    queries = materialize(asking.select("v").distinct().join(points.select("v", "id"), "v"), "ann-queries")
    # a point stands in at most ``COPIES`` lists, so these hold more than k points, or there are no more
    shipped_search = spark.sparkContext.broadcast({"graph": graph, "blocks": blocks, "sizes": counts, "need": (k + 1) * COPIES})
    probes = queries.select("id", "v", F.lit(0).cast("bigint").alias("least")).mapInArrow(
        _probe(shipped_search), "list int, block int, kind int, id bigint, v array<double>, least bigint"
    )
    both = posted.union(probes).repartition(n_parts, "list", "block").sortWithinPartitions("list", "block", "kind")
    found = both.mapInArrow(_scan(k + 1), "query bigint, id bigint, least bigint, near double")
    found = found.groupBy("query", "id", "least").agg(F.max("near").alias("near"))  # a point can be in lists of several tasks
    by_query = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "least"))
    found = found.withColumn("place", by_query).filter(F.col("place") <= k + 1)
    found = found.join(points.select("id", "members", F.col("v").alias("w")), "id").join(queries.select(F.col("id").alias("query"), "v"), "query")
    # products of matrices round differently from block to block; the score is summed anew, in order
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    close = found.select("query", "v", "members", score.alias("score")).groupBy("query").agg(
        F.first("v").alias("v"), F.collect_list(F.struct("score", "members")).alias("close")
    )  # at most k + 1 points
    each = asking.join(close, "v").select(F.col("vec_id").alias("query_id"), F.explode("close").alias("c"))
    each = each.select("query_id", F.col("c.score").alias("score"), F.explode("c.members").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The contract of query 9 over any table like embeddings."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
