"""Hard negatives by spanning-tree bounds among the anchors.

A row's score is its integer inner product with an anchor. Anchors that lie close together score
alike: with ``d`` the distance of an anchor from its parent in a spanning tree, and ``|c|`` the norm
of a row, the row's score at the anchor lies within ``d * |c|`` of its score at the parent. So a task
scores all its rows at the tree's root, carries the bounds from parent to child, and rescores only
the rows whose bounds meet a window of the child: for positives the scores that would enter the
anchor's best rows, for negatives the shares of its positives' scores that a hard negative may have,
down to the worst score that would still be returned. Rescored rows have exact bounds for the
anchors below. No pair is left unscored unless its bounds prove that it cannot be in the result.

*Blocks.* Anchors are a stated set of queries against all rows. They are sorted by random hyperplanes
and cut into groups of about ``GROUP``, in which a smallest spanning tree is grown; equal anchors stand in
one group, unless there are too many, and cost nothing below the first. Rows are cut into chunks by a
hash. Every pair of a group and a chunk is a task that holds the group, streams the rows, and
returns no more than the best few of each anchor; the best of all chunks are then ranked.

Rules: rows with a null id, label or vector, a component that is null or not finite, or an integer
norm whose square exceeds a long (so that scores could) take no part; rows of another dimension than
the anchor's are no candidates for it; rows repeated in full count once; rows with the anchor's id
are not its "other" rows; an anchor without positives, or whose windows hold no row, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, parts_for
from tradeloom.llm.vectors import matrix, runs
from tradeloom.storage import materialize

GROUP = 1024
CHUNK = 50 * GROUP
#: Rows scored at once in a task; also the least rows of a chunk.
ROWS = 2048
PLANES = 24
SEED = 42

SCALE, EVERY, SHIFT, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95


def spanning_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, distance) of a smallest spanning tree, parents first; the root, 0, is left out."""
    near, parent = np.full(len(x), np.inf), np.zeros(len(x), int)
    left, at, out = np.arange(1, len(x)), 0, []
    while len(left):
        d = np.sqrt(((x[left] - x[at]) ** 2).sum(axis=1))
        closer = d < near[left]
        near[left[closer]], parent[left[closer]] = d[closer], at
        k = int(near[left].argmin())
        at = int(left[k])
        left = np.delete(left, k)
        out.append((at, int(parent[at]), float(near[at])))
    return out


class _Best:
    """The first ``size`` of a set by score, ties by the smaller id."""

    def __init__(self, size: int):
        self.size, self.scores, self.ids = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def worst(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.size else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[first], ids[first]


class _Group:
    """Anchors of one task with their tree and what each has found.

    ``wanted[k]`` lists the windows of anchor k as (mark, least score, largest score)."""

    def __init__(self, uids, ids, labels, x: np.ndarray, wanted, same: bool, size: int):
        self.uids, self.ids, self.labels, self.x, self.wanted, self.same = uids, ids, labels, x, wanted, same
        self.floats = x.astype(float)
        self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.tree = [(0, -1, 0.0), *spanning_tree(self.floats)]
        self.best = [[_Best(size) for _ in w] for w in wanted]
        self.rescored = 0

    def scan(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        floats = x.astype(float)
        norms = np.sqrt((floats**2).sum(axis=1))
        exact = norms.max(initial=0) * self.norms.max(initial=0) < 2.0**53  # then sums of doubles are the integers

        def score(k: int, rows: np.ndarray) -> np.ndarray:
            return (floats[rows] @ self.floats[k]).astype(np.int64) if exact else x[rows] @ self.x[k]  # a long that fits survives overflow on the way

        lo, hi = np.empty((len(self.x), len(x))), np.empty((len(self.x), len(x)))
        for k, parent, distance in self.tree:
            able = ((labels == self.labels[k]) == self.same) & (ids != self.ids[k])
            if parent < 0:
                rows = np.arange(len(x))
            else:
                reach = distance * norms * (1 + 1e-9) + 1e-12 * self.norms[k] * norms + 1e-3
                np.subtract(lo[parent], reach, out=lo[k])
                np.add(hi[parent], reach, out=hi[k])
                meets = np.zeros(len(x), bool)
                for (_, least, most), best in zip(self.wanted[k], self.best[k]):
                    meets |= (hi[k] >= max(least, best.worst)) & (lo[k] <= most)
                rows = np.flatnonzero(meets & able)
            if not len(rows):
                continue
            s = score(k, rows)
            lo[k][rows] = hi[k][rows] = s
            self.rescored += len(rows)
            for (_, least, most), best in zip(self.wanted[k], self.best[k]):
                fit = (s >= least) & (s <= most) & (s >= best.worst) & able[rows]
                if fit.any():
                    best.add(s[fit], ids[rows[fit]])

    def found(self) -> pa.RecordBatch:
        out = [(int(u), m, int(i), int(s)) for u, w, bs in zip(self.uids, self.wanted, self.best) for (m, _, _), b in zip(w, bs) for i, s in zip(b.ids, b.scores)]
        columns = [np.array(c, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "mark", "vec_id", "score"])


def _best_of(size: int, same: bool, low: int, high: int):
    """Reads (size, group, chunk, kind, uid, vec_id, label, marks, v) sorted by the first four; kind 0 are anchors, 1 rows."""

    def wanted(marks) -> list[tuple[int, float, float]]:
        if marks is None:
            return [(0, -math.inf, math.inf)]
        spans = [(m, -(-low * m // 100), high * m // 100) for m in sorted(set(marks))]
        return [s for s in spans if s[1] <= s[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, group = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
            for s, e in zip(*runs(keys)):
                part = batch.slice(s, e - s)
                task, kind = tuple(keys[s, :3]), keys[s, 3]
                if task != now:
                    if group is not None:
                        yield group.found()
                    now, anchors, group = task, [], None
                if kind == 0:
                    anchors.append(part)
                    continue
                if group is None:
                    if not anchors:
                        continue
                    table = pa.Table.from_batches(anchors).combine_chunks()
                    spans = [wanted(m) for m in table.column(7).to_pylist()]
                    group = _Group(*(table.column(k).to_numpy() for k in (4, 5, 6)), _vectors(table.column(8).chunk(0)), spans, same, size)
                for at in range(0, part.num_rows, ROWS):
                    rows = part.slice(at, ROWS)
                    group.scan(rows.column(5).to_numpy(), rows.column(6).to_numpy(), _vectors(rows.column(8)))
        if group is not None:
            yield group.found()

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    return matrix(column).astype(np.int64)


def _grouped(anchors: DataFrame, group: int, seed: int) -> DataFrame:
    """Adds ``group``: anchors sorted by random hyperplane signs, cut where a group is full; long runs of equal signs by a hash."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                planes = np.random.default_rng([seed, size]).standard_normal((size, PLANES))
                bits = (_vectors(rows.column(2)).astype(float) @ planes > 0) @ (1 << np.arange(PLANES, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bits)], names=["uid", "bits"])

    bits = materialize(anchors.select("uid", "size", "v").mapInArrow(sides, "uid bigint, bits bigint"), "negatives-bits")
    n = math.ceil(bits.count() / group)
    cuts = [F.lit(0)]
    if n > 1:  # one number for each group
        found = bits.agg(F.percentile_approx("bits", [i / n for i in range(1, n)], 20 * n)).first()[0]
        cuts = [F.lit(c) for c in sorted(set(found))]
    place = F.aggregate(F.array(*cuts), F.lit(0), lambda a, c: a + (F.col("bits") > c).cast("int"))
    dealt = anchors.join(bits.select("uid", place.alias("range")), "uid")
    many = dealt.groupBy("size", "range").agg(F.ceil(F.count("*") / group).alias("cuts"))  # no more rows than groups and dimensions
    dealt = dealt.join(many, ["size", "range"])
    return dealt.withColumn("group", F.xxhash64("range", F.pmod(F.xxhash64("uid"), "cuts"))).drop("range", "cuts")


def _search(rows: DataFrame, anchors: DataFrame, n: int, size: int, same: bool) -> DataFrame:
    """(uid, mark, vec_id, score): the first ``size`` rows of each anchor and mark; anchors: (uid, vec_id, label, size, group, v, marks)."""
    n_parts = parts_for(rows)
    n_chunks = max(math.ceil(n / CHUNK), min(n_parts, math.ceil(n / ROWS)), 1)
    groups = anchors.select("size", "group").distinct()
    none = F.lit(None).cast("array<bigint>")
    chunk = F.pmod(F.xxhash64("uid", F.lit("chunk")), F.lit(n_chunks)).cast("int")
    columns = ["size", "group", "chunk", "kind", "uid", "vec_id", "label", "marks", "v"]
    asked = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).withColumn("kind", F.lit(0))
    told = rows.join(groups, "size").withColumn("chunk", chunk).withColumn("kind", F.lit(1)).withColumn("marks", none)
    dealt = asked.select(*columns).union(told.select(*columns)).repartition(n_parts, "size", "group", "chunk")
    found = dealt.sortWithinPartitions("size", "group", "chunk", "kind").mapInArrow(
        _best_of(size, same, LOW, HIGH), "uid bigint, mark bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("uid", "mark").orderBy(F.desc("score"), "vec_id")  # at most ``size`` rows from each chunk
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(
    df: DataFrame, ids: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES,
    negatives: int = NEGATIVES, group: int = GROUP, seed: int = SEED,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); vectors hold integers that fit a long."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{ids}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = rows.filter("vec_id is not null").distinct()
    rows = rows.withColumn("size", F.size("v")).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "negatives-rows")
    anchors = materialize(_grouped(rows.filter(F.col("vec_id") % every == 0), group, seed), "negatives-anchors")
    n = rows.count()
    columns = ["uid", "vec_id", "label", "size", "group", "v"]
    none = F.lit(None).cast("array<bigint>")
    near = materialize(_search(rows, anchors.select(*columns, none.alias("marks")), n, positives, True), "negatives-positives")
    marks = near.groupBy("uid").agg(F.collect_set("score").alias("marks"))  # at most ``positives``
    far = _search(rows, anchors.join(marks, "uid").select(*columns, "marks"), n, negatives, False)
    pairs = near.select("uid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.select("uid", F.col("mark").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(far, ["uid", "positive_score"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def integers(df: DataFrame, scale: int = SCALE, shift: int = SHIFT, labels: int = LABELS) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, components as floor(scale * x), each ``shift``-th label moved on by one."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    long = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1)) < 2.0**62
    moved = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.filter(long).select("vec_id", moved.alias("label"), F.transform("v", lambda x: F.floor(x)).alias("embedding"))


def op13(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The contract of query 13 over any table like embeddings."""
    return hard_negatives(integers(vectors))
