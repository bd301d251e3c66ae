"""Mixing sources to target weights by fitting a subset-sum budget.

*Targets.* Sources in code-point order (null last) take weights that repeat. Together they share
``share`` of all words by weight; a source stops at ``cap`` times its own words and what it leaves is
shared again by weight among the others, until none is above its stop.

*Fitting.* In a source every document is first taken as often as the target holds the whole source.
The rest of the budget is met with documents taken once more. They are counted by exact length.
Each length gives its proportional number of documents, rounded down. What remains is walked down
from the longest lengths while it is beyond the reach of the last step, and the last step is a
bounded-knapsack dynamic programme over the documents still free, which meets the budget exactly
where any subset of them does, and otherwise comes as near as it can from below.

*Selecting.* Each length gives the documents that come first in a seeded order. A length shared by
very many documents is cut into ranges of the seeded hash: whole ranges are taken by their counts,
and only in the range at the border are documents ranked, so no group is ever ranked in one task.

Rules: a null text has no words; documents without words are taken once and count nothing; rows that
are equal in every way are interchangeable; reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import WORD, free_name, parts_for
from tradeloom.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Words of a source's budget that the dynamic programme fits; those before are shared out among the lengths in proportion.
REACH = 50_000
#: Documents of one length that may be ranked in one task.
RANGE = 4096
SEED = 42


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``place`` (from 0, by code point, null last) to (source, source_size), one row a source.

    Sources are sorted by range over all tasks; each range counts its rows, and the counts of the
    ranges before it shift its own numbers.
    """
    n = parts_for(sizes)
    dealt = sizes.repartitionByRange(n, F.col("source").isNull(), F.col("source"))
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "mix-sources")
    own = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    rows = dealt.withColumn("inside", F.row_number().over(own) - 1)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("source", "source_size", (F.col("before") + F.col("inside")).alias("place"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked_sources(sizes).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    weighed = materialize(weighed.withColumn("most", F.col("source_size") * cap), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    while True:  # each turn settles the sources that the level lifts above their stop
        full = F.col("weight") * F.lit(level) >= F.col("most")
        row = weighed.agg(
            F.sum(F.when(full, F.col("most"))).alias("settled"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        higher = (budget - (row["settled"] or 0)) / row["open"] if row["open"] else level
        if not row["open"] or higher <= level:
            break
        level = higher
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level)))
    if not row["open"]:
        target = F.col("most").cast("double")
    return weighed.select("source", "source_size", target.alias("target"))


def fit(lengths: list[int], counts: list[int], budget: int, whole: int, reach: int = REACH) -> list[int]:
    """How many documents of each length to take so that their words come to ``budget``.

    ``whole`` is all words of these documents. Every length gives its share, rounded down; the rest is met exactly, or as
    nearly as the remaining documents allow. Of a rest beyond ``reach`` words, what lies before goes to the lengths that
    rounding cost most, one document each, so that the lengths stay in proportion whatever the size of a source.
    Never more than ``counts``; the sum never exceeds the budget.
    """
    budget = max(0, min(budget, whole))
    take = [c * budget // whole if whole else 0 for c in counts]
    left = budget - sum(t * n for t, n in zip(take, lengths))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    spread = sorted(order, key=lambda i: (-(counts[i] * budget % whole), lengths[i] * 0x9E3779B1 % (1 << 32))) if left > reach else []
    for i in spread:  # equal losses in an order that favours neither short nor long ones
        if left <= reach:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    items: list[tuple[int, int]] = []  # (length index, documents at once): binary parts of each count
    for i in order:
        free, part = min(counts[i] - take[i], left // lengths[i]), 1
        while free > 0:
            part = min(part, free)
            items.append((i, part))
            free -= part
            part *= 2
    reached, mask, first = 1, (1 << (left + 1)) - 1, {}
    for k, (i, part) in enumerate(items):  # bit s: the sum s can be met; first[s]: the item that first met it
        new = (reached << (lengths[i] * part)) & mask & ~reached
        reached |= new
        while new:
            low = new & -new
            first[low.bit_length() - 1] = k
            new ^= low
        if reached >> left & 1:
            break
    at = reached.bit_length() - 1
    while at:
        i, part = items[first[at]]
        take[i] += part
        at -= lengths[i] * part
    return take


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """Per length of one source: base copies of every document and how many get one more."""
    out = group[["source_key", "size"]].copy()
    target, whole = int(group["target"].iloc[0]), int((group["size"] * group["n"]).sum())
    base = target // whole if whole else 0
    out["base"] = base
    out["more"] = fit(group["size"].tolist(), group["n"].tolist(), target - base * whole, whole)
    return out[["source_key", "size", "base", "more"]]


def copies(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(size, source, order columns..., source_size, target, copies) for ``docs`` with ``size`` and ``source``.

    ``docs`` must carry ``size``, ``source`` and ``draw`` (a seeded long); other columns stay.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    docs = docs.withColumn("source_key", key)
    targets = targets.withColumn("source_key", key).drop("source")
    lengths = materialize(docs.filter("size > 0").groupBy("source_key", "size").agg(F.count("*").alias("n")), "mix-lengths")
    # one row for each length that occurs in a source, at most the square root of twice its words
    plans = lengths.join(targets.select("source_key", "target"), "source_key")
    plans = plans.groupBy("source_key").applyInPandas(_plan, "source_key string, size long, base long, more long")
    plans = plans.join(lengths, ["source_key", "size"])
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE)).cast("long")
    plans = materialize(plans.withColumn("ranges", ranges), "mix-plans")
    rows = docs.join(plans, ["source_key", "size"], "left").join(targets, "source_key")
    group, partial = ["source_key", "size"], F.col("more").between(1, F.col("n") - 1)
    rows = rows.withColumn("range", F.when(partial, F.pmod(F.shiftrightunsigned("draw", 20), F.col("ranges"))))
    # ranges are counted only where a length is given in part
    held = rows.filter(partial).groupBy(*group, "range").agg(F.count("*").alias("here"), F.first("more").alias("want"))
    before = F.sum("here").over(Window.partitionBy(*group).orderBy("range")) - F.col("here")
    held = held.select(*group, "range", F.greatest(F.lit(0), F.col("want") - before).alias("wanted"))
    rows = rows.join(held, [*group, "range"], "left")
    place = F.row_number().over(Window.partitionBy(*group, "range", "salt").orderBy("draw"))
    # rows that need no ranking are spread by their draw, so that no length gathers in one task
    rows = rows.withColumn("salt", F.when(partial, F.lit(-1)).otherwise(F.pmod(F.col("draw"), F.lit(4096))))
    more = F.when(F.col("more") >= F.col("n"), 1).when(partial & (place <= F.col("wanted")), 1).otherwise(0)
    taken = F.when(F.col("size") == 0, 1).otherwise(F.col("base") + more).cast("int")
    return rows.withColumn("copies", taken).drop("source_key", "base", "more", "n", "ranges", "range", "wanted", "salt")


def draw(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns])


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract of query 2 over any table with doc_id, text and source."""
    slim = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), draw(SEED, "doc_id", "text").alias("draw"))
    slim = materialize(slim, "mix-sizes")
    out = copies(slim)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, columns as they were."""
    kept = docs.columns
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    uid = "row_uid"
    rows = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in kept]).withColumn(uid, F.monotonically_increasing_id())
    rows = materialize(rows, "mix-rows")
    t = F.col(names[text])
    slim = rows.select(uid, F.col(names[source]).alias("source"), words_of(t).alias("size"), draw(seed, *names.values()).alias("draw"))
    taken = copies(materialize(slim, "mix-sizes")).select(uid, "copies")
    out = rows.join(taken.filter("copies > 0"), uid)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(names[c]).alias(c) for c in kept])
