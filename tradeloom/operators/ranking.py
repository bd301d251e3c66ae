"""Exact quantiles, ranks and row numbers that never gather a large group in one task.

``Window.orderBy`` without a partition, or with a key that holds a large part of the data,
sorts that data in one task, and ``percentile`` keeps all distinct values of a group in one
buffer. Here values are counted first (shuffled on key *and* value). For ranks the counts are cut into
ranges by an approximate quantile sketch over all of them, so a task sorts what one group has in
one range, at most about one part in ``RANGES`` of all counts. The counts in front of each range come
from a histogram with a row for each group and range. The sketch decides only how evenly the work
spreads: ranks and quantiles are exact. There is one way for every size, it is lazy, and nothing is
written; Spark reuses the exchange of the counts where they are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.common import join_null_safe

#: Halvings that find a value's range, and how many ranges that makes.
STEPS = 9
RANGES = 1 << STEPS


def _with_range(counts: DataFrame, value: str, edges: Column) -> DataFrame:
    """Adds ``__range``, the number of edges below the value, by halving; NULL is in the first range."""
    v = F.col(value).cast("double")
    out = counts.withColumn("__edges", edges).withColumn("__range", F.lit(0))
    for step in reversed(range(STEPS)):
        half, here = 1 << step, F.col("__range")
        out = out.withColumn("__range", here + F.when(F.get("__edges", here + (half - 1)) < v, half).otherwise(0))
    return out.drop("__edges")


def cumulate(counts: DataFrame, keys: list[str], value: str, weights: list[str], tie: str | None = None) -> DataFrame:
    """Add ``before_<w>`` and ``all_<w>``: the weight of smaller values, and of all, in the group.

    ``counts`` has one row per (keys, value, tie). A NULL value is smaller than any other.
    """
    grid = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    edges = counts.agg(F.expr(f"percentile_approx(cast({value} as double), array({grid}), 20000)").alias("e")).scalar()
    order = [value] + ([tie] if tie else [])
    ranged = _with_range(counts, value, edges)

    sums = ranged.groupBy(*keys, "__range").agg(*[F.sum(w).alias(f"__sum_{w}") for w in weights])
    over_ranges = Window.partitionBy(*(keys or [F.lit(0)]))  # at most RANGES rows per group
    earlier = over_ranges.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    histogram = sums.select(
        *keys,
        "__range",
        *[F.coalesce(F.sum(f"__sum_{w}").over(earlier), F.lit(0)).alias(f"__start_{w}") for w in weights],
        *[F.sum(f"__sum_{w}").over(over_ranges).alias(f"all_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"__in_{w}") for w in weights])
    joined = join_null_safe(placed, histogram, [*keys, "__range"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"__start_{w}") + F.col(f"__in_{w}")).alias(f"before_{w}") for w in weights],
        *[F.col(f"all_{w}") for w in weights],
    )


#: Stretches that values between a power of two and the next are counted in.
PER_OCTAVE = 4096
#: Lifts the logarithm of the smallest double above zero; one beyond the largest stretch there is.
LIFT, BEYOND = 1100, 1 << 40


def _stretch(v: Column) -> Column:
    """Number of a value's stretch, which never falls as the value grows; it depends on the value alone."""
    number = F.floor((F.log2(F.abs(v)) + LIFT) * PER_OCTAVE) + 1
    finite = F.when(v > 0, number).when(v < 0, -number).otherwise(F.lit(0))
    return F.when(F.isnan(v), BEYOND + 1).when(v == float("inf"), BEYOND).when(v == float("-inf"), -BEYOND).otherwise(finite).cast("bigint")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles, one column per entry of ``probs``; NULL values do not count.

    Equal values are counted first, which is the one shuffle of all rows. The counts are added up in stretches of fixed
    borders, a grouped sum that Spark combines before the shuffle; running sums over a group's stretches, bounded in
    number whatever the size of the group, tell which of them hold the places asked for. Only values in these are
    sorted, each stretch by itself. NaN is the largest value.
    """
    one = keys or ["__all"]
    rows = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    if not keys:
        rows = rows.withColumn("__all", F.pmod(F.xxhash64(value), F.lit(1)))  # always 0, which the optimizer does not see
    v = F.col(value)
    counts = rows.groupBy(*one, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__stretch", _stretch(v))
    group = Window.partitionBy(*one)
    earlier = group.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*one, "__stretch").agg(F.sum("__n").alias("__here"))
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__here").over(earlier), F.lit(0)), "__size": F.sum("__here").over(group)})

    positions = [F.lit(float(p)) * (F.col("__size") - 1) for p in probs.values()]
    places = [at for position in positions for at in (F.floor(position), F.ceil(position))]
    first, last = F.col("__before"), F.col("__before") + F.col("__here") - 1
    asked = sums.where(F.exists(F.array(*places), lambda at: at.between(first, last))).drop("__here")
    near = join_null_safe(counts, asked, [*one, "__stretch"])
    upto = Window.partitionBy(*one, "__stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("__after")
    near = near.withColumn("__after", F.col("__before") + F.sum("__n").over(upto))
    picks = [F.max(F.when((after - F.col("__n") <= at) & (at < after), v)).alias(f"__p{k}") for k, at in enumerate(places)]
    chosen = near.groupBy(*one).agg(F.max("__size").alias("__size"), *picks)
    out = []
    for i, (name, position) in enumerate(zip(probs, positions)):
        lo, hi = F.col(f"__p{2 * i}"), F.col(f"__p{2 * i + 1}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return chosen.select(*keys, *out)


def average_rank_pct(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of ties divided by the number of rows (ascending)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = cumulate(counts, [], value, ["__n"])
    pct = (F.col("before___n") + (F.col("__n") + 1) / F.lit(2.0)) / F.col("all___n")
    return df.join(ranked.select(F.col(value), pct.alias(name)), value, "left").select(*df.columns, name)


#: Hash letters that split the rows of one value: 16 to this power sub-groups.
TIE_LETTERS = 3


def row_numbers(df: DataFrame, value: str, key: str, name: str, descending: bool = False) -> DataFrame:
    """0-based position by ``value`` (NULL first); ties in the order of the MD5 of ``key``. Adds ``<name>_of``.

    The hash spreads a value shared by many rows evenly over sub-groups.
    """
    order = -F.col(value) if descending else F.col(value)
    hashed = df.withColumn("__v", order).withColumn("__h", F.coalesce(F.md5(F.col(key).cast("binary")), F.lit("")))
    rows = hashed.withColumn("__t", F.substring("__h", 1, TIE_LETTERS))
    counts = rows.groupBy("__v", "__t").agg(F.count(F.lit(1)).alias("__n"))
    starts = cumulate(counts, [], "__v", ["__n"], tie="__t").select("__v", "__t", "before___n", "all___n")
    inside = Window.partitionBy("__v", "__t").orderBy("__h", key)
    placed = rows.withColumn("__in", F.row_number().over(inside))
    return (
        join_null_safe(placed, starts, ["__v", "__t"])
        .withColumn(name, F.col("before___n") + F.col("__in") - 1)
        .withColumn(f"{name}_of", F.col("all___n"))
        .select(*df.columns, name, f"{name}_of")
    )


def equal_size_scores(df: DataFrame, key: str, scores: dict[str, tuple[str, bool]], parts: int = 5) -> DataFrame:
    """``floor(position * parts / n) + 1`` with the 0-based sorted position, for several measures in one pass.

    ``scores`` maps a new column to its measure and whether it is sorted descending; positions are those
    of ``row_numbers``. ``key`` is unique.
    """
    entries = [
        F.struct(F.lit(name).alias("__m"), (F.col(value).cast("double") * (-1 if descending else 1)).alias("__v"))
        for name, (value, descending) in scores.items()
    ]
    long = df.select(key, F.explode(F.array(*entries)).alias("__e")).select(key, "__e.*")
    long = long.withColumn("__h", F.coalesce(F.md5(F.col(key).cast("binary")), F.lit("")))
    long = long.withColumn("__t", F.substring("__h", 1, TIE_LETTERS))
    same = ["__m", "__v", "__t"]
    counts = long.groupBy(*same).agg(F.count(F.lit(1)).alias("__n"))
    starts = cumulate(counts, ["__m"], "__v", ["__n"], tie="__t").select(*same, "before___n", "all___n")
    placed = long.withColumn("__in", F.row_number().over(Window.partitionBy(*same).orderBy("__h", key)))
    placed = join_null_safe(placed, starts, same)
    score = F.expr(f"cast((before___n + __in - 1) * {parts} div all___n + 1 as int)")
    wide = placed.groupBy(key).agg(*[F.max(F.when(F.col("__m") == name, score)).alias(name) for name in scores])
    return join_null_safe(df, wide, [key])


def equal_size_score(df: DataFrame, value: str, key: str, name: str, parts: int = 5, descending: bool = False) -> DataFrame:
    return equal_size_scores(df, key, {name: (value, descending)}, parts)


def with_share(df: DataFrame, value: str, name: str, factor: float = 1.0) -> DataFrame:
    """Value divided by the total over all rows."""
    whole = df.agg(F.sum(F.col(value).cast("decimal(38,6)")).cast("double")).scalar()
    return df.withColumn(name, F.try_divide(F.col(value).cast("double") * factor, whole))
