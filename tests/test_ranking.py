"""Exact ranks and quantiles with a third of the rows on one key and value."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import ranking, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = 5.0 if i % 3 == 1 else round(rng.lognormvariate(3, 2), 2)
        rows.append((f"c{i}", group, value))
    return rows, spark.createDataFrame(rows, "k string, g string, v double").cache()


def test_quantiles_by_group(skewed):
    rows, df = skewed
    out = ranking.quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    got = {r["g"]: (r["p10"], r["p50"], r["p99"]) for r in out.collect()}
    assert set(got) == {"hot", "a", "b", None}
    for g, values in got.items():
        want = np.percentile([v for _, x, v in rows if x == g], [10, 50, 99])
        assert values == pytest.approx(tuple(want))


def test_quantiles_of_all_rows(skewed):
    rows, df = skewed
    out = ranking.quantiles(df, [], "v", {"p25": 0.25, "p75": 0.75}).collect()
    assert len(out) == 1
    assert tuple(out[0]) == pytest.approx(tuple(np.percentile([v for *_, v in rows], [25, 75])))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert ranking.quantiles(empty, [], "v", {"p": 0.5}).collect() == []


def test_average_rank_matches_brute_force(skewed):
    rows, df = skewed
    values = [v for *_, v in rows]
    out = {r["k"]: r["p"] for r in ranking.average_rank_pct(df, "v", "p").collect()}
    for k, _, v in rows[:200]:
        smaller, same = sum(x < v for x in values), sum(x == v for x in values)
        assert out[k] == pytest.approx((smaller + (same + 1) / 2) / len(values))


@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_are_a_total_order(skewed, descending):
    import hashlib

    rows, df = skewed
    out = ranking.row_numbers(df, "v", "k", "pos", descending).collect()
    want = sorted(rows, key=lambda r: (-r[2] if descending else r[2], hashlib.md5(r[0].encode()).hexdigest()))
    assert [r["k"] for r in sorted(out, key=lambda r: r["pos"])] == [r[0] for r in want]


@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_keep_missing_values_first(spark, descending):
    data = [("a", 2.0), ("b", None), ("c", 1.0), ("d", None), ("e", 2.0), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    out = ranking.row_numbers(df, "v", "k", "pos", descending).collect()
    assert sorted(r["pos"] for r in out) == list(range(6)) and {r["pos_of"] for r in out} == {6}
    assert {r["k"] for r in out if r["pos"] < 2} == {"b", "d"}
    values = [r["v"] for r in sorted(out, key=lambda r: r["pos"])][2:]
    assert values == sorted(values, reverse=descending)


def test_one_value_for_all_rows(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(7.0).alias("v"))
    out = ranking.row_numbers(df, "v", "k", "pos").agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()
    assert tuple(out) == (0, 4999, 5000)


def test_building_a_ranking_runs_no_job(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    tracker, group = spark.sparkContext.statusTracker(), "ranking-is-lazy"
    spark.sparkContext.setJobGroup(group, group)
    ranking.row_numbers(df, "v", "k", "pos")
    ranking.quantiles(df, [], "v", {"m": 0.5})
    found = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(found)


def test_equal_size_score_sizes(spark):
    df = spark.range(798).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    scored = ranking.equal_size_score(df, "v", "k", "s")
    sizes = {r["s"]: r["count"] for r in scored.groupBy("s").count().collect()}
    assert [sizes[i] for i in range(1, 6)] == [160, 160, 159, 160, 159]


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, out = sum(y for y, _ in pairs), 0.0
    for s in sorted({p for _, p in pairs}, reverse=True):
        seen = [y for y, p in pairs if p >= s]
        out += sum(y for y, p in pairs if p == s) / total * sum(seen) / len(seen)
    return out


def test_auc_and_average_precision_with_ties(spark):
    rng = random.Random(3)
    pairs = [(int(rng.random() < 0.4), rng.choice([0.1, 0.2, 0.5, 0.5, 0.9])) for _ in range(300)]
    df = spark.createDataFrame([(str(i), y, p) for i, (y, p) in enumerate(pairs)], "k string, y int, p double")
    assert stats.roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(brute_auc(pairs))
    assert stats.average_precision(df, "y", "p").first()["average_precision"] == pytest.approx(brute_ap(pairs))


def test_precision_at_k_skips_too_large_k(spark):
    df = spark.createDataFrame([(str(i), int(i < 4), 1 - i / 10) for i in range(8)], "k string, y int, p double")
    out = {r["k"]: (r["precision"], r["recall"]) for r in stats.precision_recall_at(df, "y", "p", "k", (2, 5, 50)).collect()}
    assert out == {2: (1.0, 0.5), 5: (0.8, 1.0)}


def test_calibration_drops_duplicate_edges(spark):
    scores = [0.0] * 5 + [0.5] * 3 + [1.0] * 2
    df = spark.createDataFrame([(1, s) for s in scores], "y int, p double")
    out = stats.decile_calibration(df, "y", "p").orderBy("decile").collect()
    assert sum(r["n"] for r in out) == 10
    assert [r["mean_score"] for r in out] == [0.0, 0.5, 1.0]


def test_pareto_keeps_ties_at_the_border(spark):
    from tradeloom.operators.views import pareto_top_share

    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([100.0, 50.0, 50.0, 10.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0])], "k string, m double")
    row = pareto_top_share(df, "m").first()
    assert (row["top_customers"], row["top_revenue"]) == (3, 200.0)


@pytest.mark.parametrize("stretches", [4096, 16, 1])
def test_stretches_change_no_quantile(skewed, monkeypatch, stretches):
    """Many values or few in a stretch, and all of them."""
    monkeypatch.setattr(ranking, "PER_OCTAVE", stretches)
    rows, df = skewed
    probs = {f"p{i}": i / 10 for i in range(11)} | {"p999": 0.999}
    for keys in (["g"], []):
        got = {r["g"] if keys else 0: tuple(r[p] for p in probs) for r in ranking.quantiles(df, keys, "v", probs).collect()}
        assert len(got) == (4 if keys else 1)
        for g, values in got.items():
            mine = sorted(v for _, x, v in rows if not keys or x == g)
            want = []
            for p in probs.values():
                at = p * (len(mine) - 1)
                lo, hi = mine[math.floor(at)], mine[math.ceil(at)]
                want.append(lo + (hi - lo) * (at - math.floor(at)))
            assert values == tuple(want)


def test_tied_fractions_stay_what_they_are(spark):
    """An edge between equal values is that value to the last bit, so no row changes its bin."""
    value = 0.1 + 0.2
    df = spark.createDataFrame([(i, value if 40 < i < 160 else i / 300) for i in range(200)], "k int, v double")
    probs = {f"e{i}": i / 37 for i in range(38)}
    row = ranking.quantiles(df, [], "v", probs).first()
    assert sum(row[p] == value for p in probs) >= 20
    assert [row[p] for p in probs] == sorted(row[p] for p in probs)


def test_quantiles_of_values_of_any_size(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -inf, -1e308, -5.0, -5.0, -5e-324, 0.0, 0.0, 5e-324, 3.0, 3.0, 3.0000000000000004, 1.7e308, inf, inf, nan, nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probs = {f"p{i}": i / 16 for i in range(17)}
    for stretches in (4096, 1):
        monkeypatch.setattr(ranking, "PER_OCTAVE", stretches)
        row = ranking.quantiles(df, [], "v", probs).first()
        for p, w in zip(probs, values):
            assert row[p] == w or (math.isnan(row[p]) and math.isnan(w))


def test_stretches_never_fall(spark):
    rng = random.Random(1)
    values = sorted({math.ldexp(rng.uniform(-1, 1), rng.randint(-1000, 1000)) for _ in range(3000)} | {1.0, math.nextafter(1, 2), math.nextafter(1, 0), 2.0**-1074, 0.1 + 0.2, 0.3})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    numbers = [r["s"] for r in df.select("v", ranking._stretch(F.col("v")).alias("s")).orderBy("v").collect()]
    assert numbers == sorted(numbers) and len(set(numbers)) > 2500
