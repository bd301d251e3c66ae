"""Kept-up totals, rolled-up sets, tables laid out by a key."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tradeloom.operators import rollups
from tradeloom.sources import versions

LINES = "order_id bigint, line_total decimal(15,2), quantity decimal(10,2)"


def stored(spark, path):
    return {r["order_id"]: (r["amount"], r["quantity"], r["line_count"]) for r in versions.read(spark, path).collect()}


def brute(lines):
    out = defaultdict(lambda: [Decimal(0), Decimal(0), 0])
    for order, amount, quantity in lines:
        out[order][0] += amount or 0
        out[order][1] += quantity or 0
        out[order][2] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 64])
def test_changes_add_up_to_the_recomputed_totals(spark, tmp_path, parts):
    rng, path = random.Random(3), str(tmp_path / "totals")
    line = lambda: (rng.choice([1, 1, 1, rng.randrange(40), None]), Decimal(rng.randrange(-500, 5000)).scaleb(-2) if rng.random() > 0.1 else None, Decimal(rng.randrange(900)).scaleb(-2))
    lines = [line() for _ in range(300)]
    rollups.start_order_totals(spark.createDataFrame(lines, LINES), path, parts)
    assert stored(spark, path) == brute(lines)
    for _ in range(4):
        gone = [lines.pop(rng.randrange(len(lines))) for _ in range(60)]
        new = [line() for _ in range(25)]
        lines += new
        changes = [(*x, -1) for x in gone] + [(*x, 1) for x in new]
        rollups.change_order_totals(spark.createDataFrame(changes, LINES + ", sign int"), path, parts)
        assert stored(spark, path) == brute(lines)
    orders = spark.createDataFrame([(i,) for i in range(45)], "order_id bigint")
    totals = {r["order_id"]: r for r in rollups.order_totals(spark, orders, path).collect()}
    want = brute(lines)
    assert len(totals) == 45
    for i, r in totals.items():
        assert (r["total_amount"], r["line_count"]) == (float(want[i][0]) if i in want else 0.0, want[i][2] if i in want else 0)


def test_untouched_parts_are_not_written(spark, tmp_path):
    path = str(tmp_path / "totals")
    lines = spark.range(200).selectExpr("id AS order_id", "cast(1 as decimal(15,2)) AS line_total", "cast(1 as decimal(10,2)) AS quantity")
    rollups.start_order_totals(lines, path)
    rollups.change_order_totals(lines.where("order_id = 7").withColumn("sign", F.lit(1)), path)
    folders = versions._state(spark, path, 2)["parts"]
    assert len(folders) > 20 and sum(c == folders[-1][0] for c, _ in folders) == 1
    assert stored(spark, path)[7][2] == 2


def test_sets_roll_up_to_distinct_counts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(4), rng.choice([None, *range(70_000)]) if rng.random() < 0.5 else rng.randrange(30)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "y int, m int, who int")
    ids = rollups.dictionary(df, "who")
    numbers = sorted(r["id"] for r in ids.collect())
    assert numbers == list(range(len({w for *_, w in rows if w is not None})))
    sets = rollups.distinct_sets(df, ["y", "m"], "who", ids)
    got = {(r["grain"], r["y"], r["m"]): r["n"] for r in rollups.sizes_by_grain(sets, {"m": ["y", "m"], "y": ["y"]}, ["y", "m"], "n").collect()}
    want = defaultdict(set)
    for y, m, w in rows:
        if w is not None:
            want["m", y, m].add(w)
            want["y", y, None].add(w)
    assert got == {k: len(v) for k, v in want.items()}


def test_tables_laid_out_by_order_move_no_rows(spark, folder):
    plan = entry.queries()["order_mix"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "HashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
