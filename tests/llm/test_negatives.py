"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from tradeloom.llm import negatives


def expected(rows, every=50, positives=5, count=3):
    """rows: distinct (id, label, integer vector)."""
    out = []
    for a, label, x in rows:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in rows if b != a and len(y) == len(x))
        for s, b, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(t, c) for t, c, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:count]
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(fit)]
    return sorted(out)


def integers(rows):
    out = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if sum((256 * x) ** 2 for x in v) > 2.0**62:
            continue
        out.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    return sorted(out)


SCHEMA = "vec_id bigint, embedding array<float>, label int, uid int, marks string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    centres = rng.standard_normal((6, 12))
    for i in range(700):  # clusters, so that bounds discard rows; coarse values, so that scores tie
        v = np.round(centres[i % 6] + 0.2 * rng.standard_normal(12), 1)
        out.append((i, v.tolist(), int(rng.integers(4)), 1, "x"))
    same = centres[0].round(1).tolist()
    out += [(1000 + 10 * i, same, i % 3, 1, None) for i in range(120)]  # equal vectors, some of them anchors
    out += [out[3], out[50], (5000, [0.0] * 12, 1, 1, "x"), (5050, [], 1, 1, "x"), (5051, [], 1, 1, "x"), (5052, [], 2, 1, "x"), (50, [1.0, 2.0], 1, 1, "x")]
    out += [(5100, [1.0, 2.0], 1, 1, "x"), (5101, [3.0, -1.0], 2, 1, "x"), (5102, [4.0, 2.0], 1, 1, "x")]
    out += [(5150, None, 1, 1, "x"), (5151, [None] + [1.0] * 11, 1, 1, "x"), (5152, [float("inf")] * 12, 1, 1, "x"), (5153, [float("nan")] * 12, 1, 1, "x")]
    out += [(None, same, 1, 1, "x"), (5200, same, None, 1, "x"), (5250, [1e30] * 12, 1, 1, "x"), (-50, same, 1, 1, "x"), (-49, same, 2, 1, "x")]
    out += [(6000, [1e6] * 11 + [1.5], 1, 1, "x"), (6001, [1e6] * 11 + [-3.25], 1, 1, "x"), (6002, [7e5] * 11 + [1.0], 2, 1, "x")]  # sums beyond 2^53
    return out


@pytest.mark.parametrize("group", [1024, 5])
def test_negatives_match_brute_force(spark, rows, group):
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.integers(table), group=group).collect())
    want = expected(integers([r[:3] for r in rows]))
    assert len(want) > 100 and any(r[0] == 6000 for r in want)
    assert got == want


def test_no_rows(spark):
    assert negatives.op13(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.op13(spark, spark.createDataFrame([(50, [1.0], 1, 1, "x")], SCHEMA)).collect() == []


def test_tree_spans_and_equal_anchors_cost_nothing():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(-300, 300, (4, 8)), 5, axis=0)
    tree = negatives.spanning_tree(x.astype(float))
    assert sorted(c for c, _, _ in tree) == list(range(1, 20)) and sum(d == 0 for _, _, d in tree) == 16
    seen = {0}
    for child, parent, distance in tree:
        assert parent in seen and math.isclose(distance, math.dist(x[child], x[parent]), abs_tol=1e-9)
        seen.add(child)
    many = rng.integers(-300, 300, (500, 8))
    window = [(1, 200_000, 260_000)]
    group = negatives._Group(np.arange(20), np.arange(20), np.zeros(20), x, [window] * 20, False, 3)
    group.scan(np.arange(100, 600), np.ones(500), many)
    scores = many @ x.T
    hits = int(((scores >= 200_000) & (scores <= 260_000)).sum())
    assert group.rescored < 500 + 4 * 500 + hits < 20 * 500
    for k in range(20):
        fit = sorted((-s, 100 + i) for i, s in enumerate(scores[:, k].tolist()) if 200_000 <= s <= 260_000)[:3]
        assert [(-s, i) for s, i in zip(group.best[k][0].scores.tolist(), group.best[k][0].ids.tolist())] == fit
