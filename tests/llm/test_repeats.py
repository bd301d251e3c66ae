"""Repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tradeloom.llm import repeats


def expected(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        spans, k = [], 0
        while k < len(w):
            e = k
            while e < len(w) and gone[e]:
                e += 1
            spans += [(k, e - 1)] if e > k else []
            k = max(e, k + 1)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), tuple(spans)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r[1], r[2], r[3], tuple(tuple(s) for s in r[4])) for r in df.collect()), key=repr)


def texts(seed):
    rng = random.Random(seed)
    shared = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(10, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 6)):
            part = list(rng.choice(shared)) if rng.random() < 0.5 else [f"u{rng.randrange(100_000)}" for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "edit"
            words += part[rng.randint(0, 3) :]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(900 + k, "again and " * 40 + f"end{k}") for k in range(4)] + [(950, "same " * 90), (951, "same " * 12), (952, "same " * 13)]
    rows += [(960 + k, rows[3][1]) for k in range(5)] + [(960, rows[3][1])] + [(970, "no-break space   wide"), (971, None), (972, ""), (973, " \n\v\f ")]
    rows += [(980 + k, "a header that a good many texts begin with word for word " + " ".join(f"{k}x{j}" for j in range(40))) for k in range(60)]
    return rows


@pytest.mark.parametrize("window, prefix, group, often", [(12, 5, 1 << 18, 64), (12, 5, 8, 4), (12, 11, 8, 2), (35, 16, 1 << 18, 64), (13, 1, 4, 2)])
def test_passages_match_brute_force(spark, window, prefix, group, often):
    rows = texts(window + prefix)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = expected(rows, window)
    assert any(0 < r[2] < r[1] for r in want)
    assert got(repeats.repeated_passages(table.repartition(5), window=window, prefix=prefix, group=group, often=often)) == want


def test_whole_table_and_odd_rows(spark, folder, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(repeats.repeated_passages(odd_docs)) == expected(rows, 35)
    assert repeats.op12(spark, no_docs).collect() == []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = [r[:4] for r in expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 35)]
    assert sorted((tuple(r) for r in repeats.op12(spark, docs).collect()), key=repr) == want


def test_sequences_and_smallest_places():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    words[100:150] = words[20:70]
    for length in (1, 2, 7, 16, 35):
        h = repeats.sequences(words, length)
        assert len(h) == 200 - length + 1 and (h[20] == h[100]) and len(np.unique(h)) == len(h) - (51 - length)
        v = rng.integers(0, 9, 50).astype(np.uint64)
        assert repeats.first_smallest(v, length).tolist() == [i + int(v[i : i + length].argmin()) for i in range(50 - length + 1)]
    assert len(repeats.sequences(words[:3], 4)) == 0 and len(repeats.first_smallest(words[:3], 4)) == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 10)
    text = b"  one two\tthree four" + b"x" * 50 + b"\n five \x0b six  "
    assert [w for part in repeats.words_of(text) for w in part] == text.split()


def test_texts_are_moved_once(spark, folder):
    """Joins on the bucketed texts move lists of places, never the texts."""
    plan = repeats.op12(spark, spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    at = next(i for i, line in enumerate(plan.splitlines()) if "text#" in line and "Scan parquet" in line)
    below = [line for line in plan.splitlines()[max(0, at - 6) : at]]
    assert moved and "Bucketed: true" in plan and not any("Exchange" in line for line in below)
