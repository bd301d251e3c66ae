"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tradeloom.llm import variants


def expected(counts, share=10):
    """{word: (form, root, n, n_near, form_n)} by comparing every word with every other one."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= share * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(found[w]), counts.get(form.get(w))) for w, n in counts.items()}


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a" * k for k in range(7, 40)] + ["ab" * 5, "aab" * 3, "abb" * 3, "ÿéàbcdefg", "ÿéàbcdef", "zzzzzzzz", "y" * 3000, "y" * 3001]
    for _ in range(250):  # few letters and shared heads and tails: many near words, equal runs, long shared heads
        words.append("".join(rng.choice("abé") for _ in range(rng.randint(7, 9))))
    counts = {w: rng.choice([2, 2, 2, 30, 30, 400, 5000]) for w in words}
    counts |= {"chain": 9, "chainaaa": 2, "chainaab": 30, "chainabb": 400, "chainbbb": 5000}  # a chain of forms
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    want = expected(counts)
    assert want["chainaaa"][:2] == ("chainaab", "chainbbb")
    assert got(variants.spelling_variants(table)) == want
    assert got(variants.spelling_variants(table.repartition(3).limit(2))).keys() < want.keys()


def test_numbers_of_nodes_are_heads(spark):
    """Equal numbers if and only if equal heads, also over the borders of the ranges."""
    rng = random.Random(5)
    words = sorted({"abcdefgh"[: rng.randint(1, 8)] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(200)})
    ranged = variants._ranged(spark.createDataFrame([(w,) for w in words], "word string"), "test-words").withColumnRenamed("place", "id")
    assert ranged.select("part").distinct().count() > 3
    by_id = {r["id"]: r["word"] for r in ranged.collect()}
    assert [by_id[i] for i in sorted(by_id)] == words
    heads = {}
    for r in variants.trie_nodes(ranged).collect():
        word = by_id[r["id"]]
        assert len(r["nodes"]) == len(word) + 1
        for d, node in enumerate(r["nodes"]):
            assert heads.setdefault(word[:d], node) == node
    assert len(set(heads.values())) == len(heads)


def brute_words(rows):
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                yield run


def test_documents_match_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdeÉñ") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice(["", "s", "×", "-x", "X1"]) for _ in range(400))) for i in range(40)]
    rows += [(i, "Straßenbahn straßenbahn STRASSENBAHN ÄPFELBAUM äpfelbaum") for i in range(50)] + [(None, "kaleidoscope " * 90), (7, None), (7, "")]
    counts = Counter(brute_words(rows))
    want = expected({w: n for w, n in counts.items() if n >= 2})
    assert got(variants.op11(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))) == want
    assert sum(f is not None for f, *_ in want.values()) > 10
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    counts = Counter(brute_words(odd))
    assert got(variants.op11(spark, odd_docs)) == expected({w: n for w, n in counts.items() if n >= 2})
    assert variants.op11(spark, no_docs).collect() == []
