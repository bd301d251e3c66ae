"""Operators on documents against brute-force versions, and on odd inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import as_rows
from tradeloom.llm import bpe, licenses, mixing, quality, simhash, toxicity

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


# SimHash ---------------------------------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(points, links):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in points}


def test_fingerprints(spark, odd_docs):
    got = as_rows(simhash.op1(spark, odd_docs))
    texts = collections.defaultdict(set)
    for r in odd_docs.collect():
        texts[r["doc_id"]].add(f"{brute_fingerprint(r['text']):016x}")
    assert len(got) == odd_docs.count()
    assert all(r["fingerprint"] in texts[r["doc_id"]] for r in got)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[6] == 3 and by_id[None] is None


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_match_brute_force_with_hot_routes(spark, chunk):
    """A dense group, chains at the border of 4 bits, and strangers; also with routes cut into chunks."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    points = {0, centre, (1 << 64) - 1}
    for _ in range(150):
        p = centre
        for b in rng.sample(range(64), rng.randint(1, 6)):
            p ^= 1 << b
        points.add(p)
    chain = rng.getrandbits(64)
    for i in range(12):
        points.add(chain)
        for b in rng.sample(range(64), rng.choice([4, 4, 5])):
            chain ^= 1 << b
    points |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    mine = sorted(signed(p) for p in points)
    links = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = brute_components(mine, links)
    df = spark.createDataFrame([(p,) for p in mine], "fp bigint")
    got = {r["node"]: r["root"] for r in simhash.link_points(df, chunk=chunk).collect()}
    assert {p: got.get(p, p) for p in mine} == want


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 5, 7, 8, None], key=str)
    assert simhash.keep_one(no_docs).count() == 0 and simhash.op1(spark, no_docs).count() == 0


# Mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, done, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (budget - sum(done.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in open_}
        for s in over:
            done[s] = 2.0 * sizes[s]
            open_.discard(s)
    return done


def check_mix(spark, docs):
    got = as_rows(mixing.op2(spark, docs))
    source = collections.defaultdict(int)
    for r in docs.collect():
        source[r["source"]] += len(words_of(r["text"]))
    want = brute_targets(source)
    assert len(got) == docs.count()
    by_target = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert by_target == {(source[s], round(want[s], 6)) for s in source}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    return got, want


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    check_mix(spark, odd_docs)
    assert mixing.op2(spark, no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns


def test_mix_comes_near_targets_with_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 16)
    rng = random.Random(3)
    rows = [(i, "w " * (7 if i % 3 == 0 else rng.randint(1, 60)), "s%d" % (0 if i % 3 else rng.randint(0, 4))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got, want = check_mix(spark, docs)
    by_id, taken = {i: s for i, _, s in rows}, collections.Counter()
    for r in got:
        taken[by_id[r["doc_id"]]] += r["taken"]
    for s, t in want.items():
        assert 0 <= t - taken[s] < 1, (s, t, taken[s])
    again = as_rows(mixing.op2(spark, docs.repartition(3)))
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs).count() == sum(r["taken"] // r["size"] for r in got)


def test_fit_meets_reachable_budgets():
    rng = random.Random(1)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 6)))
        counts = [rng.randint(1, 5) for _ in lengths]
        whole = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, whole)
        for reach in (50, 10**6):
            take = mixing.fit(lengths, counts, budget, whole, reach=reach)
            met = sum(a * b for a, b in zip(lengths, take))
            assert all(0 <= t <= c for t, c in zip(take, counts)) and met <= budget
            if lengths[0] == 1 and counts[0] >= 3:
                assert budget - met < max(lengths)
        # after each length's share, the best sum of all choices of the rest
        base = [c * budget // whole for c in counts]
        sums = {sum(a * b for a, b in zip(lengths, base))}
        for size, n in zip(lengths, [c - t for c, t in zip(counts, base)]):
            sums = {x + size * k for x in sums for k in range(n + 1)}
        assert met == max(x for x in sums if x <= budget)


def test_long_rests_stay_in_proportion():
    """A rest far beyond the reach of the programme favours no length and is met to the word."""
    lengths = list(range(1, 4001))
    counts = [3] * len(lengths)
    whole = 3 * sum(lengths)
    for budget in (whole // 2 + 7, whole // 3 + 1, whole * 9 // 10):
        take = mixing.fit(lengths, counts, budget, whole, reach=500)
        assert sum(a * b for a, b in zip(lengths, take)) == budget
        short, long = sum(take[:2000]) / 6000, sum(take[2000:]) / 6000
        assert abs(short - long) < 0.35 and max(take) - min(take) <= 2


# Quality ---------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/../sf0.01/documents.parquet"), spark.read.parquet(f"{folder}/../sf0.01/labels.parquet")
    train, test = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    rows = quality.op3(spark, docs, train).join(test, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_shrinks_sparse_sites(spark):
    rows = [("h1", "p", 0.9)] * 200 + [("h2", "p", 0.1)] * 200 + [("h3", "p", 0.9)]
    sites = {r["host"]: r for r in quality.site_table(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    df = spark.createDataFrame([("h1", "p", 0.0), ("h2", "p", 0.0), ("h3", "p", 0.0)], "host string, path string, l double")
    got = {r["host"]: r for r in quality.posterior(df, quality.site_table(spark.createDataFrame(rows, "host string, path string, p double"))).collect()}
    mean = sites["h1"]["mean"]
    assert got["h1"]["host_posterior"] > 0.8 and got["h2"]["host_posterior"] < 0.2
    assert abs(got["h3"]["host_posterior"] - mean) < abs(got["h1"]["host_posterior"] - mean)


def test_posteriors_match_brute_force(spark):
    """Moments, strengths and shrunk means per host and per path within it, single and tied ones included."""
    rng = random.Random(6)
    rows = [(f"h{rng.randrange(5)}", f"p{rng.randrange(3)}", rng.choice([-3.0, -1.0, 0.0, 0.5, 2.0])) for _ in range(200)]
    rows += [("one", "p0", 4.0), ("tie", "p0", -5.0), ("tie", "p0", 5.0)]
    chance = lambda l: 1 / (1 + np.exp(-l))
    p = [chance(l) for *_, l in rows]
    table = spark.createDataFrame([(h, q, float(x)) for (h, q, _), x in zip(rows, p)], "host string, path string, p double")
    sites = quality.site_table(table)
    got = quality.posterior(spark.createDataFrame(rows, "host string, path string, l double"), sites).collect()
    n, mean = len(rows), float(np.mean(p))
    of = lambda *key: [x for r, x in zip(rows, p) if r[: len(key)] == key]
    hosts, paths = {r[:1] for r in rows}, {r[:2] for r in rows}

    def strength(squares, groups):
        noise = mean * (1 - mean)
        return min(max(noise / max((squares - noise * groups) / n, noise * 1e-4, 1e-9) - 1, 2.0), 1e4)

    a = strength(sum(len(of(*k)) * (np.mean(of(*k)) - mean) ** 2 for k in hosts), len(hosts))
    b = strength(sum(len(of(*k)) * (np.mean(of(*k)) - np.mean(of(k[0]))) ** 2 for k in paths), len(paths))
    clip, logit = (lambda x: min(max(x, 1e-6), 1 - 1e-6)), (lambda x: np.log(x / (1 - x)))
    want = []
    for host, path, l in rows:  # each row is left out of its own sites
        mine = chance(l)
        of_host = clip((a * mean + sum(of(host)) - mine) / (a + len(of(host)) - 1))
        of_path = clip((b * of_host + sum(of(host, path)) - mine) / (b + len(of(host, path)) - 1))
        shift = np.clip(logit(of_path) - logit(clip(mean)), -quality.MOST_SHIFT, quality.MOST_SHIFT)
        want.append((host, path, l, of_host, of_path, 1 - chance(l + shift)))
    found = sorted((r["host"], r["path"], r["l"], r["host_posterior"], r["path_posterior"], r["score"]) for r in got)
    for x, y in zip(found, sorted(want), strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:])


def test_quality_of_odd_rows(spark, odd_docs, no_docs, labels):
    got = as_rows(quality.op3(spark, odd_docs, labels))
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.op3(spark, no_docs, labels).count() == 0
    kept = quality.keep_good(odd_docs, labels.filter("false"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


# Toxicity --------------------------------------------------------------------------------------


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar({"idiot": 2.0, "vequ*": 3.0})
    kinds = lambda text: dict(zip(toxicity.KINDS, grammar.totals(text)))
    assert kinds("You IDIOT!!")["targeted"] == 2.0
    assert kinds("The idiot came")["plain"] == 2.0
    assert kinds("He is not an idiot")["negated"] == 2.0
    assert kinds("She said what an idiot")["reported"] == 2.0
    assert kinds("I will kill you")["threat"] == 1.0
    assert kinds("I said so. Idiot")["plain"] == 2.0
    assert kinds("des vequtés")["plain"] == 3.0
    assert kinds('He wrote "Go away. You idiot."')["reported"] == 2.0
    assert kinds('"Go away. Run." The idiot came')["plain"] == 2.0
    assert kinds("«Va. Quel idiot» dehors. Un idiot")["reported"] == 2.0 and kinds("«Va. Quel idiot» dehors. Un idiot")["plain"] == 2.0
    assert kinds('an open " quote\nThe idiot came')["plain"] == 2.0
    assert kinds("to say it, an idiot")["plain"] == 2.0
    assert kinds("isn't he an idiot")["negated"] == 2.0 and kinds("he isn’t an idiot")["negated"] == 2.0
    assert kinds("l'idiot")["plain"] == 2.0 and kinds("don't go there now, idiot")["plain"] == 2.0
    assert sum(grammar.totals("idiots and idioms, revequ, killing")) == 0


def brute_totals(text, stems):
    """The grammar stated once more, token by token and without transducers."""
    sums = dict.fromkeys(toxicity.KINDS, 0.0)
    for line in text.lower().split("\n"):
        is_open = False
        for clause in re.split(r"[.!?;:|]", line):
            tokens = re.findall(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+|[\"“”«»]", clause)
            inside = []
            for t in tokens:
                is_open = (not is_open) if t == '"' else True if t in "“«" else False if t in "”»" else is_open
                inside.append(is_open)
            spoken = [any(t in toxicity.REPORTS and (i == 0 or tokens[i - 1] not in toxicity.INFINITIVES) for i, t in enumerate(tokens[:k])) for k in range(len(tokens))]
            denies = lambda t: t in toxicity.NEGATIONS or t.endswith(("n't", "n’t"))
            for k, t in enumerate(tokens):
                near = tokens[max(0, k - toxicity.REACH) : k]
                if t in stems:
                    if any(denies(x) for x in near):
                        kind = "negated"
                    elif spoken[k] or inside[k]:
                        kind = "reported"
                    else:
                        kind = "targeted" if set(tokens[max(0, k - toxicity.REACH) : k + toxicity.REACH + 1]) & toxicity.TARGETS else "plain"
                    sums[kind] += stems[t]
                elif t in toxicity.THREATS and set(tokens[k + 1 : k + 1 + toxicity.REACH]) & toxicity.TARGETS:
                    sums["threat"] += 1.0
    return [sums[k] for k in toxicity.KINDS]


def test_grammar_matches_brute_force():
    rng, stems = random.Random(12), {"idiot": 2.0, "fool": 1.5}
    grammar = toxicity.Grammar(stems)
    words = ["idiot", "fool", "you", "he", "not", "isn't", "said", "say", "to", "kill", "tree", "house", '"', "“", "”", "«", "»", ".", "!", "\n", "lamp"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
        assert grammar.totals(text)[:-1] == pytest.approx(brute_totals(text, stems)), text


def test_toxicity_on_held_out_rows(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/../sf0.1/documents.parquet"), spark.read.parquet(f"{folder}/../sf0.1/labels.parquet")
    rows = toxicity.op4(spark, docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert np.mean([r["predicted"] for r in toxic]) >= 0.85
    assert np.mean([r["predicted"] for r in clean]) <= 0.02


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, labels):
    for l in (labels, labels.filter("false")):
        got = as_rows(toxicity.op4(spark, odd_docs, l))
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert toxicity.op4(spark, no_docs, labels).count() == 0
    kept = toxicity.keep_clean(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_held_out_rows_teach_nothing(spark, folder):
    """Turning the labels of held-out rows around changes no score."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("toxic", (toxicity.held_out(labels["doc_id"]) != (labels["toxic"] == 1)).cast("int"))
    a, b = (sorted(map(tuple, toxicity.op4(spark, docs, l).collect())) for l in (labels, turned))
    assert a == b


# Licences --------------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_base(spark, folder, odd_docs, no_docs):
    extra = ["MIT License, mit\nlicense", "General Public License general public license mit", "the Apache   License-1", "mitlicense mit licenses", "MIT LICENSE" * 50]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10**6 + i, t) for i, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in licenses.op6(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.op6(spark, odd_docs).count() == odd_docs.count() and licenses.op6(spark, no_docs).count() == 0


def test_a_better_notice_hides_none_beside_it():
    scanner = licenses.Scanner()
    for text, label, want in [
        ("all rights reservd all rights reserved", "proprietary", [(0, 2, 1), (3, 5, 0)]),
        ("all rights reserved all rights reservd x all rights reserved", "proprietary", [(0, 2, 0), (3, 5, 1), (7, 9, 0)]),
        ("releasd under the mit license released under the mit license", "mit", [(0, 4, 1), (5, 9, 0)]),
        ("releasd undr the mit license releasd under the mit license released under the mit license", "mit", [(0, 4, 2), (5, 9, 1), (10, 14, 0)]),
    ]:
        spans = scanner.scan(text.encode())[-1]
        assert [(first, last, edits) for of, first, last, edits, _ in spans if of == label] == want, text
    many = "all rights reservd " * 3000 + "all rights reserved"
    assert [s[3] for s in scanner.scan(many.encode())[-1]] == [1] * 3000 + [0]


def test_licence_notices_bear_edits():
    scanner = licenses.Scanner()
    for text, label, edits in [
        ("Licensed under the Apache License, Version 2.0.", "apache", 0),
        ("x Licenced under the Apache Licence, Version 2.0", "apache", 2),
        ("Permision is hereby granted, free of charge, to any persons obtaining a copy", "mit", 2),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0),
    ]:
        found = [s for s in scanner.scan(text.encode())[-1] if s[0] == label]
        assert [s[3] for s in found] == [edits], (text, found)
    label, first, last, edits, _ = scanner.scan(b"one two All rights reserved three")[-1][0]
    assert (label, first, last, edits) == ("proprietary", 2, 4, 0)
    assert scanner.scan(b"nothing to see here, rights and wrongs")[5] == ""


def edits_between(pattern, text):
    """Fewest edits between a pattern and any start of a text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [row[0] + 1]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def brute_notice(notice, text):
    """Whether a text holds a notice: the words around its name within the bound, the name itself nearly untouched."""
    phrase, _, errors, name = notice
    at = f" {phrase} ".index(f" {name} ") if name else 0
    before, after = phrase[:at], phrase[at + len(name) :]
    free = 1 if len(name) >= licenses.LONG else 0
    for s in range(len(text) + 1):
        for e in range(max(s, s + len(name) - free), min(len(text), s + len(name) + free) + 1):
            if name and ((s and text[s - 1] != " ") or (e < len(text) and text[e] != " ")):
                continue
            own = edits_between(name + "\n", text[s:e] + "\n") if name else 0
            if own <= free and edits_between(before[::-1], text[:s][::-1]) + own + edits_between(after, text[e:]) <= errors:
                return True
    return False


@pytest.mark.parametrize("notice", licenses.NOTICES, ids=lambda n: n[0][:20])
def test_notices_match_brute_force(notice):
    """Random edits up to and beyond the bound, in the name as well: found exactly if the rules allow them."""
    scanner, rng = licenses.Scanner(), random.Random(4)
    phrase, label, errors, name = notice
    seen = set()
    for _ in range(40):
        text = list(phrase)
        for _ in range(rng.randint(0, errors + 2)):
            at = rng.randrange(len(text))
            kind = rng.randrange(3)
            if kind == 0:
                text[at] = rng.choice("abcxyz ")
            elif kind == 1 and len(text) > 1:
                del text[at]
            else:
                text.insert(at, rng.choice("abcxyz "))
        whole = " ".join("".join(["some words ", *text, " and more"]).split())
        want = brute_notice(notice, whole)
        seen.add(want)
        assert any(scanner.notices[k] == notice for k, *_ in scanner.notices_in(whole)) == want, whole
    assert True in seen


def test_no_label_across_names():
    scanner = licenses.Scanner()
    for text in ["released under the bsd license", "released under the isc license", "released under the gpl license", "released under the x11 license",
                 "released under the mitt license", "licensed under cc by nd 4 0", "licensed under cc by 4 0", "gnu affero general public licence",
                 "this work is licensed under the eclipse public license version 3", "licensed under a creative commons zero 4 0 international license"]:
        assert scanner.scan(text.encode())[5:7] == ("", 0.0), text
    assert scanner.scan(b"this work is licensed under the gnu lesser general public license version 3")[5] == "gpl,lgpl"  # gpl is a base phrase
    text = "é東😀 " * 3 + "All rights reservd ü"
    assert scanner.scan(text.encode())[-1][0][:4] == ("proprietary", 3, 5, 1)


# Byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def test_encoder_equals_the_library(vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    own, other = bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "th", "er", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "12", "!!", "$$$", "ing", "aaaa", "\x1c", "\x85", " ", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 50_000, "ab" * 20_000, " " * 5000 + "x", "", "-" * 3000 + "é" * 3000]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_bpe_of_odd_rows(spark, odd_docs, no_docs, vocabulary):
    got = as_rows(bpe.op7(spark, odd_docs))
    digests = collections.Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd_docs.collect())
    assert collections.Counter(r["decoded_sha256"] for r in got) == digests
    assert bpe.op7(spark, no_docs).count() == 0
    ranks, pattern = vocabulary
    both = bpe.decode(bpe.encode(odd_docs, ranks, pattern), ranks).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both)


def test_memory_that_is_full_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMORY_PAIRS", 5)
    ranks, pattern = vocabulary
    encoder = bpe.Encoder(ranks, pattern)
    text = " ".join(f"wörd{i}thing, and more" for i in range(60)) * 2
    assert encoder.encode(text) == encoder.split_and_encode(text) and encoder.decode(encoder.encode(text)) == text.encode()
