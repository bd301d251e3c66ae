"""Operators on embeddings, conversations and pages, and the pipeline, against brute force."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.harness import compare
from tradeloom.llm import chat, embeddings, neighbours, warc
from tradeloom.llm.components import components, local_forest

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, id int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        rows.append((i, rng.standard_normal(16).tolist(), int(rng.integers(3)), "x", 1))
    for g in range(8):  # groups of near copies, one of them dense and larger than a window
        centre = rng.standard_normal(16)
        for _ in range(120 if g == 0 else 6):
            rows.append((len(rows), (centre + 0.04 * rng.standard_normal(16)).tolist(), 1, None, 1))
    same = rng.standard_normal(16).tolist()
    rows += [(len(rows) + i, same, 2, "x", 1) for i in range(70)]
    n = len(rows)
    rows += [(n, None, 1, "x", 1), (n + 1, [0.0] * 16, 1, "x", 1), (n + 2, [float("nan")] + [1.0] * 15, 1, "x", 1), (n + 3, [float("inf")] * 16, 1, "x", 1)]
    rows += [(n + 4, same, None, "x", 1), (n + 5, [None] + [1.0] * 15, 1, "x", 1), (n + 6, [], 1, "x", 1), (n + 7, [1.0, 2.0], 1, "x", 1)]
    rows += [(n + 8, [2 * x for x in same], 2, "x", 1), rows[0], (None, rng.standard_normal(16).tolist(), 1, "x", 1)]
    return spark.createDataFrame(rows, VECTORS)


def clean(rows):
    return [r for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_match_brute_force(spark, vectors, block):
    rows = vectors.collect()
    got = embeddings.near_duplicates(vectors, block=block).collect()
    assert len(got) == len(rows)
    use = [r for r in clean(rows) if r["label"] is not None and len(r["embedding"]) == 16]
    x = np.array([r["embedding"] for r in use])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in use])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    u, v = np.nonzero(linked)
    nodes, roots = local_forest(u.astype(np.int64), v.astype(np.int64))
    root = dict(zip(nodes.tolist(), roots.tolist()))
    least = {}
    for i, r in enumerate(use):
        if r["vec_id"] is not None:
            least[root.get(i, i)] = min(least.get(root.get(i, i), 1 << 60), r["vec_id"])
    want = collections.Counter((r["vec_id"], int(linked[i].sum()), least.get(root.get(i, i))) for i, r in enumerate(use))
    ids = collections.Counter(r["vec_id"] for r in use)
    want += collections.Counter((r["vec_id"], 0, r["vec_id"]) for r in rows if r["vec_id"] not in ids)
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_a_star_keeps_all_its_links(spark):
    """Copies at 0.985 to an original are at about 0.970 to each other: only the original joins them."""
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(128)
    centre /= np.linalg.norm(centre)
    aside = rng.standard_normal((1500, 128))
    aside -= np.outer(aside @ centre, centre)
    copies = 0.985 * centre + np.sqrt(1 - 0.985**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    x = np.concatenate([centre[None], copies, rng.standard_normal((3000, 128))])
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.op5(spark, table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want[0] == 1500 and [got[i][0] for i in range(len(x))] == want.tolist()
    assert all(got[i][1] == (0 if i <= 1500 else i) for i in got)


def test_near_duplicates_do_not_depend_on_partitions(spark):
    """Small tables over many partitions, vectors of several sizes mixed: every pair is still compared."""
    rng = np.random.default_rng(9)
    rows = []
    for size in (8, 12):
        centres = rng.standard_normal((4, size))
        rows += [(len(rows) + i, v.tolist(), 1) for i, v in enumerate(np.repeat(centres, 3, axis=0) + 0.02 * rng.standard_normal((12, size)))]
    want = {}
    for i, v, _ in rows:
        near = [j for j, w, _ in rows if len(w) == len(v) and np.dot(v, w) >= 0.98 * np.linalg.norm(v) * np.linalg.norm(w)]
        want[i] = len(near) - 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = embeddings.op5(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
            assert {r["vec_id"]: r["n_links"] for r in got} == want, parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passes_grow_with_the_table():
    assert 4 <= embeddings.passes_for(0) <= embeddings.passes_for(10**4) < embeddings.passes_for(10**9) < 100


def test_vector_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embeddings.op5(spark, empty).count() == 0 and neighbours.op9(spark, empty).count() == 0


@pytest.mark.parametrize("block,size", [(8192, 256), (40, 24)])
def test_neighbours_against_brute_force(spark, vectors, monkeypatch, block, size):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LIST_SIZE", size)
    rows = [r for r in clean(vectors.collect()) if r["vec_id"] is not None and len(r["embedding"]) == 16]
    got = collections.defaultdict(list)
    for r in neighbours.op9(spark, vectors).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    vector = dict(zip(ids.tolist(), x))
    hits = total = 0
    for i in [i for i in vector if i % 20 == 0]:
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1))
        assert all(v != i and s == pytest.approx(vector[v] @ vector[i], abs=1e-12) for _, v, s in mine)
        keys = [(-round(s, 9), v) for _, v, s in mine]
        assert keys == sorted(keys)
        scores = sorted(((-round(float(vector[v] @ vector[i]), 9), v) for v in vector if v != i))[:20]
        assert len(mine) == len({v for _, v, _ in mine}) == len(scores), (i, mine)
        hits += len({v for _, v in scores} & {v for _, v, _ in mine})
        total += 20
    assert hits / total >= (0.95 if size > 100 else 0.9)


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    order = list(range(500))
    rng.shuffle(order)
    links = list(zip(order, order[1:])) + [(1000 + i, 1000) for i in range(300)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 500)) and 0 not in got
    assert all(got[1000 + i] == 1000 for i in range(1, 300)) and 5000 not in got


# Chat ------------------------------------------------------------------------------------------


def test_escaping_is_exact():
    codec, rng = chat.Codec(chat.DEFAULT), random.Random(2)
    parts = ["\\", "[", "INST]", "[INST]", "</s>", "<s>", "<", "s>", "/", "[SYS]", "a", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        written = codec.escape(text)
        assert codec.unescape(written) == text and not codec.control.search(written)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s>[INST]\\"), (2, 0, "assistant", ""), (2, 1, None, None),
        (2, None, "tool", "[ROLE] x"), (3, 0, "user", "q"), (3, 0, "user", "q"), (None, 0, "user", "w" * 200_000), (4, 0, "weird [SAYS] role", "t"),
        *[(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(9000)],
    ]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int, loss string")
    got = {r["conv_id"]: r for r in chat.op8(spark, turns).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, found in groups.items():
        found.sort()
        learned = "".join(text for *_, role, text in found if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in found).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(found), digest)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c for c, r in got.items() if r["valid"]} == {1, None, 5, -1}
    assert chat.read_back(chat.format_chat(turns.filter("false"))).count() == 0


def read_in_pieces(codec, parts, size):
    reader, text, at = chat.Reader(codec), "".join(p for p, _ in parts), 0
    for part, loss in parts:
        if loss:
            reader.mask(at, at + len(part))
        at += len(part)
    for i in range(0, len(text), size):
        reader.feed(text[i : i + size])
    reader.finish()
    return reader


@pytest.mark.parametrize("escaped", [True, False])
def test_turns_are_found_in_the_joined_text(monkeypatch, escaped):
    """Whatever the pieces; without escaping, texts that look like marks break the turns."""
    if not escaped:
        monkeypatch.setattr(chat.Codec, "escape", lambda self, text: text)
    codec, rng = chat.Codec(chat.DEFAULT), random.Random(6)
    parts = ["[INST]", "</s>", "[/INST]", "[ANS]", "\\", "[SAYS]", "[/ROLE]", "<s>", "plain ", "[", "]"]
    wrong = 0
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "[SAYS]"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for _ in range(4)]
        made = [("<s>", False)] + [p for role, text in turns for p in codec.turn(role, text)]
        learned = "".join(text for role, text in turns if role == "assistant").encode()
        want = (4, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), hashlib.sha256(learned).hexdigest())
        try:
            found = [read_in_pieces(codec, made, size) for size in (1, 3, 1000)]
            wrong += any((r.n_turns, r.turns.hexdigest(), r.loss.hexdigest()) != want for r in found)
        except ValueError:
            wrong += 1
    assert wrong == 0 if escaped else wrong > 200


# WARC ------------------------------------------------------------------------------------------


def test_archives_come_back_whole(spark):
    rng = random.Random(6)
    html = [None, "", "a\r\n\r\nWARC/1.1\r\n\r\n", "\r\n", "x\r\n\r\n", "0\r\n\r\n", "é" * 90_000, "é" * 90_000, "Content-Length: 7\r\n\r\n" * 9000, "tail\r\n"]
    html += ["".join(rng.choice("ab\r\n é") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [(i, f"http://x/{i}\r\nEvil: 1" if i % 2 else None, h) for i, h in enumerate(html)]
    rows += [(500 + i, "u", "same page") for i in range(40)] + [(7, "u", "é" * 90_000), (7, "u", "é" * 90_000), (None, "u", "zz"), (None, "u", "same page")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, payload int, sha string")
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in rows:
        h = (h or "").encode()
        first = best[h] == (-1 if i is None else i)
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        want[i, len(h), digest, "response" if first else "revisit", None if first else best[h]] += 1
    got = warc.op10(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert warc.op10(spark, pages.filter("false")).count() == 0


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "longer text"), (4, "u", "longer text")], "page_id bigint, url string, html string")
    warc.write(pages, f"{tmp_path}/w", least=5)
    got = {r["page_id"]: r["type"] for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_missing_segments_are_seen(spark, tmp_path):
    records = list(warc.response_records(1, "u", b"x" * 5000, 1000))
    for name, kept in (("whole", records), ("hole", records[:2] + records[3:]), ("end", records[:-1]), ("head", records[1:])):
        rng = random.Random(1)
        mixed = kept[:]
        rng.shuffle(mixed)
        df = spark.createDataFrame([(r.decode(),) for r in mixed], "value string").coalesce(1)
        df.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"{tmp_path}/{name}")
        got = warc.read(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == 1 and got[0]["intact"] == (name == "whole")
        assert (bytes(got[0]["payload"]) == b"x" * 5000) if name == "whole" else got[0]["payload"] is None


# Queries and pipeline --------------------------------------------------------------------------

OWN = sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in OWN} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(set(OWN) & set(entry.oracle_sql())))
def test_matches_sql(spark, folder, name):
    assert compare(spark, folder, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_stages_of_the_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/../sf0.01/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/../sf0.01/labels.parquet").collect()}
    sf_dir = f"{folder}/../sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "mixing_to_weights", "byte_level_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        if name != "byte_level_bpe":
            assert out.schema == docs.schema
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "quality_classifier":
            good = [r for r in before if labels.get(r["doc_id"]) and labels[r["doc_id"]]["quality"] == 1]
            assert len({r["doc_id"] for r in after} & {r["doc_id"] for r in good}) >= 0.99 * len(good)
        if name == "simhash_near_dedup":
            assert len({r["text"] for r in after}) == len(after) == len({r["doc_id"] for r in after})
        if name == "byte_level_bpe":
            assert len(after) == len(before)
        docs = spark.createDataFrame(after, out.schema)


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, folder):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# Odd sizes ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("factor", [1e160, 1e300, 1e-100])
def test_neighbours_of_vectors_of_any_length(spark, factor):
    """One very long (or all very short) vector: the others keep their neighbours."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 8))
    x[7] *= factor if factor > 1 else 1
    if factor < 1:
        x *= factor
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in neighbours.op9(spark, table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == [0, 20, 40] and all(len(v) == 20 for v in got.values())
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    for q in got:  # by the query's direction, which orders alike and overflows less
        near = sorted((-float(unit[q] @ x[i]), i) for i in range(60) if i != q)
        assert got[q] == [i for _, i in near[:20]]


def test_a_sample_of_repeated_rows_is_not_empty(spark):
    from tradeloom.llm.common import first_by_hash

    for doc in (1, 2, 3):
        same = spark.range(20_000).selectExpr(f"{doc} AS doc_id", "1 AS quality")
        assert first_by_hash(same, 500, 42, "doc_id", "quality").count() == 500
    mixed = spark.range(20_000).selectExpr("id % 7000 AS doc_id")
    assert first_by_hash(mixed, 500, 42, "doc_id").count() == 500
