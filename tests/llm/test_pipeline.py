"""The pipeline's rows against a second run of every stage in plain Python, each on the stage's own input."""

import collections
import hashlib
import struct

import tiktoken

import corpus_pipeline
from tests.llm.test_texts import brute_components, brute_fingerprint, brute_targets, words_of
from tradeloom.llm import quality, toxicity


def test_stages_match_brute_force(spark, folder):
    import public_tokenizers

    from tradeloom.llm import bpe

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, folder)
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    # every document is kept exactly if its own score says so
    good, rows = step("quality_classifier", docs)
    kept = {r["doc_id"] for r in quality.op3(spark, docs, labels).collect() if r["kept"]}
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in kept) and 0 < len(kept) < docs.count()
    clean, rows = step("toxicity", good)
    fine = {r["doc_id"] for r in toxicity.op4(spark, good, labels).collect() if not r["predicted"]}
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in good.collect() if r["doc_id"] in fine)

    # of each component of fingerprints at 4 bits or fewer, the smallest id
    before = clean.collect()
    marks = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
    links = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    firsts = set(brute_components(sorted(marks), links).values())
    distinct, rows = step("simhash_near_dedup", clean)
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in before if r["doc_id"] in firsts) and links

    # whole documents, at most twice, words within one document of each source's target
    before = {r["doc_id"]: tuple(r) for r in distinct.collect()}
    mixed, rows = step("mixing_to_weights", distinct)
    source, taken, sizes = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in distinct.collect():
        source[r["source"]] += len(words_of(r["text"]))
        sizes[r["source"]].append(len(words_of(r["text"])))
    for r in rows:
        assert tuple(r) == before[r["doc_id"]]
        taken[r["source"]] += len(words_of(r["text"]))
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2
    for s, target in brute_targets(source).items():
        assert 0 <= target - taken[s] < max(sizes[s])

    # the public library's ids
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, rows = step("byte_level_bpe", mixed)
    want = []
    for r in mixed.collect():
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(want)

    # run() is these stages one after the other
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, rows))
