"""Registered queries of this package and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import bpe, chat, embeddings, licenses, mixing, negatives, neighbours, quality, repeats, simhash, toxicity, variants, warc
from tradeloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _with_labels(build: Callable[[SparkSession, DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _over(name: str, build: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(spark, table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": _over("documents", simhash.op1),
    "op2_mixing_to_weights": _over("documents", mixing.op2),
    "op3_quality_classifier": _with_labels(quality.op3),
    "op4_toxicity": _with_labels(toxicity.op4),
    "op5_embedding_near_dedup": _over("embeddings", embeddings.op5),
    "op6_license_scan": _over("documents", licenses.op6),
    "op7_byte_level_bpe": _over("documents", bpe.op7),
    "op8_chat_formatting": _over("conversations", chat.op8),
    "op9_nearest_neighbours": _over("embeddings", neighbours.op9),
    "op10_warc": _over("pages", warc.op10),
    "op11_spelling_variants": _over("documents", variants.op11),
    "op12_substring_dedup": _over("documents", repeats.op12),
    "op13_hard_negatives": _over("embeddings", negatives.op13),
}
#: Marks of the chat template, for the lengths that its escapes add.
_CONTROL = r"(\[/?SYS\]|\[/?INST\]|\[ANS\]|\[/?ROLE\]|\[SAYS\]|</?s>)"


def _escaped(column: str) -> str:
    return rf"length(regexp_replace(replace({column}, '\', '\\'), '{_CONTROL}', '#\1', 'g'))"


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(sha, 5 * i + 1, 5))::BIGINT >> {shift}) & 31) AS INTEGER) + 1, 1)"
    for shift in (15, 10, 5, 0)
)

ORACLES: dict[str, str] = {
    "op5_embedding_near_dedup": """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least.b AS component_id, v.vec_id = least.b AS kept
FROM embeddings v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op8_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({_escaped('text')} + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
    ELSE 19 + {_escaped('role')} END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
    ORDER BY turn NULLS FIRST, role, text), 's?(ua)*u?') AS valid
FROM t GROUP BY conv_id""",
    "op10_warc": f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT sha, max(page_id) AS best FROM d GROUP BY 1)
SELECT page_id, payload_bytes, array_to_string([{_BASE32} FOR i IN range(8)], '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN b USING (sha)""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) r(i))),
run AS (
  SELECT d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, text FROM documents)),
coded AS (
  SELECT run, n, xor(4294967295, list_reduce(flatten([CASE WHEN u < 128 THEN [u] ELSE [195, u - 64] END FOR u IN [CAST(unicode(c) AS BIGINT) FOR c IN string_split(d || ':' || run, '')]]),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) AS h FROM (SELECT d, run, count(*) AS n FROM run GROUP BY ALL), crc),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM coded)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
skip AS (SELECT word, i, word[:i] AS head, word[i + 2:] AS tail FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pair AS (
  SELECT a.word AS a, b.word AS b FROM skip a JOIN skip b USING (i, head, tail) WHERE a.word <> b.word
  UNION SELECT s.word, v.word FROM skip s JOIN v ON v.word = s.head || s.tail
  UNION SELECT v.word, s.word FROM skip s JOIN v ON v.word = s.head || s.tail),
near AS (
  SELECT a AS word, count(*) AS n_near, max(o.n) AS best, arg_min(b, (-o.n, encode(b))) AS other
  FROM pair JOIN v o ON o.word = b GROUP BY 1),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 10 * v.n THEN other END AS form FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS at FROM form UNION ALL SELECT w.word, f.form FROM walk w JOIN form f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, g.n AS form_n
FROM form f JOIN walk w ON w.word = f.word JOIN form e ON e.word = w.at AND e.form IS NULL LEFT JOIN form g ON g.word = f.form""",
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (
  SELECT p.a, p.b, p.s, s.b AS other, s.s AS reached, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, other AS negative_id, s AS positive_score, reached AS negative_score
FROM n WHERE rank <= 3""",
}
