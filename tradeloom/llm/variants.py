"""Spelling variants by a dictionary of trie-node pairs.

All words stand in two tries, one of the words and one of the words read backwards, and every node
has a number. A word cut in two at a place is the pair (node of its head, node of its tail); a word
with one character left out is the pair (node before it, node behind it). So two words of one length
that share a pair with a character left out differ by this character, and a word whose cut equals
the pair of a longer one with a character left out is that word short of the character. Both are exact:
equal numbers are equal strings, whatever the length, and no word is compared with another one.

*Numbering.* Sorted words bring equal heads together: a node is new where a word leaves the head it
shares with the word before. Words are dealt in sorted ranges, each numbered by a task of its own;
heads that run over a border are named by the border, which the driver knows by one cut head each.
A word of any length costs one number per character, never a copy of its heads.

*Hot pairs.* A pair with a character left out is shared by at most one word for each letter of the
alphabet, and one more holds it as a cut, so no group is larger than that. A letter in a run of equal
ones gives the same word wherever it is left out; only the last of the run counts as an insertion.

Words are counted in the tasks before they are shuffled. Rules: a null text has no words; a null id
is written as nothing before the colon; an empty table gives no rows; repeated rows count again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, parts_for, utf8
from tradeloom.storage import materialize

LENGTH = 7
OCCURRENCES = 2
SHARE = 10
ERRORS = 31

CUT, INNER, LAST = 0, 1, 2
#: Words a task counts before it passes the counts on.
HELD = 1 << 17


def runs_of(text: bytes, least: int) -> list[bytes]:
    """Maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of ``least`` or more, A-Z in lower case."""
    return re.findall(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least, text.lower())  # on bytes lower() touches ASCII only


def words_of(doc: bytes, text: bytes, least: int = LENGTH, errors: int = ERRORS) -> Iterator[bytes]:
    """Words of one document; a run whose checksum ``errors`` divides loses one character."""
    start = zlib.crc32(doc + b":")
    for run in runs_of(text, least):
        h = zlib.crc32(run, start)
        if errors and h % errors == 0:
            letters = run.decode()
            k = h % len(letters)
            if len(letters) > least:
                yield (letters[:k] + letters[k + 1 :]).encode()
        else:
            yield run


def vocabulary(df: DataFrame, ids: str = "doc_id", text: str = "text", least: int = LENGTH, occurrences: int = OCCURRENCES, errors: int = ERRORS) -> DataFrame:
    """(word, n) of all words with at least ``least`` characters and ``occurrences`` occurrences."""
    bound_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, x in zip(batch.column(0), batch.column(1)):
                seen.update(words_of(doc.as_py(), x.as_py(), least, errors))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = df.select(utf8(ids).alias("id"), utf8(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _ranged(df: DataFrame, label: str) -> DataFrame:
    """Words sorted in ranges: adds ``part``, the range, and ``place``, which grows with the word."""
    ranged = df.repartitionByRange(parts_for(df), "word").sortWithinPartitions("word")
    return materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), label)


def _shared(a: str, b: str) -> int:
    """Length of the head that both share."""
    if b.startswith(a):
        return len(a)
    return len(os.path.commonprefix([a, b]))


def _borders(ranged: DataFrame) -> list[tuple[int, str]]:
    """For every range that has a next one: its number and the head its last word shares with the next range's first."""
    ends = ranged.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))  # one row a range
    ends = ends.select("part", "last", F.lead("first").over(Window.orderBy("part")).alias("first")).filter("first is not null")

    @F.arrow_udf("string")
    def head(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([x.as_py()[: _shared(x.as_py(), y.as_py())] for x, y in zip(a, b)], pa.string())

    return [(r.part, r.head) for r in ends.select("part", head("last", "first").alias("head")).orderBy("part").collect()]


def trie_nodes(ranged: DataFrame) -> DataFrame:
    """(id, nodes) for rows (id, word, part, place): the numbers of the trie nodes on the word's path, the root (0) first."""
    bound_batches(ranged.sparkSession)
    borders = _borders(ranged)
    at = {part: i for i, (part, _) in enumerate(borders)}
    heads = [head for _, head in borders]
    #: how far a border's head is also the head of the border before: there the earlier border gives the name
    same = [0] + [_shared(a, b) for a, b in zip(heads, heads[1:])]

    def name(border: int, depth: int) -> int:
        while border and same[border] >= depth:
            border -= 1
        return -((border + 1) << 32) - depth

    before = {part: i - 1 for part, i in at.items()}
    last_part = max(at, default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, word, path, fresh, around = -1, "", np.zeros(1, np.int64), 0, []
        for batch in batches:
            sizes, out = [0], []
            for now, p in zip(batch.column(1), batch.column(2).to_pylist()):
                now = now.as_py()
                if p != part:
                    part, word, path, fresh = p, "", np.zeros(1, np.int64), (p + 1) << 40
                    left = before.get(p, len(heads) - 1 if p > last_part else -1)
                    around = [(heads[b], [name(b, d) for d in range(1, len(heads[b]) + 1)]) for b in (at.get(p, -1), left) if b >= 0]
                shared = _shared(word, now)
                new = np.arange(fresh, fresh + len(now) - shared, dtype=np.int64)
                fresh += len(new)
                path = np.concatenate([path[: shared + 1], new])
                for head, names in around:
                    k = _shared(head, now)
                    path[1 : k + 1] = names[:k]
                word = now
                out.append(path)
                sizes.append(len(path))
            offsets = pa.array(np.cumsum(sizes).astype(np.int32))
            nodes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes], names=["id", "nodes"])

    dealt = ranged.select("id", "word", "part").repartition(parts_for(ranged), "part").sortWithinPartitions("part", "word")
    return dealt.mapInArrow(run, "id bigint, nodes array<bigint>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (id, n, word, head nodes, tail nodes); emits (head, tail, kind, id, n): each cut and each character left out."""
    for batch in batches:
        held: list[tuple[np.ndarray, ...]] = []
        for i, n, word, heads, tails in zip(*(batch.column(k) for k in range(5))):
            letters = np.frombuffer(word.as_py().encode("utf-32-le"), "<u4")
            f, r = heads.values.to_numpy(), tails.values.to_numpy()[::-1]
            size = len(letters)
            last = np.append(letters[1:] != letters[:-1], True)
            kind = np.concatenate([np.full(size + 1, CUT), np.where(last, LAST, INNER)]).astype(np.int8)
            held.append((np.concatenate([f, f[:-1]]), np.concatenate([r, r[1:]]), kind, np.full(2 * size + 1, i.as_py()), np.full(2 * size + 1, n.as_py())))
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["head", "tail", "kind", "id", "n"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (head, tail, kind, id, n) sorted by pair; for each word in a shared pair (id, number of near words, the best one's n and id)."""
    held: pa.Table | None = None

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        head, tail, kind, ids, n = (c.to_numpy() for c in table.columns)
        edge = np.flatnonzero((head[1:] != head[:-1]) | (tail[1:] != tail[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(head)]])
        several = np.flatnonzero(ends - starts > 1)
        out: list[tuple[int, int, int, int]] = []
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            members = sorted(range(s, e), key=lambda k: (-n[k], ids[k]))
            rest = [k for k in members if kind[k] != CUT]
            whole = [k for k in members if kind[k] == CUT]
            ends_of = [k for k in rest if kind[k] == LAST]
            for k in rest:  # the same length: every other one; shorter: the whole word
                near = [x for x in members if x != k and (kind[x] != CUT or kind[k] == LAST)]
                if near:
                    out.append((ids[k], len(near), n[near[0]], ids[near[0]]))
            if whole and ends_of:
                out.append((ids[whole[0]], len(ends_of), n[ends_of[0]], ids[ends_of[0]]))
        if out:
            columns = [np.array(c, np.int64) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "near", "best", "to"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        head, tail = table.column(0).to_numpy(), table.column(1).to_numpy()
        other = np.flatnonzero((head != head[-1]) | (tail != tail[-1])) if len(head) else []
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from settle(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and len(held):
        yield from settle(held)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best, to) for rows (id, word, n) with ids in code-point order: the number of words at one
    insertion, deletion or replacement, and the n and id of the most frequent of them (ties: the smallest)."""
    n_parts = parts_for(words)
    heads = trie_nodes(words)
    backwards = _ranged(words.select("id", F.reverse("word").alias("word")), "variants-backwards")
    tails = trie_nodes(backwards).select("id", F.col("nodes").alias("tails"))
    paths = words.select("id", "n", "word").join(heads, "id").join(tails, "id").select("id", "n", "word", "nodes", "tails")
    keyed = paths.mapInArrow(_keys, "head bigint, tail bigint, kind tinyint, id bigint, n bigint")
    keyed = keyed.repartition(n_parts, "head", "tail").sortWithinPartitions("head", "tail")
    found = keyed.mapInArrow(_near, "id bigint, near bigint, best bigint, to bigint")
    best = F.max(F.struct(F.col("best"), (-F.col("to")).alias("to")))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b")).select("id", "n_near", "b.best", (-F.col("b.to")).alias("to"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for links (id, to) without cycles, at most one for each id: where following them ends."""
    now = materialize(forms.select("id", F.col("to").alias("root")), "variants-roots")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = materialize(now.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        now = longer.select("id", "root")
        if not longer.filter("moved").limit(1).count():
            return now


def spelling_variants(words: DataFrame, share: int = SHARE) -> DataFrame:
    """For words (word, n): word, n, n_near, form, form_n, root. A word's form is its most frequent near word,
    if that occurs ``share`` times as often or more."""
    words = _ranged(words.select("word", "n"), "variants-words").withColumnRenamed("place", "id")
    near = materialize(near_words(words), "variants-near")
    marked = words.select("id", "word", "n").join(near, "id", "left")
    marked = marked.withColumn("to", F.when(F.col("best") >= share * F.col("n"), F.col("to")))
    marked = materialize(marked.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "to"), "variants-marked")
    ends = roots(marked.filter("to is not null").select("id", "to"))
    named = marked.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rooted = marked.join(ends, "id", "left").join(named, "to", "left")
    final = marked.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    out = rooted.join(final, "root", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract of query 11 over any table with doc_id and text."""
    return spelling_variants(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
