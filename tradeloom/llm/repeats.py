"""Repeated passages by prefix-partitioned suffix trees.

Every place in a text where a window of ``WINDOW`` words starts is a suffix. Suffixes are split by
their prefixes into groups, each the subtree of a suffix tree below its prefix, and a group is walked
in sorted order: suffixes that agree with a neighbour over the whole window hang below an internal
node at that depth. The places below such deep nodes, joined where windows touch or overlap, are the
maximal repeated passages.

*Leaves above the depth.* Most suffixes are leaves long before ``WINDOW`` words. A suffix is dropped
unless a piece of ``PREFIX`` words of its window is repeated: the piece with the smallest hash, which
equal windows choose alike. Neighbouring windows mostly share it, so that counting these pieces takes
a tenth of the shuffle that counting suffixes would.

*Variable-length prefixes.* A prefix has ``PREFIX`` words. Prefixes shared by more than ``GROUP``
different suffixes are extended to the whole window, so that no group outgrows memory; what still
stands together then is one node. The list of extended prefixes holds ``EXTENDED`` at most, the most
frequent ones, so that any other has less than that share of all suffixes.

*Hot passages.* A task looks at a batch of texts: pieces and windows that repeat inside a batch are
settled there, and one mark stands for all of them, so a passage that a third of all texts hold
reaches its group once for each batch. Equal texts are one text from the start.

*Texts are shuffled once.* Different texts are written in buckets by their hash; later steps bring
short lists of hashes and places to them and never move a text again.

Words are compared by 64-bit hashes, windows by two of them (prefix and rest). Rules: a null text has
no words; texts of fewer than ``WINDOW`` words lose nothing; all copies of a repeated text lose all
words, as every row counts as a place of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, parts_for
from tradeloom.storage import materialize, write_buckets

WINDOW = 35
PREFIX = 16
#: Different suffixes below one prefix that a task may hold, and the most prefixes that are extended.
GROUP = 1 << 18
EXTENDED = 1 << 14
#: A batch reports a prefix that so many of its different suffixes share.
OFTEN = 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
SEED = 42

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: An odd multiplier for hashes of sequences.
_BASE = 0x9E3779B97F4A7C15
NEW, KNOWN, COUNT = 0, 1, 2


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part of the text at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        yield text[at:end].split()  # on bytes: space and the control characters 9 to 13
        at = end


def _hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    parts = [np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)) for words in words_of(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place that has so many behind it."""
    n = max(0, len(hashes) - length + 1)
    out, done, power, bit = np.zeros(n, np.uint64), 0, hashes, 1  # ``power`` holds stretches of ``bit`` words
    while bit <= length:
        if length & bit:
            out = out * np.uint64(pow(_BASE, bit, 1 << 64)) + power[done : done + n]
            done += bit
        if len(power) > bit:
            power = power[:-bit] * np.uint64(pow(_BASE, bit, 1 << 64)) + power[bit:]
        bit *= 2
    return _mix(out)


def first_smallest(values: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` values, the place of its first smallest one."""
    n = max(0, len(values) - span + 1)
    at, width = np.arange(len(values)), 1
    while width * 2 <= span:
        left, right = at[:-width], at[width:]
        at, width = np.where(values[right] < values[left], right, left), width * 2
    left, right = at[:n], at[span - width : span - width + n]
    return np.where(values[right] < values[left], right, left)


class _Batch:
    """The suffixes of some texts: for each, the text it starts in, its place there, and the piece it depends on."""

    def __init__(self, texts: pa.Array, window: int, prefix: int):
        parts = [_hashes((t.as_py() or "").encode()) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        pieces = sequences(words, prefix)
        smallest = first_smallest(pieces, window - prefix + 1)
        self.at = np.flatnonzero(text_of[: len(smallest)] == text_of[window - 1 : window - 1 + len(smallest)])
        self.text = text_of[self.at]
        self.place = self.at - self.starts[self.text]
        self.anchor = smallest[self.at]
        self.pieces, self.words = pieces, words
        self.window, self.prefix = window, prefix

    def piece(self) -> np.ndarray:
        return self.pieces[self.anchor]

    def rest(self, chosen: np.ndarray) -> np.ndarray:
        return sequences(self.words, self.window - self.prefix)[self.at[chosen] + self.prefix]

    def held(self, lists: list[np.ndarray]) -> np.ndarray:
        """Suffixes whose piece stands in the list of their text."""
        piece, out = self.piece(), np.zeros(len(self.at), bool)
        edges = np.searchsorted(self.text, np.arange(len(self.sizes) + 1))
        for k, known in enumerate(lists):
            if len(known) and edges[k] < edges[k + 1]:
                out[edges[k] : edges[k + 1]] = np.isin(piece[edges[k] : edges[k + 1]], known)
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if v.as_py() is None else v.values.to_numpy() for v in column]


def _pieces(window: int, prefix: int, often: int):
    """Reads (doc, text); emits (kind, key, other): a piece with its text, a piece known to be repeated by text, a count of a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch.column(1), window, prefix)
            if not len(b.at):
                continue
            docs = batch.column(0).to_numpy().view(np.uint64)
            anchors, first = np.unique(b.anchor, return_index=True)
            pieces, texts = b.pieces[anchors], docs[b.text[first]]
            values, inverse, counts = np.unique(pieces, return_inverse=True, return_counts=True)
            several = counts[inverse] > 1
            marks = values[counts > 1]
            pairs = np.unique(np.stack([texts[several], pieces[several]], axis=1), axis=0)
            heads, at, n = np.unique(b.pieces[b.at], return_inverse=True, return_counts=True)
            chosen = np.flatnonzero((n >= often)[at])  # prefixes with many suffixes: count the different ones
            tails = np.unique(np.stack([b.pieces[b.at[chosen]], b.rest(chosen)], axis=1), axis=0) if len(chosen) else np.zeros((0, 2), np.uint64)
            heads, n = np.unique(tails[:, 0], return_counts=True)
            heads, n = heads[n >= often], n[n >= often].astype(np.uint64)
            kind = np.repeat(np.array([NEW, NEW, KNOWN, COUNT], np.int8), [int((~several).sum()), len(marks), len(pairs), len(heads)])
            key = np.concatenate([pieces[~several], marks, pairs[:, 0], heads])
            other = np.concatenate([texts[~several], np.zeros(len(marks), np.uint64), pairs[:, 1], n])
            real = np.ones(len(kind), bool)
            real[int((~several).sum()) : int((~several).sum()) + len(marks)] = False
            other = pa.array(other.view(np.int64), mask=~real)
            yield pa.RecordBatch.from_arrays([pa.array(kind), _signed(key), other], names=["kind", "key", "other"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where the first ``width`` columns change."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        if not len(table):
            continue
        other = np.zeros(len(table), bool)
        for k in range(width):
            column = table.column(k).to_numpy()
            other |= column != column[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and len(held):
        yield held


def _edges(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edge = np.flatnonzero(change) + 1
    starts = np.concatenate([[0], edge])
    return starts, np.diff(np.append(starts, len(columns[0])))


def _repeated(group: int):
    """Reads (kind, key, other) sorted; emits (doc, piece) of repeated pieces, and (null, prefix, count) of frequent prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, 2):
            kind, key = table.column(0).to_numpy(), table.column(1).to_numpy()
            other, absent = table.column(2).fill_null(0).to_numpy(), table.column(2).is_null().to_numpy()
            starts, sizes = _edges(kind, key)
            size = np.repeat(sizes, sizes)
            total = np.add.reduceat(other, starts)
            known, new = kind == KNOWN, (kind == NEW) & (size > 1) & ~absent
            often = starts[(kind[starts] == COUNT) & (total > group)]
            docs = np.concatenate([key[known], other[new], np.zeros(len(often), np.int64)])
            piece = np.concatenate([other[known], key[new], key[often]])
            n = np.concatenate([np.zeros(known.sum() + new.sum(), np.int64), total[(kind[starts] == COUNT) & (total > group)]])
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=n > 0), pa.array(piece), pa.array(n)], names=["doc", "piece", "n"])

    return run


def _suffixes(window: int, prefix: int, extended: np.ndarray):
    """Reads (doc, tie, text, pieces); emits (prefix, rest, doc, at) of suffixes that may repeat, a mark without doc for those that do in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch.column(2), window, prefix)
            chosen = np.flatnonzero(b.held([x.view(np.uint64) for x in _lists(batch.column(3))]))
            if not len(chosen):
                continue
            head, rest = b.pieces[b.at[chosen]], b.rest(chosen)
            head = np.where(np.isin(head, extended), _mix(head ^ rest), head)  # these groups go by all words
            order = np.lexsort((rest, head))
            starts, sizes = _edges(head[order], rest[order])
            first, single = order[starts], sizes == 1
            text = b.text[chosen][first]
            docs = pa.array(batch.column(0).to_numpy()[text], mask=~single)
            at = (batch.column(1).to_numpy().astype(np.int64)[text] << 32) | b.place[chosen][first]
            yield pa.RecordBatch.from_arrays([_signed(head[first]), _signed(rest[first]), docs, pa.array(at)], names=["prefix", "rest", "doc", "at"])

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (prefix, rest, doc, at) sorted: the subtree below each prefix. Emits (doc, at) of the leaves above the depth of a window:
    those that share it with no neighbour. All others hang below a deep node."""
    for table in _by_key(batches, 2):
        starts, sizes = _edges(table.column(0).to_numpy(), table.column(1).to_numpy())
        alone = table.take(pa.array(starts[sizes == 1]))
        alone = alone.filter(alone.column(2).is_valid()).select(["doc", "at"])
        yield from alone.combine_chunks().to_batches()


def _passages(window: int, prefix: int):
    """Reads (doc, check, tie, text, pieces, leaves); emits a row for each text with its passages and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ties = batch.column(3), batch.column(2).to_numpy()
            b = _Batch(texts, window, prefix)
            deep = b.held([x.view(np.uint64) for x in _lists(batch.column(4))])
            edges = np.searchsorted(b.text, np.arange(len(b.sizes) + 1))
            rows = []
            for k, (text, leaves) in enumerate(zip(texts, _lists(batch.column(5)))):
                places = b.place[edges[k] : edges[k + 1]][deep[edges[k] : edges[k + 1]]]
                places = places[~np.isin(places, leaves[leaves >> 32 == ties[k]] & 0xFFFFFFFF)]
                cover = np.zeros(int(b.sizes[k]) + 1, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"first_word": int(s), "last_word": int(e) - 1} for s, e in zip(turn[::2], turn[1::2])]
                digest, at, any_yet = hashlib.sha256(), 0, False
                for words in words_of((text.as_py() or "").encode()):
                    kept = list(compress(words, (~gone[at : at + len(words)]).tolist()))
                    at += len(words)
                    if kept:
                        digest.update((b" " if any_yet else b"") + b" ".join(kept))
                        any_yet = True
                rows.append((len(gone), int(gone.sum()), digest.hexdigest(), spans))
            n, removed, digests, spans = zip(*rows) if rows else ((), (), (), ())
            kinds = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "check", "n_words", "n_removed", "kept_sha256", "passages"])

    return run


def repeated_passages(
    df: DataFrame, ids: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, often: int = OFTEN
) -> DataFrame:
    """For each row: the id as ``doc_id``, n_words, n_removed, kept_sha256 and passages, an array of (first_word, last_word) of the
    maximal stretches covered by windows of ``window`` words that stand anywhere else too."""
    bound_batches(df.sparkSession)
    n = parts_for(df)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    doc, check = F.xxhash64(t), F.xxhash64(F.lit(SEED), t)
    rows = materialize(df.select(F.col(f"`{ids}`").alias("doc_id"), doc.alias("doc"), check.alias("check")), "repeats-rows")
    different = df.select(doc.alias("doc"), t.alias("text")).groupBy("doc").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    texts = different.select("doc", F.posexplode("texts").alias("tie", "text"))  # hashes that clash are told apart by ``tie``
    texts = texts.select("doc", "tie", F.xxhash64(F.lit(SEED), "text").alias("check"), "text")
    texts = df.sparkSession.table(write_buckets(texts, "doc", "repeats_texts"))

    counted = texts.select("doc", "text").mapInArrow(_pieces(window, prefix, often), "kind tinyint, key bigint, other bigint")
    counted = counted.repartition(n, "key").sortWithinPartitions("kind", "key")
    found = materialize(counted.mapInArrow(_repeated(group), "doc bigint, piece bigint, n bigint"), "repeats-pieces")
    often_used = found.filter("doc is null").orderBy(F.desc("n"), "piece").limit(EXTENDED).select("piece")
    extended = np.array([r.piece for r in often_used.collect()], np.int64).view(np.uint64)
    pieces = materialize(found.filter("doc is not null").groupBy("doc").agg(F.collect_list("piece").alias("pieces")), "repeats-lists")

    held = texts.join(pieces, "doc").select("doc", "tie", "text", "pieces")
    suffixes = held.mapInArrow(_suffixes(window, prefix, extended), "prefix bigint, rest bigint, doc bigint, at bigint")
    suffixes = suffixes.repartition(n, "prefix").sortWithinPartitions("prefix", "rest")
    leaves = suffixes.mapInArrow(_leaves, "doc bigint, at bigint").groupBy("doc").agg(F.collect_list("at").alias("leaves"))

    marked = texts.join(pieces, "doc", "left").join(leaves, "doc", "left").select("doc", "check", "tie", "text", "pieces", "leaves")
    schema = "doc bigint, check bigint, n_words bigint, n_removed bigint, kept_sha256 string, passages array<struct<first_word:bigint,last_word:bigint>>"
    results = marked.mapInArrow(_passages(window, prefix), schema)
    copies = rows.groupBy("doc", "check").agg((F.count("*") > 1).alias("copied"))
    results = results.join(copies, ["doc", "check"])
    whole = F.col("copied") & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    span = F.array(F.struct(F.lit(0).cast("bigint").alias("first_word"), (F.col("n_words") - 1).alias("last_word")))
    results = results.select(
        "doc", "check", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(whole, span).otherwise(F.col("passages")).alias("passages"),
    )
    return rows.join(results, ["doc", "check"]).select("doc_id", "n_words", "n_removed", "kept_sha256", "passages")


def op12(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract of query 12 over any table with doc_id and text."""
    return repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
