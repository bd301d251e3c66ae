"""Byte-level BPE: encode texts to token ids and back.

Each piece of the split pattern is mapped byte by byte to Latin-1 characters, so that one
Aho-Corasick automaton over the vocabulary finds every token that starts at any byte. The encoder
walks the piece left to right with the longest token that fits, and accepts it only if it may
stand after the token before it: two tokens are compatible when merging their joined bytes gives
back exactly these two. A token that is not compatible is replaced by its next shorter prefix;
when none is left, the last token is taken back and its end is marked as a dead end, so that every
position is left at most once and the work stays linear. Compatibility is memoised. The result is
the merge order's own result, because a sequence of tokens is what the merges give if and only if
all its adjacent pairs are.

Rules: a null text is the empty text; empty text gives no ids; a piece that is itself a token is
that token; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, free_name

#: A worker keeps two generations of so many encoded pieces and as many words between spaces, none
#: longer than this, and so many pairs. They bound memory only; a piece that is not remembered is encoded again.
MEMORY_PIECES = 160_000
MEMORY_CHARS = 64
MEMORY_PAIRS = 1_000_000


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Memory:
    """Bounded map: two generations, the older of which is forgotten when the younger is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        ids = self.young.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= MEMORY_CHARS:
            if len(self.young) >= MEMORY_PIECES:
                self.old, self.young = self.young, {}
            self.young[key] = ids


class Encoder:
    """Exact byte-pair encoding of single pieces by longest match and backtracking."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        #: Tokens that merging gives back as themselves; only these can occur inside a longer piece.
        self.inner = {t for t in self.ranks if len(t) == 1 or self.merge(t) == [t]}
        self.reach = max(map(len, self.inner), default=0)
        automaton = ahocorasick.Automaton()
        for token in self.inner:
            automaton.add_word(token, len(token))
        automaton.make_automaton()
        self.longest = automaton.longest_prefix
        self.follows: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        self.pieces, self.words = Memory(), Memory()

    def merge(self, data: str) -> list[str]:
        """The merges by definition, lowest rank first; only ever used on one token or two."""
        ranks, none = self.ranks, 1 << 60
        parts = list(data)
        rank = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while rank and (low := min(rank)) != none:
            i = rank.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if self.known_pairs >= MEMORY_PAIRS:
            self.follows.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        fits = self.follows.setdefault(left, {})[right] = self.merge(left + right) == [left, right]
        return fits

    def encode_piece(self, data: str) -> list[int]:
        """Ids of one piece; ``data`` has a Latin-1 character for each of its bytes."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        inner, longest, reach, follows, end = self.inner, self.longest, self.reach, self.follows, len(data)
        tokens: list[str] = []
        dead: set[int] = set()
        at, size, after = 0, longest(data[:reach]), None
        while at < end:
            while size:
                token = data[at : at + size]
                if token in inner and at + size not in dead:
                    if after is None:
                        break
                    fits = after.get(token)
                    if fits or fits is None and self.compatible(tokens[-1], token):
                        break
                size -= 1
            if size:
                tokens.append(token)
                at += size
                size = longest(data[at : at + reach])
                after = follows.get(token, {})
            else:
                if not tokens:
                    raise ValueError("the vocabulary cannot express these bytes")
                dead.add(at)
                size = len(tokens.pop())
                at -= size
                after = follows.get(tokens[-1], {}) if tokens else None
        return [ranks[t] for t in tokens]

    def split_and_encode(self, text: str) -> bytes:
        out, young = [], self.pieces.young
        for piece in self.split(text):
            ids = young.get(piece)
            if ids is None:
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = pack(self.encode_piece(piece.encode().decode("latin-1")))
                    self.pieces.put(piece, ids)
                young = self.pieces.young
            out.append(ids)
        return b"".join(out)

    def word(self, word: str) -> bytes:
        """Ids of a space and a word."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.split_and_encode(" " + word)
            self.words.put(word, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        In this family of patterns a space before a character that is no white space always begins
        a match. So the text may be cut there, and what lies between two such spaces be looked up
        as one. A part that is empty or begins with white space stays with the part before it.
        """
        parts = text.split(" ")
        found = list(map(self.words.young.get, parts))
        found[0] = None
        runs: list[list[int]] = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            part = parts[k]
            if k and (not part or part[0].isspace()):
                found[k] = b""
                if runs and runs[-1][1] == k - 1:
                    runs[-1][1] = k
                else:
                    runs.append([k - 1, k])
            elif k:
                found[k] = self.word(part)
            else:
                found[k] = self.split_and_encode(part)
        for start, end in runs:
            found[start] = self.split_and_encode((" " if start else "") + " ".join(parts[start : end + 1]))
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: One encoder per worker and vocabulary; workers are reused, and so are their memories.
_encoders: dict[tuple[int, str], Encoder] = {}


def _mark(ranks: dict[bytes, int]) -> int:
    """Tells vocabularies apart in a worker's memory."""
    return hash(frozenset(ranks.items()))


def _encoder(shipped, mark: int, pattern: str) -> Encoder:
    key = (mark, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shipped.value, pattern)
    return _encoders[key]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as bytes (little-endian unsigned 32-bit), under a free name like ``ids``.

    The vocabulary is read once by the driver and shipped; it has a fixed size of about a megabyte.
    """
    bound_batches(df.sparkSession)
    shipped, mark = df.sparkSession.sparkContext.broadcast(ranks), _mark(ranks)

    @F.arrow_udf("binary")
    def ids_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shipped, mark, pattern)
        for batch in texts:
            yield pa.array([encoder.encode(x.as_py() or "") for x in batch], pa.binary())

    return df.withColumn(free_name(df.columns, ids), ids_of.asNondeterministic()(F.col(f"`{text}`").cast("string")))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for, under a free name like ``decoded``."""
    bound_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = shipped.value.__getitem__
        for batch in batches:
            out = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch]
            yield pa.array(out, pa.binary())

    return df.withColumn(free_name(df.columns, decoded), bytes_of.asNondeterministic()(F.col(f"`{ids}`")))


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode ``text`` and keep digests only: n_tokens, ids_sha256, decoded_sha256.

    One pass in which neither the ids nor the decoded texts leave the worker. ``df`` must not
    already have these three columns; other columns stay.
    """
    bound_batches(df.sparkSession)
    shipped, mark = df.sparkSession.sparkContext.broadcast(ranks), _mark(ranks)
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    fields = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf(f"struct<{kind.replace(' bigint', ':bigint').replace(' string', ':string')}>")
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shipped, mark, pattern)
        for batch in texts:
            rows = []
            for x in batch:
                ids = encoder.encode(x.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], fields=list(fields)
            )

    kept = [c for c in df.columns]
    name = free_name(kept, "digest")
    out = df.withColumn(name, digest.asNondeterministic()(F.col(f"`{text}`").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in kept], f"{name}.n_tokens", f"{name}.ids_sha256", f"{name}.decoded_sha256")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract of query 7 over any table with doc_id and text."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")
