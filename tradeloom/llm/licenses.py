"""Licence scan: fuzzy search for short notices.

Texts are lowered (A-Z) and cut into words of letters, digits and characters beyond ASCII, joined by
single spaces. Two searches run over the whole text:

*Base.* Places where the words of a phrase stand one after the other.

*Notices.* A notice of n characters may differ in up to ``errors`` edits. Cut into ``errors`` + 1
pieces, at least one piece must occur unchanged (pigeonhole). One automaton over all pieces of all
notices finds these seeds; around each, the window that the notice could fill is matched with the
regex library's bounded-error search, which verifies the edits. Windows of one notice that overlap
are searched as one, so a text full of seeds is gone through once, from left to right: around each
match the best of those that overlap it gives the span, and what is left before that is searched
again, so a better copy never hides a poorer one beside it.

The name in a notice is what tells licences apart ("mit", "bsd"), so it bears at most one edit, and none if it is short; the
other edits are those of the words around it.

A notice adds its label to those of the base phrases. The score is the best agreement: 1 for a base
phrase or an exact notice, less by the share of edited characters for others, 0 without any.

Rules: a null text is empty and has no words; equal rows give equal results; spans count words from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import bound_batches, free_name, utf8

#: Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices in words, their labels, the edits they bear, and the name in them that tells the licence: it may not be
#: edited if it has fewer than ``LONG`` letters, and by one edit otherwise.
NOTICES = (
    ("released under the mit license", "mit", 3, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6, ""),
    ("licensed under the apache license version 2 0", "apache", 4, "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl", 6, "gnu general public"),
    ("gnu lesser general public license", "lgpl", 2, "lesser general public"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7, ""),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 6, "mozilla"),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1, "nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1, "sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by", 5, "attribution"),
    ("all rights reserved", "proprietary", 1, ""),
)
LONG = 6

#: Bytes that belong to no word become spaces, capitals small letters; other bytes stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        import ahocorasick
        import regex

        self.base = [(re.compile(rb"(?<![^ ])(?=" + phrase.encode() + rb"(?![^ ]))"), len(phrase.split()), label) for phrase, label in base]
        self.must = sorted({phrase.split()[-1].encode() for phrase, _ in base})
        self.notices = notices
        #: The first match, and the best: fewest edits, whole words at both ends are not asked for.
        bounded = [self._pattern(regex, *notice) for notice in notices]
        self.first = [regex.compile(x) for x in bounded]
        self.fuzzy = [regex.compile(f"(?b){x}") for x in bounded]
        self.seeds = ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int]]] = {}
        for k, (words, _, errors, _) in enumerate(notices):
            edges = [len(words) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(edges, edges[1:]):
                starts.setdefault(words[a:b], []).append((k, a))
        for seed, places in starts.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    @staticmethod
    def _pattern(regex, words: str, label: str, errors: int, name: str) -> str:
        """The notice with its edits; the name stands between word ends, its edits are bounded apart."""

        def part(x: str, n: int) -> str:
            return rf"(?:{regex.escape(x, special_only=True)}){{e<={n}}}" if x else ""

        if not name:
            return part(words, errors)
        at = f" {words} ".index(f" {name} ")
        own = part(name, 1) if len(name) >= LONG else regex.escape(name, special_only=True)
        return part(words[:at], errors) + rf"(?<![^ ]){own}(?![^ ])" + part(words[at + len(name) :], errors)

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per notice, the stretches of the text in which it may stand, those that overlap as one."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for k, offset in places:
                words, _, errors, _ = self.notices[k]
                low = end + 1 - size - offset - errors
                high = low + len(words) + 2 * errors
                spans = found.setdefault(k, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                    spans[-1][0] = min(spans[-1][0], low)
                else:
                    spans.append([low, high])
        return found

    def matches(self, k: int, text: str, low: int, high: int) -> Iterator:
        """Matches of a notice between two places, from left to right; of those that overlap, the best."""
        words, _, errors, _ = self.notices[k]
        while m := self.first[k].search(text, low, high):
            best = self.fuzzy[k].search(text, m.start(), min(high, m.end() + len(words) + errors)) or m
            if sum(best.fuzzy_counts) > errors:  # the parts beside a name share the bound; another one may start within
                low = m.start() + 1
                continue
            if best.start() > m.start():
                yield from self.matches(k, text, m.start(), best.start())
            yield best
            low = best.end()

    def notices_in(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of verified matches in characters, one after the other in a window."""
        found = []
        for k, spans in self.windows(text).items():
            for low, high in spans:
                for m in self.matches(k, text, max(0, low), min(len(text), high)):
                    found.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
        return found

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(_TABLE).split()
        joined = b" ".join(words)
        n = len(words)
        base: list[tuple[int, str]] = []
        starts: list[int] | None = None

        def word_at(offset: int) -> int:
            nonlocal starts
            if starts is None:
                starts = [0, *accumulate(len(w) + 1 for w in words)]
            return bisect_right(starts, offset) - 1

        if any(m in joined for m in self.must):
            for pattern, _, label in self.base:
                base += [(word_at(m.start()), label) for m in pattern.finditer(joined)]
        text = joined.decode()
        spans, offsets = [], None
        best = 1.0 if base else 0.0
        for k, a, b, edits in self.notices_in(text):
            phrase, label, *_ = self.notices[k]
            agreement = 1 - edits / len(phrase)
            best = max(best, agreement)
            if len(text) != len(joined) and offsets is None:
                letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
                offsets = np.concatenate([[0], np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF))])
            first, last = (a, max(a, b - 1)) if offsets is None else (int(offsets[a]), int(offsets[max(a, b - 1)]))
            spans.append((label, word_at(first), word_at(last), edits, agreement))
        at = [i for i, _ in base]
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(s[0] for s in spans)})
        return n, len(base), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), best, spans


_scanners: dict[tuple, Scanner] = {}


def scan(df: DataFrame, text: str = "text", name: str = "scan", base=BASE, notices=NOTICES) -> DataFrame:
    """Adds a struct: n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first and last word, edits, agreement)."""
    bound_batches(df.sparkSession)
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("agreement", pa.float64())])
    fields = [
        pa.field("n_words", pa.int64()), pa.field("n_base", pa.int64()), pa.field("first_word", pa.int64()), pa.field("last_word", pa.int64()),
        pa.field("base_labels", pa.string()), pa.field("labels", pa.string()), pa.field("score", pa.float64()), pa.field("spans", pa.list_(span)),
    ]
    schema = (
        "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
        "spans:array<struct<label:string,first:bigint,last:bigint,edits:int,agreement:double>>>"
    )

    @F.arrow_udf(schema)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (base, notices)
        if key not in _scanners:
            _scanners[key] = Scanner(base, notices)
        scanner = _scanners[key]
        for batch in texts:
            rows = [scanner.scan(x.as_py()) for x in batch]
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            spans = [[dict(zip(("label", "first", "last", "edits", "agreement"), s)) for s in row] for row in columns[-1]]
            arrays = [pa.array(c, f.type) for c, f in zip((*columns[:-1], spans), fields)]
            yield pa.StructArray.from_arrays(arrays, fields=fields)

    return df.withColumn(free_name(df.columns, name), run.asNondeterministic()(utf8(text)))


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract of query 6 over any table with doc_id and text; ``spans`` follows."""
    return scan(docs.select("doc_id", "text")).select("doc_id", "scan.*")
