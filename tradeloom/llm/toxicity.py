"""Toxicity by a weighted finite-state pattern grammar over clauses.

*Lexicon.* Insult stems are learned: whole words and word beginnings that stand in toxic rather than
in clean training texts, weighed by the lower bound of their log-odds. Learning reads at most
``SAMPLE`` toxic and ``SAMPLE`` clean labelled documents, those first in a seeded order.

*Transducers.* A text is cut into clauses. Each clause runs through small transducers that are
composed, each rewriting the token classes that the one before it puts out: ``negation`` marks an
insult that follows a negation within a few tokens, ``report`` marks what stands after a verb of
speech or inside quotes (which stay open from clause to clause, up to the end of the line), ``target`` marks an insult that has a person near it, ``threat`` joins a verb
of harm with a person after it. What comes out of the last one is the clause's weights by kind:
plain, targeted, negated, reported, threat. Words alone score nothing outside a matched clause.

*Score.* A logistic model, fitted on the same bounded sample and corrected for the true share of
toxic labels, turns the kinds' totals into the chance that a document is toxic.

Most texts hold no stem and no verb of harm; one pass of an automaton over the text finds that, and
the grammar runs on the others. The score reads nothing but the text. Rules: a null text is empty;
an empty text has the score of a text without matches; without toxic training labels every score
is zero.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import logistic
from tradeloom.llm.common import bound_batches, first_by_hash, free_name
from tradeloom.storage import materialize

#: Bounds of the fit: training documents of each label, stems, and beginnings of words in letters.
SAMPLE = 4000
STEMS = 4000
SHORTEST, LONGEST = 3, 8
LEAST_DOCUMENTS = 3
LEAST_WEIGHT = 1.5
THRESHOLD = 0.7
KINDS = ("plain", "targeted", "negated", "reported", "threat")

# Fixed word classes of the grammar, in several languages.
TARGETS = set(
    "you your yours yourself he him she her they them these those people everyone du dich dir ihr euch dein sie ihn "
    "tu te toi vous ils elles eux tú usted ustedes vosotros ellos ellas".split()
)
NEGATIONS = set("not no never nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split())
REPORTS = set("said says say called calls quoted wrote claimed sagte sagt nannte dit disait appelle dijo dice llamó".split())
THREATS = set("kill hurt destroy beat punish töten umbringen verletzen tuer frapper blesser matar golpear destruir".split())

#: A verb of speech after one of these reports nobody's words.
INFINITIVES = set("to zu à de".split())
OPENING, CLOSING = "“«", "”»"

CLAUSE = re.compile(r"[.!?;:|]+")
#: Words, contracted negations (n't) as one, and quotes.
TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+|[\"“”«»]")
CONTRACTED = re.compile(r"n['’]t$")
NOT_LETTERS = re.compile(r"[\W\d_]+")
REACH = 3


def training_terms(text: str) -> set[str]:
    """Whole words and beginnings (with a star) of a text, lower case."""
    out = set()
    for word in set(NOT_LETTERS.sub(" ", text.lower()).split()):
        out.add(word)
        out.update(word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


class Grammar:
    """The composed transducers for one lexicon of weighted stems."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        self.known: dict[str, tuple[str, float]] = {}
        automaton = ahocorasick.Automaton()
        for stem in stems:
            automaton.add_word(" " + (stem[:-1] if stem.endswith("*") else stem + " "), 1)
        for word in THREATS:
            automaton.add_word(f" {word} ", 1)
        automaton.make_automaton()
        self.find = automaton.iter

    def read(self, token: str) -> tuple[str, float]:
        """Class and weight of a token."""
        found = self.known.get(token)
        if found is None:
            starts = [token] + [token[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(token)) + 1)]
            weight = max((self.stems.get(s, 0.0) for s in starts), default=0.0)
            kind = (
                "insult" if weight > 0 else "target" if token in TARGETS else "negation" if token in NEGATIONS or CONTRACTED.search(token)
                else "report" if token in REPORTS else "harm" if token in THREATS else "infinitive" if token in INFINITIVES
                else "quote" if token == '"' else "open" if token in OPENING else "close" if token in CLOSING else "other"
            )
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[token] = (kind, weight)
        return found

    def clause(self, text: str, quoted: bool = False) -> tuple[list[tuple[str, float]], bool]:
        """The weights that the composed transducers put out for one clause, and whether quotes are open behind it."""
        tape = [self.read(t) for t in TOKEN.findall(text)]
        after = quoted
        for kind, _ in tape:
            after = quotes(after, kind)
        if not any(kind in ("insult", "harm") for kind, _ in tape):
            return [], after
        tape = report(negation(tape), quoted)
        for transducer in (target, threat):
            tape = transducer(tape)
        return [(kind, weight) for kind, weight in tape if kind in KINDS], after

    def totals(self, text: str) -> list[float]:
        """Weights by kind over all clauses of a text, and the number of clauses with any."""
        low = text.lower()
        sums = dict.fromkeys(KINDS, 0.0)
        matched = 0
        if next(self.find(f" {NOT_LETTERS.sub(' ', low)} "), None) is not None:
            for line in low.split("\n"):
                quoted = False  # a quote that is never closed ends with its line
                for part in CLAUSE.split(line):
                    found, quoted = self.clause(part, quoted)
                    matched += bool(found)
                    for kind, weight in found:
                        sums[kind] += weight
        return [sums[k] for k in KINDS] + [float(matched)]


def quotes(quoted: bool, kind: str) -> bool:
    """Whether quotes are open after a token."""
    return not quoted if kind == "quote" else kind == "open" or (quoted and kind != "close")


def negation(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """insult -> negated, while a negation is at most ``REACH`` tokens back."""
    state, out = 0, []
    for kind, weight in tape:
        state = REACH + 1 if kind == "negation" else max(0, state - 1)
        out.append(("negated" if kind == "insult" and state else kind, weight))
    return out


def report(tape: list[tuple[str, float]], quoted: bool = False) -> list[tuple[str, float]]:
    """insult -> reported, after a verb of speech or between quotes, which may be open from the clause before."""
    spoken, last, out = False, "", []
    for kind, weight in tape:
        spoken = spoken or (kind == "report" and last != "infinitive")
        quoted, last = quotes(quoted, kind), kind
        out.append(("reported" if kind == "insult" and (spoken or quoted) else kind, weight))
    return out


def target(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """insult -> targeted, if a person stands within ``REACH`` tokens on either side; else plain."""
    people = [i for i, (kind, _) in enumerate(tape) if kind == "target"]
    out = []
    for i, (kind, weight) in enumerate(tape):
        if kind == "insult":
            kind = "targeted" if any(abs(i - j) <= REACH for j in people) else "plain"
        out.append((kind, weight))
    return out


def threat(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """harm -> threat, if a person stands at most ``REACH`` tokens after it."""
    out = []
    for i, (kind, weight) in enumerate(tape):
        if kind == "harm" and any(k == "target" for k, _ in tape[i + 1 : i + 1 + REACH]):
            kind, weight = "threat", 1.0
        out.append((kind, weight))
    return out


def model_inputs(totals: np.ndarray) -> np.ndarray:
    """Inputs of the logistic model: whether anything matched, and the kinds' totals on a log scale."""
    logs = np.log1p(totals)
    return np.column_stack([totals[:, :-1].sum(axis=1) > 0, logs]).astype(np.float64)


def held_out(ids: Column) -> Column:
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Stems with weights and the coefficients over ``model_inputs``."""

    def __init__(self, stems: dict[str, float], beta: list[float]):
        self.stems, self.beta = stems, beta


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(training_terms(text or ""))
    terms = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(terms), 100_000):
        part = terms[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), *(pa.array([counts[k][t] for t in part], pa.int64()) for k in (1, 0))], names=["term", "a", "b"]
        )


def training_rows(docs: DataFrame, labels: DataFrame, ids: str, text: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Distinct training texts with labels, and how many labelled training rows there are of either kind."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = None
    for kind in (0, 1):
        part = first_by_hash(usable.filter(F.col("toxic") == kind), sample, 11, "doc_id")
        chosen = part if chosen is None else chosen.union(part)
    chosen = materialize(chosen, "toxic-chosen")  # at most twice ``sample`` ids
    rows = docs.select(F.col(f"`{ids}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return materialize(rows, "toxic-training"), counts


def fit(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    bound_batches(docs.sparkSession)
    rows, counts = training_rows(docs, labels, ids, text, sample)
    found = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)
    if not n1:
        return Model({}, [-30.0] + [0.0] * (len(KINDS) + 2))
    terms = rows.select("text", "toxic").mapInArrow(_count_terms, "term string, a bigint, b bigint")
    terms = terms.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= LEAST_DOCUMENTS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    weight = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)) - F.sqrt(1 / a + 1 / b)
    best = terms.withColumn("w", weight).filter(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc(F.col("w") * F.log1p("a")), "term").limit(STEMS)
    stems = {r["term"]: r["w"] for r in best.collect()}
    texts = totals(rows, "text", stems, "m").select("toxic", "m").collect()  # at most twice ``sample`` short rows
    x, y = model_inputs(np.array([r["m"] for r in texts])), np.array([r["toxic"] for r in texts])
    beta = logistic.fit(x, y, ridge=0.05)
    if n0:  # the sample takes both labels by number, not by their share
        beta[0] += np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1)) - np.log(n1 / n0)
    return Model(stems, beta.tolist())


_grammars: dict[int, Grammar] = {}


def _grammar(mark: int, stems: dict[str, float]) -> Grammar:
    if mark not in _grammars:
        _grammars.clear()
        _grammars[mark] = Grammar(stems)
    return _grammars[mark]


def totals(df: DataFrame, text: str, stems: dict[str, float], name: str) -> DataFrame:
    """Adds the grammar's totals (kinds, matched clauses) as an array."""
    mark = hash(frozenset(stems.items()))
    shipped = df.sparkSession.sparkContext.broadcast(stems)  # at most ``STEMS`` of them

    @F.arrow_udf("array<double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grammar = _grammar(mark, shipped.value)
        for batch in texts:
            yield pa.array([grammar.totals(x.as_py() or "") for x in batch], pa.list_(pa.float64()))

    return df.withColumn(name, run.asNondeterministic()(F.col(f"`{text}`").cast("string")))


def with_score(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """Adds the chance that a text is toxic."""
    bound_batches(docs.sparkSession)
    m = free_name(docs.columns, "grammar")
    out = totals(docs, text, model.stems, m)
    parts = [F.col(m)[i] for i in range(len(KINDS) + 1)]
    any_match = F.when(sum(parts[1:-1], parts[0]) > 0, 1.0).otherwise(0.0)
    inputs = [any_match] + [F.log1p(p) for p in parts]
    odds = F.lit(model.beta[0])
    for b, x in zip(model.beta[1:], inputs):
        odds = odds + F.lit(b) * x
    return out.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))).drop(m)


def op4(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of query 4 over any tables like documents and labels."""
    model = fit(docs, labels)
    out = with_score(docs.select("doc_id", "text"), model, "text", "score").drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that score below the threshold; columns as they were."""
    score = free_name(docs.columns, "score")
    out = with_score(docs, fit(docs, labels, ids, text), text, score)
    return out.filter(F.col(score) < THRESHOLD).drop(score)
