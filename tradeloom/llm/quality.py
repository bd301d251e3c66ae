"""Quality classifier by hierarchical empirical Bayes.

Three levels of evidence are combined for a document: what its text looks like (a logistic
classifier over a few shares), what the documents of its host look like, and what those of its path
on the host look like.

*Text.* Shares that need no language: words that end in runs of symbols, lone punctuation, a word
repeated at once, distinct words, capitals, length. The classifier is fitted on at most ``SAMPLE``
labelled rows (those first in a seeded order); nothing else is sampled.

*Sites.* The chance of every document to be of low quality is added up by host and path. The
posterior of a host is the Beta-Binomial mean that pulls its share towards the global share with the
strength that the spread between hosts shows (method of moments); a path is pulled towards its host
in the same way. So a site with few documents says little more than the level above it. A
document's own chance is left out of what its site says about it.

*Posterior.* The log-odds of the text, moved by how far the log-odds of the path lie from the global
ones, at most by ``MOST_SHIFT``, so that a site never outweighs a clear text.

Sums are grouped, so a hot host is combined before the shuffle; the table of sites is joined by
its measured size. Rules: a null text is empty; null hosts and paths are sites of their own; without
labels of both kinds every document is kept.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import logistic
from tradeloom.llm.common import bound_batches, first_by_hash, utf8
from tradeloom.storage import materialize

SAMPLE = 20_000
MOST_SHIFT = 1.5
FEATURES = ("symbols", "lone", "repeats", "distinct", "capitals", "length", "bangs")

_SPACE = b"\t\n\x0b\x0c\r "
_CLASS = bytes(
    32 if c in _SPACE else ord("a") if c >= 128 or chr(c).isalnum() else ord("!") if c == ord("!") else ord("p") for c in range(256)
)
_CAPITALS = bytes(range(65, 91))


def features_of(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    kinds = b" " + b" ".join(text.translate(_CLASS).split()) + b" "
    marks = kinds.replace(b"!", b"p")
    return [
        marks.count(b"pp ") / n,
        marks.count(b" p ") / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n,
        (len(text) - len(text.translate(None, _CAPITALS))) / len(text),
        float(np.log1p(n)),
        kinds.count(b"!! ") / n,
    ]


def with_features(df: DataFrame, text: str, name: str) -> DataFrame:
    bound_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def shares(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([features_of(x.as_py()) for x in batch], pa.list_(pa.float64()))

    return df.withColumn(name, shares.asNondeterministic()(utf8(text)))


def _log_odds(features: Column, beta: list[float]) -> Column:
    parts = [F.lit(beta[0])] + [F.lit(b) * F.element_at(features, i + 1) for i, b in enumerate(beta[1:])]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _site(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def fit(marked: DataFrame, labels: DataFrame, ids: str, sample: int = SAMPLE) -> list[float]:
    """Coefficients for low quality; ``marked`` has the ids and ``f``; labels has doc_id and quality."""
    labels = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    labels = first_by_hash(labels, sample, 7, "doc_id", "quality")
    rows = marked.join(labels, marked[ids] == labels.doc_id).select("f", "quality", F.xxhash64(F.lit(7), "doc_id").alias("o"))
    rows = rows.orderBy("o", "f").limit(sample).collect()  # at most ``sample`` short rows
    if not rows:
        return [-30.0] + [0.0] * len(FEATURES)
    x, y = np.array([r["f"] for r in rows]), np.array([1 - r["quality"] for r in rows])
    if not y.any():
        return [-30.0] + [0.0] * len(FEATURES)
    return logistic.fit(x, y, ridge=0.02).tolist()


def site_table(chances: DataFrame) -> DataFrame:
    """Per (host, path): sums and the strengths of both levels; from (host, path, p)."""
    paths = chances.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p").alias("s_path"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    everything = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s"), F.count("*").alias("k")).first()
    n, mean = everything["n"] or 0, (everything["s"] or 0.0) / max(1, everything["n"] or 0)
    spread = hosts.agg(F.sum(F.col("n_host") * (F.col("s_host") / F.col("n_host") - mean) ** 2)).first()[0] or 0.0
    both = paths.join(hosts, "host")
    within = both.agg(
        F.sum(F.col("n_path") * (F.col("s_path") / F.col("n_path") - F.col("s_host") / F.col("n_host")) ** 2).alias("v"), F.count("*").alias("k")
    ).first()

    def strength(squares: float, groups: int) -> float:
        noise = mean * (1 - mean)
        between = max((squares - noise * groups) / max(1, n), noise * 1e-4, 1e-9)
        return float(min(max(noise / between - 1, 2.0), 1e4))

    a, b = strength(spread, everything["k"]), strength(within["v"] or 0.0, within["k"])
    return materialize(
        both.withColumns({"mean": F.lit(float(mean)), "host_strength": F.lit(a), "path_strength": F.lit(b)}), "quality-sites"
    )


def posterior(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds host_posterior, path_posterior and score (chance of high quality) to rows with host, path, l."""
    p = _chance(F.col("l"))
    clip = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    rows = rows.join(sites, ["host", "path"])
    host = clip((F.col("host_strength") * F.col("mean") + F.col("s_host") - p) / (F.col("host_strength") + F.col("n_host") - 1))
    rows = rows.withColumn("host_posterior", host)
    path = clip((F.col("path_strength") * F.col("host_posterior") + F.col("s_path") - p) / (F.col("path_strength") + F.col("n_path") - 1))
    rows = rows.withColumn("path_posterior", path)
    logit = lambda c: F.log(c / (1 - c))
    shift = logit(F.col("path_posterior")) - logit(clip(F.col("mean")))
    shift = F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), shift))
    return rows.withColumn("score", 1 - _chance(F.col("l") + shift))


def score(docs: DataFrame, labels: DataFrame, ids: str, text: str, host: str, path: str, extra: list[str]) -> DataFrame:
    """(host, path, l, f and the columns ``extra``) joined with what their sites say: see ``posterior``."""
    base = docs.select(
        *[F.col(f"`{c}`") for c in extra],
        F.col(f"`{ids}`").alias("the_id"),
        F.col(f"`{text}`").cast("string").alias("the_text"),
        _site(F.col(f"`{host}`")).alias("host"),
        _site(F.col(f"`{path}`")).alias("path"),
    )
    slim = base.select("the_id", "host", "path", "the_text")
    marked = materialize(with_features(slim, "the_text", "f").drop("the_text"), "quality-features")
    beta = fit(marked, labels, "the_id")
    chances = marked.select("host", "path", _chance(_log_odds(F.col("f"), beta)).alias("p"))
    sites = site_table(chances)
    if extra:  # features are cheap: they are read off the texts again rather than shuffled with them
        rows = with_features(base, "the_text", "f").drop("the_text", "the_id")
    else:
        rows = marked
    return posterior(rows.withColumn("l", _log_odds(F.col("f"), beta)), sites)


def op3(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (chance of high quality), both posteriors and the decision; host is the source, path its language."""
    out = score(docs.select("doc_id", "text", "source", "lang"), labels, "doc_id", "text", "source", "lang", [])
    return out.select(
        F.col("the_id").alias("doc_id"), "score", "host_posterior", "path_posterior", (F.col("score") >= 0.5).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """Documents whose score is at least one half; columns as they were."""
    kept = docs.columns
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = score(plain, labels, names[ids], names[text], names[host], names[path], list(names.values()))
    return out.filter("score >= 0.5").select(*[F.col(n).alias(c) for c, n in names.items()])
