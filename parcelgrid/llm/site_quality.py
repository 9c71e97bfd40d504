"""Quality classifier with hierarchical empirical Bayes.

A linear classifier, fitted on a bounded sample of labelled rows, turns a text
into the log-odds of being good. Sites speak as well: labels and the
classifier's own expectations are added up per host and per path of a host.
A host's rate of good texts is shrunk towards the global rate, a path's rate
towards its host's, by as much as the spread between hosts (paths) allows, so
a site with few documents says little. The posterior odds of a document are
its own evidence times the odds of its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.llm.arrow import blocks, coded, texts, words
from parcelgrid.llm.common import if_small
from parcelgrid.session import durable

#: Labelled rows the classifier is fitted on, at most; the rest of the labels still counts in the site rates.
SAMPLE_ROWS = 20_000
#: Hashed word features beside the measured ones.
WORD_BINS = 512
_RUNS = re.compile(r"(.)\1{2,}")
MEASURES = ("log_words", "mean_word", "symbols", "capitals", "digits", "stops", "lines", "same_next", "distinct", "repeated_lines", "runs")


def features(column: pa.Array) -> np.ndarray:
    """rows x (measures and hashed words): shares and logs of the whole text; a text without words is all 0."""
    flat, at = words(column)
    codes, names = coded(flat)
    bins = np.fromiter((int.from_bytes(w.strip(".,;:!?").lower().encode()[-8:], "big") * 0x9E3779B97F4A7C15 >> 40 & (WORD_BINS - 1)
                        for w in names.to_pylist()), np.int64, len(names))
    out = np.zeros((len(column), len(MEASURES) + WORD_BINS), np.float32)
    for i, text in enumerate(column.to_pylist()):
        c = codes[at[i]: at[i + 1]]
        if not len(c):
            continue
        n, size = len(c), len(text)
        lines = [x for x in text.split("\n") if x.strip()]
        kinds = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, : len(MEASURES)] = (
            np.log1p(n), size / n / 10, np.isin(kinds, _SYMBOLS).sum() / size * 5, ((kinds >= 65) & (kinds <= 90)).sum() / size * 5,
            ((kinds >= 48) & (kinds <= 57)).sum() / size * 5, np.isin(kinds, _STOPS).sum() / n, np.log1p(len(lines)) / np.log1p(n),
            (c[1:] == c[:-1]).mean() if n > 1 else 0, np.log1p(len(np.unique(c))) / np.log1p(n),
            1 - len(set(lines)) / len(lines), len(_RUNS.findall(text)) / n)
        out[i, len(MEASURES):] = np.sqrt(np.bincount(bins[c], minlength=WORD_BINS) / n)
    return out


_SYMBOLS = np.array([ord(x) for x in "#*$%&|<>{}[]\\^~_=+@!"], np.uint32)
_STOPS = np.array([ord(x) for x in ".?!"], np.uint32)


def fitted(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """(weights, base rate) of a logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(rate / (1 - rate))
    if len(set(y.tolist())) < 2:
        return w, rate
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, rate


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the ``rows`` labelled documents with the smallest key hashes."""
    known = docs.select("doc_id", "text").join(labels.where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    # The share follows the labels that meet a document; twice the noise of its count above the rows wanted.
    share = min(1.0, (rows + 4 * rows ** 0.5) / max(1, known.select("doc_id").count()))
    cut = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=1 << 20):
            x = [r.tobytes() for r in features(texts(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    got = cut.mapInArrow(measure, "doc_id bigint, quality int, x binary").orderBy(F.xxhash64("doc_id")).limit(rows).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros((0, len(MEASURES) + WORD_BINS), np.float32)
    return x, np.array([r.quality for r in got], np.float64)


def evidence(docs: DataFrame, model: tuple[np.ndarray, float], carry: list[str]) -> DataFrame:
    """``carry`` columns and log_odds, the classifier's log-odds less those of its base rate."""
    weights, rate = model
    base = float(np.log(rate / (1 - rate)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=1 << 20):
            z = features(texts(b)).astype(np.float64) @ weights[:-1] + weights[-1] - base
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(np.clip(z, -30, 30))], [*carry, "log_odds"])

    return docs.select(*carry, "text").mapInArrow(score, f"{schema}, log_odds double")


def odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, *, base: float) -> tuple[DataFrame, tuple[int, float, float, float]]:
    """((_host, _path, n, good, host_n, host_good, host_rate, path_rate), (rows, their sum of _own, k_host, k_path)): shrunken rates of all paths.

    ``scored`` has _host, _path and _own: a row's label, or else the
    classifier's probability. A host's rate is worth ``k_path`` documents of
    each of its paths, the rate of all rows ``k_host`` of each host: weights
    found by moments, from the spread of the rates beyond what sampling alone
    would give, at least 1 (spread without bound) and at most 10,000 (a spread
    below 0.0001 counts as that). Two grouped sums; hot hosts combine before
    the shuffle.
    """
    paths = durable(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_own").alias("good")))
    hosts = durable(paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    whole = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("host_good"), F.lit(0.0)).alias("good")).first()
    rate = (whole.good + 1) / (whole.n + 2) if whole.n else base

    def weight(groups: DataFrame, n: str, good: str, centre: Column) -> float:
        """Documents the prior is worth: sampling variance over the variance between groups."""
        p = F.col(good) / F.col(n)
        m = groups.where(F.col(n) > 1).agg(
            F.sum(F.col(n) * (p - centre) ** 2).alias("ss"), F.sum(centre * (1 - centre)).alias("noise"), F.sum(n).alias("n")).first()
        if not m.n or m.ss is None:
            return 10.0
        between = max((m.ss - m.noise) / m.n, 1e-4)
        return float(min(1e4, max(1.0, rate * (1 - rate) / between)))

    k_host = weight(hosts, "host_n", "host_good", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host))
    joined = durable(paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).select(
        paths["_host"], "_path", "n", "good", "host_n", "host_good", "host_rate"))
    k_path = weight(joined, "n", "good", F.col("host_rate"))
    rates = durable(joined.withColumn("path_rate", (F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)))
    return rates, (whole.n, whole.good, k_host, k_path)


def classified(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "path", least: float = 0.5,
               sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, host, path, log_odds, host_rate, path_rate, quality_score, kept) of every row of ``docs``.

    ``docs`` has doc_id, text, ``host`` and ``path``, and any other columns;
    ``labels`` has doc_id and quality (0, 1 or null). host_rate and path_rate
    are those of the groups; the prior a row's score meets leaves the row
    itself out of its path, its host and the total, so its own label counts
    for the fitted classifier and the two prior weights only. Priors stay
    within 0.001 and 0.999. Null hosts and paths are groups of their own; a
    null or empty text has the evidence of an empty text; without labels the
    base rate is one half. Rows that repeat a doc_id are rows each, and of
    repeated labels the largest counts.
    """
    known = durable(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")))
    model = fitted(*sample(docs, known, sample_rows))
    base = model[1]
    named = docs.select("doc_id", "text", F.col(host).alias("_host"), F.col(path).alias("_path"))
    own = F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-(F.col("log_odds") + F.lit(float(np.log(base / (1 - base))))))))
    seen = durable(evidence(named, model, ["doc_id", "_host", "_path"]).join(known, "doc_id", "left").withColumn("_own", own).drop("quality"))
    rates, (rows, total, k_host, k_path) = posteriors(seen, base=base)
    near = if_small(rates)
    met = seen.join(near, seen["_host"].eqNullSafe(near["_host"]) & seen["_path"].eqNullSafe(near["_path"])).drop(near["_host"], near["_path"])
    rate = (F.lit(float(total)) - F.col("_own") + 1) / (rows + 1)
    of_host = (F.col("host_good") - F.col("_own") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    prior = (F.col("good") - F.col("_own") + k_path * of_host) / (F.col("n") - 1 + k_path)
    prior = F.least(F.greatest(prior, F.lit(0.001)), F.lit(0.999))
    score = 1 / (1 + F.exp(-(F.col("log_odds") + odds(prior))))
    return met.select("doc_id", F.col("_host").alias(host), F.col("_path").alias(path), F.round("log_odds", 6).alias("log_odds"),
                      F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"),
                      F.round(score, 6).alias("quality_score"), (score >= least).alias("kept"))
