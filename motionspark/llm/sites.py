"""Operator 4: quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on a dozen text statistics gives each document its own evidence. Labels and classifier
probabilities are then summed by host and by path; each host's rate is shrunk toward the global rate and each path's rate
toward its host's, with a strength that grows as groups are alike (method of moments). The document's log odds and the
shift that its path's posterior brings are added; for that the posteriors are taken without the document itself, which
would else be counted twice.

The classifier is fitted on at most ``FIT_ROWS`` labelled documents (lowest hashes of id, statistics and label; rows
that repeat all three count once there); the rates come from all
documents. Sums are taken before the shuffle, so a host with a third of all documents is one row from each task.

Edge cases: a null text has the statistics of an empty one; a null host or path is a group of its own; without labels of
both kinds all documents get the probability 0.5 and are kept; repeated rows count as often as they come; an empty table
gives no rows; a document labelled twice with different values takes the lower; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import lowest_hashes, materialise, small_batches

FIT_ROWS = 20_000
#: Weight of a classifier probability against a label in the sums.
SOFT = 0.2
#: Probability from which a document is kept.
KEEP = 0.3
MAX_STRENGTH = 10_000.0
FEATURES = ("log_words", "symbols", "upper", "marks", "word_length", "same_lines", "digits", "same_words", "letters", "bars")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = max(1, len(words)), max(1, len(text))
    count = lambda chosen: len(raw) - len(raw.translate(None, chosen))
    upper, lower = count(bytes(range(65, 91))), count(bytes(range(97, 123)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(len(words)), count(b"#*$%&<>") / n, upper / chars, count(b"!?") / n, len(text) / n / 10, 1 - len(set(lines)) / max(1, len(lines)),
        count(b"0123456789") / chars, 1 - len(set(words)) / n, (upper + lower) / chars, raw.count(b"|") / n,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features; weights (intercept first), means and spreads."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, spread


def strength_of(groups: DataFrame, prior: Column) -> float:
    """The strength of the prior over ``groups`` (n, k and the prior's column), estimated from all of them by the method of
    moments: prior variance over the variance between groups that sampling doesn't explain."""
    rate = F.col("k") / F.col("n")
    moments = groups.agg(
        F.sum(F.col("n") * prior * (1 - prior)).alias("v"), F.sum(F.col("n") * (rate - prior) * (rate - prior)).alias("between"), F.sum(prior * (1 - prior)).alias("noise"), F.sum("n").alias("n")
    ).first()
    strength = MAX_STRENGTH
    if moments["n"]:
        extra = (moments["between"] - moments["noise"]) / moments["n"]
        spread = moments["v"] / moments["n"]
        strength = min(MAX_STRENGTH, max(1.0, spread / extra - 1)) if extra > 1e-9 else MAX_STRENGTH
    return float(strength)


def posterior(k: Column, n: Column, prior: Column, strength: float) -> Column:
    return (k + F.lit(strength) * prior) / (n + F.lit(strength))


def shrunk(groups: DataFrame, keys: list[str], prior: Column, out: str) -> DataFrame:
    """``groups`` (n, k and the prior's column) with the posterior rate ``out``."""
    return groups.withColumn(out, posterior(F.col("k"), F.col("n"), prior, strength_of(groups, prior)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = FIT_ROWS, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path, p_text, p_host, p_path, p_good and kept of every document."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))

    def measure(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])

    rows = materialise(source.mapInArrow(measure, "doc_id long, host string, path string, x array<double>"), "statistics")
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    marked = materialise(rows.join(known, "doc_id", "left"), "marked")
    sample = lowest_hashes(marked.filter("y is not null"), ["doc_id", "x", "y"], fit_rows).collect()  # bounded by fit_rows
    y = np.array([r["y"] for r in sample], float)
    if not len(y) or y.min() == y.max():
        half = F.lit(0.5)
        return marked.select("doc_id", "host", "path", half.alias("p_text"), half.alias("p_host"), half.alias("p_path"), half.alias("p_good"), F.lit(True).alias("kept"))
    w, mean, spread = fit_logistic(np.array([r["x"] for r in sample]), y)
    odds = F.lit(float(w[0] - (w[1:] * mean / spread).sum()))
    for k in range(len(FEATURES)):
        odds = odds + F.lit(float(w[1 + k] / spread[k])) * F.col("x")[k]
    odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))
    scored = marked.select("doc_id", "host", "path", "y", odds.alias("odds"), (1 / (1 + F.exp(-odds))).alias("p_text"))
    scored = scored.withColumn("n_own", F.when(F.col("y").isNull(), SOFT).otherwise(1.0))
    scored = scored.withColumn("k_own", F.col("n_own") * F.coalesce(F.col("y").cast("double"), F.col("p_text")))
    paths = materialise(scored.groupBy("host", "path").agg(F.sum("n_own").alias("n"), F.sum("k_own").alias("k")), "paths")
    whole = paths.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    rate = min(1 - 1e-6, max(1e-6, whole["k"] / whole["n"]))
    every = F.lit(rate)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    host_strength = strength_of(hosts, every)
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), F.col("k").alias("k_host"), posterior(F.col("k"), F.col("n"), every, host_strength).alias("p_host"))
    sites = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    path_strength = strength_of(sites, F.col("p_host"))
    sites = sites.withColumn("p_path", posterior(F.col("k"), F.col("n"), F.col("p_host"), path_strength)).withColumnsRenamed({"host": "h", "path": "p"})
    logit = lambda p: F.log(p / (1 - p))
    judged = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    without = lambda k, n, prior, strength: posterior(F.greatest(F.lit(0.0), F.col(k) - F.col("k_own")), F.greatest(F.lit(0.0), F.col(n) - F.col("n_own")), prior, strength)
    others = without("k", "n", without("k_host", "n_host", every, host_strength), path_strength)
    judged = judged.withColumn("p_good", 1 / (1 + F.exp(-(F.col("odds") + logit(others) - F.lit(math.log(rate / (1 - rate)))))))
    six = [F.round(c, 6).alias(c) for c in ("p_text", "p_host", "p_path", "p_good")]
    return judged.select("doc_id", "host", "path", *six, (F.round("p_good", 6) >= keep).alias("kept"))
