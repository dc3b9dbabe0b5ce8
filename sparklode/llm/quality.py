"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier on a document's own form gives its evidence. Hosts and paths add what is known of the other documents
there: their labels, and where they have none their evidence, shrunk to the level above by a strength that the
spread between sites itself gives (moments of grouped sums). A document takes no part in its own site's posterior.
How far a site's log-odds count beside the evidence is fitted on the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.llm.common import Scratch, keyed_texts, smallest_hashes

#: Labelled rows that the classifier is fitted on, those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000

#: Sites up to which their posteriors are broadcast; more are joined by shuffle.
BROADCAST_SITES = 100_000

FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "repeated_lines", "short_lines", "distinct_words", "ends_stop", "repeated_words", "spaces"]

_SYMBOL, _UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True


def form(text: bytes) -> list[float]:
    """A text's features; of an empty text all zero."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    buf = np.frombuffer(text, np.uint8)
    counts = np.bincount(buf, minlength=256)
    n, n_words = len(text), len(words)
    lines = [s for line in text.split(b"\n") if (s := line.strip())]
    n_lines = max(1, len(lines))
    return [
        float(np.log1p(n_words)),
        (n - n_words) / n_words / 10,
        float(counts[_SYMBOL].sum()) / n,
        float(counts[_UPPER].sum()) / n,
        float(counts[_DIGIT].sum()) / n,
        1 - len(set(lines)) / n_lines,
        sum(b" " not in line for line in lines) / n_lines,
        len(set(words)) / n_words**0.75,
        sum(line.endswith((b".", b"!", b"?", b":")) for line in lines) / n_lines,
        sum(map(bytes.__eq__, words[1:], words)) / n_words,
        (counts[32] + 1) / n_words,
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [form(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression on the raw features (the last one is the constant), by Newton's method."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, keep = np.zeros(z.shape[1]), np.diag([*[ridge * max(1, len(x)) ** 0.5 + 1e-3] * x.shape[1], 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + keep @ w
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + keep, g)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    out = np.append(w[:-1] / scale, w[-1])
    out[-1] -= (w[:-1] / scale * mean).sum()
    return out


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior rows that a site's mean is worth: within-site variance over between-site variance, by moments.

    groups: n, s (sum of probabilities), s2 (sum of squares) and the mean of the level above.
    """
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2).alias("between")).first()
    if not r["n"] or r["n"] <= r["k"]:
        return 100.0
    inside = max(1e-9, r["within"] / (r["n"] - r["k"]))
    spread = (r["between"] - r["k"] * inside) / r["n"]
    return float(min(10_000.0, max(1.0, inside / spread))) if spread > 0 else 10_000.0


def score_quality(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, host, path, evidence (the document's own probability), site (its site's posterior), score, keep (score >= 0.5).

    documents: doc_id, text, source (the host), lang (the path below it); labels: doc_id, quality (1 good, 0 bad); other columns are left
    out. Null sources and languages are sites of their own. An empty text has the evidence of an
    empty form. Rows without doc_id are left out, rows that repeat a doc_id count once, with the smallest
    text, source and language; labels that contradict one another, or are null, teach nothing. Without labels of both kinds
    the evidence is 0.5 for all, and all are kept.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "quality")
    docs = keyed_texts(documents, "doc_id", "text")
    x = features(docs)
    sites = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("path")).filter("doc_id is not null")
    sites = sites.groupBy("doc_id").agg(F.min("host").alias("host"), F.min("path").alias("path"))
    x = scratch.table(x.join(sites, "doc_id"), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1").select("doc_id", "y")
    chosen = scratch.table(smallest_hashes(marks.join(x.select("doc_id"), "doc_id"), "doc_id", train_rows), "chosen")
    sample = x.join(chosen, "doc_id").select("x", "y").collect()
    y = np.array([r["y"] for r in sample], float)
    w = fit(np.array([r["x"] for r in sample], float), y) if 0 < y.sum() < len(y) else None
    if w is None:
        p = F.lit(0.5)
    else:
        logit = F.lit(float(w[-1]))
        for i, c in enumerate(w[:-1]):
            logit = logit + F.lit(float(c)) * F.col("x")[i]
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    # what a document says for its site: its label if it has one
    scored = x.select("doc_id", "host", "path", p.alias("p")).join(marks, "doc_id", "left").withColumn("v", F.coalesce(F.col("y").cast("double"), F.col("p"))).drop("y")
    paths = scratch.table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2")), "paths")
    total = paths.agg(F.sum("s") / F.sum("n"), F.count("*")).first()
    m = min(0.999, max(0.001, total[0] if total[0] is not None else 0.5))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).withColumn("m", F.lit(m))
    k_host = _strength(hosts, "m")
    hosts = hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host"))
    paths = paths.join(hosts, "host")
    k_path = _strength(paths.withColumn("h", (F.col("s_host") + k_host * m) / (F.col("n_host") + k_host)), "h")
    small = F.broadcast if total[1] <= BROADCAST_SITES else (lambda df: df)
    above = (F.col("s_host") - F.col("v") + k_host * m) / (F.col("n_host") - 1 + k_host)
    site = (F.col("s") - F.col("v") + k_path * above) / (F.col("n") - 1 + k_path)
    bound = lambda c, least: F.least(F.lit(1 - least), F.greatest(F.lit(least), c))
    odds = lambda c: F.log(c / (1 - c))
    joined = scored.join(small(paths.drop("s2")), ["host", "path"]).withColumn("site", bound(site, 0.001))
    joined = joined.select("doc_id", "host", "path", "p", "site", odds(bound(F.col("p"), 1e-12)).alias("own"), (odds(F.col("site")) - float(np.log(m / (1 - m)))).alias("shift"))
    if w is None:
        score = F.lit(0.5)
    else:
        seen = joined.join(chosen, "doc_id").select("own", "shift", "y").collect()
        a, b, c = fit(np.array([[r["own"], r["shift"]] for r in seen], float), np.array([r["y"] for r in seen], float)).tolist()
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("own") + b * F.col("shift") + c))))
    return joined.select("doc_id", "host", "path", F.col("p").alias("evidence"), "site", score.alias("score")).withColumn("keep", F.col("score") >= 0.5)
