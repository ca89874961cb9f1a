"""Quality scores by positive-unlabelled learning.

Trusted positives are the documents labelled 1; the unlabelled sample is drawn from all documents. Labels of 0 are not
used. A small network on text statistics minimises the non-negative unbiased risk: prior * R+(positives) + max(0,
R-(unlabelled) - prior * R-(positives)), with the logistic loss. The class prior comes from the same two samples: one half of
each trains a network to tell positives from unlabelled rows, and among the other halves the prior is the least share of
unlabelled rows to positives above a score, at the score where that share is known best (best bin estimation). It is held
between 0.02 and 0.98, where the risk stays defined.

Null texts count as empty and get a score like any other. Repeated rows stay separate rows. With no positive or no
unlabelled row there is nothing to learn from and every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import gram_hashes, slices, split_of, word_hashes

#: Rows that the classifier may be fitted on (positives, unlabelled): it sees no more of them, whatever the input.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 6_000, 9_000
HIDDEN, ROUNDS, STEP, DECAY = 24, 500, 0.02, 1e-4
#: Rounds of the network that only ranks rows for the prior, and the doubt that its bounds allow.
PRIOR_ROUNDS, DOUBT = 150, 0.1

CLASSES = np.zeros(256, dtype=np.int64)  # of bytes, for the counts below
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"#$%&*@^~", b"|<>{}[]\\", b".,;:", b"\n", b" \t\r\x0b\x0c"), 1):
    for _c in _chars:
        CLASSES[_c] = _k
CLASSES[128:] = 10
N_FEATURES = 11 + 13


def distinct_share(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 1.0


def features(text: str | None) -> np.ndarray:
    """Statistics of one text: shares of byte classes, words, repetition and lines."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES)
    if not raw:
        out[-1] = 1.0
        return out
    data = np.frombuffer(raw, dtype=np.uint8)
    kinds = CLASSES[data]
    out[:11] = np.bincount(kinds, minlength=11) / len(raw)
    words, starts, ends = word_hashes(raw)
    lines = np.array([hash(x) for x in raw.split(b"\n") if x], dtype=np.int64)
    n = len(words)
    if n:
        lengths = ends - starts
        tails, heads = kinds[ends - 1], kinds[starts]
        counts = np.unique(words, return_counts=True)[1]
        grams = gram_hashes(words, 5)
        out[11:21] = (
            lengths.mean() / 10, min(lengths.std() / 10, 3), len(counts) / n * np.log1p(n) / 5, counts.max() / n, (words[1:] == words[:-1]).mean() if n > 1 else 0.0,
            np.isin(tails, (3, 4, 5)).mean() if n else 0.0, (heads == 1).mean(), (lengths == 1).mean(), distinct_share(grams), (lengths > 25).mean(),
        )
    out[21] = np.log1p(n) / 8
    out[22] = distinct_share(lines)
    return out


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer of tanh units on standardised features."""

    def __init__(self, mean, scale, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.weights = [rng.normal(0, 0.3, (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        return z, h, h @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x)[2])


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled scores: the least ratio of the two tails, where its upper bound is lowest."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = lambda x: 1.0 - np.searchsorted(np.sort(x), cuts) / len(x)
    p, u = np.maximum(above(positive), 1e-9), above(unlabelled)
    slack = np.sqrt(np.log(4 / DOUBT) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / DOUBT) / 2 / len(positive))
    at = int(np.argmin(u / p + slack / p))
    return float(u[at] / p[at])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from positives and unlabelled rows alone."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(11)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    net = fit(halves[0][0], halves[1][0], None, PRIOR_ROUNDS)
    return min(max(best_bin_prior(net.score(halves[0][1]), net.score(halves[1][1])), 0.02), 0.98)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int = ROUNDS) -> Network:
    """Minimises the non-negative risk by Adam on the whole sample; without a prior, tells the two samples apart."""
    every = np.vstack([positive, unlabelled])
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    n_p = len(positive)
    for t in range(1, rounds + 1):
        z, h, f = net.forward(every)
        p = sigmoid(f)
        if prior is None:
            g = np.concatenate([(p[:n_p] - 1.0) / n_p, p[n_p:] / (len(every) - n_p)])
        else:
            g = risk_gradient(f, p, n_p, prior)
        back = np.outer(g, net.weights[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * net.weights[0], back.sum(axis=0), h.T @ g + DECAY * net.weights[2], np.array([g.sum()])]
        for k, gr in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gr
            v[k] = 0.999 * v[k] + 0.001 * gr * gr
            net.weights[k] = net.weights[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def risk_gradient(f: np.ndarray, p: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk by the rows' outputs; the first n_p rows are the positives."""
    loss_negative = np.logaddexp(0, f)  # loss of calling a row negative, as if it were positive's opposite
    negative_part = loss_negative[n_p:].mean() - prior * loss_negative[:n_p].mean()
    g = np.zeros(len(f))
    if negative_part >= 0:
        g[:n_p] = (prior * (p[:n_p] - 1.0) - prior * p[:n_p]) / n_p
        g[n_p:] = p[n_p:] / (len(f) - n_p)
    else:  # the estimate of the negatives' risk went below zero: step back on it alone
        g[:n_p] = prior * p[:n_p] / n_p
        g[n_p:] = -p[n_p:] / (len(f) - n_p)
    return g


def learn(docs: DataFrame, labels: DataFrame, learnable) -> Network | float:
    """A network fitted on bounded samples (the rows with the smallest hashes of their ids), or 0.5 without a sample."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1)).select(F.col("doc_id").cast("long")).where(learnable)
    ids = docs.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    order = (F.xxhash64("doc_id"), "doc_id")
    # labels may name documents that this table no longer has: the sample is taken from those that it has
    positive = known.join(ids, "doc_id", "left_semi").distinct().orderBy(*order).limit(SAMPLE_POSITIVE)
    unlabelled = ids.where(learnable).orderBy(*order).limit(SAMPLE_UNLABELLED)
    picked = positive.withColumn("kind", F.lit(1)).unionByName(unlabelled.withColumn("kind", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["kind", "x"])

    # at most the two sample sizes, so its size is bounded whatever the input
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select("kind", "text").mapInArrow(run, "kind int, x array<double>").collect()
    p, u = (np.array([r["x"] for r in sample if r["kind"] == k]).reshape(-1, N_FEATURES) for k in (1, 0))
    if not len(p) or not len(u):
        return 0.5
    p, u = p[np.lexsort(p.T)], u[np.lexsort(u.T)]
    return fit(p, u, class_prior(p, u))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    learnable = split_of(folds=3) != 1
    net = learn(docs, labels, learnable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            s = np.full(len(x), net) if isinstance(net, float) else net.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(split_of(folds=3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns that they came with."""
    net = learn(docs, labels, split_of(folds=3) != 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            x = matrix(batch.column(batch.schema.get_field_index("text")).to_pylist())
            s = np.full(len(x), net) if isinstance(net, float) else net.score(x)
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
