"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of terms of the inner product of their factors)

Pairs catch what no single term says, such as an insult together with a mention of a group. The machine is fitted on
a bounded sample of labelled documents and has weights and factors for every hashed term there. A term enters with a
value between ``least_value`` and 1 that grows with how well it tells the labels apart by itself: so the many terms that say
nothing make little noise, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import lower_words, text_or_empty

BUCKETS = 1 << 22
STRIP = b".,!?;:\"'()[]{}#*$%&|<>-_"
#: Words whose term a task remembers; the memory starts anew beyond this.
KNOWN_WORDS = 300_000


class _Terms(dict):
    """Word -> hashed term of the word without the marks around it, or its number among known terms (-1: unknown)."""

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.number = None if known is None else {int(t): i for i, t in enumerate(known)}

    def __missing__(self, word: bytes) -> int:
        import zlib

        if len(self) > KNOWN_WORDS:
            self.clear()
        term = zlib.crc32(word.strip(STRIP)) % BUCKETS
        if self.number is not None:
            term = self.number.get(term, -1)
        self[word] = term
        return term


def terms_of(text: str, known: dict) -> np.ndarray:
    return np.unique(np.fromiter(map(known.__getitem__, words := lower_words(text)), np.int64, len(words)))


class Machine:
    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    def logit(self, numbers: np.ndarray) -> float:
        rows = self.factors[numbers]
        summed = rows.sum(axis=0)
        return float(self.bias + self.weights[numbers].sum() + 0.5 * (summed @ summed - (rows * rows).sum()))


def term_values(lists: list[np.ndarray], labels: np.ndarray, strength: float, least_value: float) -> tuple[np.ndarray, np.ndarray]:
    """All terms, ascending, and their values by their log-likelihood-ratio statistic g against the labels: least_value + (1 - least_value) * (g / (g + strength)) ** 2."""
    terms, at = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_inverse=True)
    doc_label = np.repeat(labels, [len(x) for x in lists])
    seen, bad = np.bincount(at, minlength=len(terms)).astype(float), np.bincount(at, doc_label, len(terms))
    n, positive = len(lists), labels.sum()
    g = np.zeros(len(terms))
    for got, of in ((bad, positive), (seen - bad, n - positive)):
        for observed, expected in ((got, seen * of / n), (of - got, (n - seen) * of / n)):
            g += 2 * np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)
    g = np.maximum(g, 0)
    return terms, least_value + (1 - least_value) * (g / (g + strength)) ** 2


def train(
    lists: list[np.ndarray], labels: np.ndarray, rank: int = 6, epochs: int = 20, rate: float = 0.1, decay: float = 1e-3, strength: float = 8.0, least_value: float = 0.05, seed: int = 7
) -> Machine:
    """Adaptive gradient steps over shuffled documents; weights and factors are pulled to zero. The terms' values end up in the weights and factors."""
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1.0)
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    terms, values = term_values(lists, labels, strength, least_value)
    rows = [np.searchsorted(terms, x) for x in lists]
    rng = np.random.default_rng(seed)
    share = labels.mean()
    bias, weights, factors = float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), rank))
    g_bias, g_weights, g_factors = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), rank), 1e-2)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(len(rows)):
            x = rows[d]
            value = values[x]
            own = factors[x] * value[:, None]
            summed = own.sum(axis=0)
            z = bias + weights[x] @ value + 0.5 * (summed @ summed - (own * own).sum())
            error = 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) - labels[d]
            g_bias += error**2
            bias -= step * error / np.sqrt(g_bias)
            if len(x):
                slope = error * value + decay * weights[x]
                g_weights[x] += slope**2
                weights[x] -= step * slope / np.sqrt(g_weights[x])
                slopes = error * (summed - own) * value[:, None] + decay * factors[x]
                g_factors[x] += slopes**2
                factors[x] -= step * slopes / np.sqrt(g_factors[x])
    return Machine(terms, bias, weights * values, factors * values[:, None])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 10_000, rank: int = 6) -> Machine:
    """Fit on at most ``rows`` labelled documents (doc_id, text) with (doc_id, toxic), chosen by the id's hash; null labels are left out."""
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The limit above bounds the broadcast side.
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for batch in batches:
            found = [terms_of(t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "toxic", "terms"])

    got = sample.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, terms array<bigint>").toPandas()
    # In one order whatever the tasks' order was.
    got = sorted(zip(got["doc_id"], (np.asarray(t, np.int64) for t in got["terms"]), got["toxic"]), key=lambda r: (r[0], r[1].tolist()))
    return train([t for _, t, _ in got], np.array([float(y) for *_, y in got]), rank)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score), one row per row of docs, from the whole text; null and empty texts get the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = _Terms(m.terms)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                numbers = terms_of(text.as_py(), known)
                z[i] = m.logit(numbers[numbers >= 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    docs = docs.select("doc_id", text_or_empty().alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
