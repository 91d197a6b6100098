"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Each coordinate has its own learning rate, and the L1 part keeps the weights of features that
say nothing at exactly zero, so what is broadcast is a short sorted list of (feature, weight).

The learner passes over at most ``limit`` labelled rows on the driver; ``limit`` and ``bits``
bound the model. Defined cases: null and empty texts have no features and score by the bias;
without labels every score is 0.5; repeated labels count twice, conflicting ones pull both ways; of
labelled rows beyond ``limit`` those of the smallest hashes of their ids are learned from, ties by id;
repeated rows are scored row by row; other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import features as X

SAMPLE = 16_000
BITS = 20


@dataclass
class SparseModel:
    bias: float
    ids: np.ndarray
    weights: np.ndarray

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of texts whose features are ids[first[k]:first[k+1]]."""
        table = table_of([self])
        return logistic(self.bias + text_sums(table[np.minimum(ids, len(table) - 1)], first)[:, 0])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def table_of(models: list[SparseModel]) -> np.ndarray:
    """The weights of every feature, a column a model: 2**bits rows at most, made once a worker.
    The last row, for all features beyond those with a weight, is zero."""
    have = getattr(models[0], "_table", None)
    if have is None or have.shape[1] != len(models):
        size = 1 << max([1, *(int(m.ids[-1]).bit_length() for m in models if len(m.ids))])
        have = np.zeros((size + 1, len(models)))
        for k, m in enumerate(models):
            have[m.ids, k] = m.weights
        models[0]._table = have
    return have


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[k]:first[k+1]] for each k."""
    out = np.zeros((len(first) - 1, values.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def ftrl(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.05, epochs: int = 5, min_count: int = 3) -> SparseModel:
    """FTRL-proximal over binary features; the bias (last coordinate) has no L1. Features of fewer
    than ``min_count`` rows are left out (of the caller's ``rows`` too, which are not held twice):
    the L1 part would hold them at zero."""
    size = 1 << bits
    seen = np.zeros(size, np.int32)
    for ids in rows:
        seen[ids] += 1
    for k, ids in enumerate(rows):
        rows[k] = ids[seen[ids] >= min_count]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    reg = np.full(size + 1, l1)
    reg[size] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= reg[at], 0.0, -(za - np.sign(za) * reg[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = np.append(rows[k], size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y[k]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = np.arange(size + 1)
    w = weights(every)
    keep = np.flatnonzero(w[:size])
    return SparseModel(float(w[size]), keep.astype(np.int32), w[keep])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_learn=None, limit: int = SAMPLE, bits: int = BITS, **how) -> SparseModel:
    sample = X.labelled_sample(docs, labels, F.col(label).cast("double"), F.lit(True) if may_learn is None else may_learn, limit)
    rows, y = X.collect_features(sample, lambda buf, offs: X.gram_ids(buf, offs, bits))
    if not rows:
        return SparseModel(0.0, np.zeros(0, np.int32), np.zeros(0))
    return ftrl(rows, np.array(y), bits, **how)


def score(docs: DataFrame, model: SparseModel, bits: int = BITS) -> DataFrame:
    """doc_id, score of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.score(*X.gram_ids(buf, offs, bits)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, "toxic", C.fold_of(F.col("doc_id"), 3) != 1)
    held = F.coalesce(C.fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
