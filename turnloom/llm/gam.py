"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features; each turn fits a shallow
tree to the feature's histogram of gradients and adds it, shrunk, to the feature's lookup table.
Then the pairs that explain most of what is left get tables of their own in the same way. A score
is the intercept plus one table entry a feature and pair, through the logistic function.

The model is fitted on the driver from at most ``limit`` labelled rows and is a few kB.
Defined cases: null and empty texts have zero features and a score like any other; without
labels every score is 0.5; repeated labels count twice, conflicting ones pull both ways; of labelled
rows beyond ``limit`` those of the smallest hashes of their ids are learned from, ties by id; repeated
rows are scored row by row; other columns of either table are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import features as X

SAMPLE = 20_000


def _best_split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram in two."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    gain = cg**2 / (ch + l2) + (g.sum() - cg) ** 2 / (h.sum() - ch + l2) - g.sum() ** 2 / (h.sum() + l2)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Newton steps of a tree of that depth, one value a bin."""
    gain, k = _best_split(g, h, l2) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + l2))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, l2), _tree(g[k:], h[k:], depth - 1, l2)])


def _tree2(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """A cut along one axis, then one along the other on each side: (gain, values a cell)."""
    best = (0.0, np.zeros_like(g))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        first, k = _best_split(a.sum(1), b.sum(1), l2)
        out, gain = np.zeros_like(a), first
        for rows in (slice(None, k or len(a)), slice(k or len(a), None)):
            more, c = _best_split(a[rows].sum(0), b[rows].sum(0), l2)
            gain += more
            for cols in (slice(None, c or a.shape[1]), slice(c or a.shape[1], None)):
                out[rows, cols] = -a[rows, cols].sum() / (b[rows, cols].sum() + l2)
        if gain > best[0]:
            best = (gain, out if axis == 0 else out.T)
    return best


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        z, b = np.full(len(x), self.intercept), self.bins(x)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 24, rounds: int = 120, rate: float = 0.15, depth: int = 2, n_pairs: int = 6, pair_rounds: int = 40, l2: float = 4.0) -> AdditiveModel:
    m = AdditiveModel()
    if not len(y):
        return m
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.intercept = float(np.log(base / (1 - base)))
    m.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = m.bins(x)
    sizes = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in sizes]
    z = np.full(len(y), m.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, s in enumerate(sizes):
            g, h = gradients()
            step = rate * _tree(np.bincount(b[:, k], g, s), np.bincount(b[:, k], h, s), depth, l2)
            m.tables[k] += step
            z += step[b[:, k]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        cell = b[:, i] * sizes[j] + b[:, j]
        n = sizes[i] * sizes[j]
        return np.bincount(cell, g, n).reshape(sizes[i], sizes[j]), np.bincount(cell, h, n).reshape(sizes[i], sizes[j])

    ranked = sorted(((_tree2(*grid(i, j), l2)[0], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)
    m.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    m.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(m.pairs):
            step = rate * _tree2(*grid(i, j), l2)[1]
            m.pair_tables[k] += step
            z += step[b[:, i], b[:, j]]
    return m


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offs in C.text_parts(batch, "text"):
            x = X.measure(buf, offs)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(1).slice(i, j - i)], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", may_learn=None, limit: int = SAMPLE, **how) -> AdditiveModel:
    sample = X.labelled_sample(docs, labels, F.col(label).cast("double"), F.lit(True) if may_learn is None else may_learn, limit)
    rows = sample.select("text", "y").mapInArrow(_measured, "x array<double>, y double").toPandas()
    if not len(rows):
        return AdditiveModel()
    x = np.stack(rows["x"].to_numpy())
    # the rows come in any order; the fit must not depend on it
    o = np.lexsort((rows["y"].to_numpy(), *x.T))
    return fit(x[o], rows["y"].to_numpy()[o], **how)


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.score(X.measure(buf, offs)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, "quality", C.fold_of(F.col("doc_id"), 4) != 2)
    held = F.coalesce(C.fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
