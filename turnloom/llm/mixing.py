"""Mixing by soft membership: nonnegative rates whose expected domain tokens match targets.

A classifier learned from a labelled table gives every document posteriors over the domains
(one-vs-rest FTRL over hashed words and binned measurements, normalised). With n_d tokens,
posteriors p_d and rates r_d, the expected tokens of domain k are S_k = sum of n_d r_d p_dk, and

    1/2 |S - T|^2 / N^2  +  ridge / 2 * sum of n_d / N * (r_d - 1)^2,   r_d >= 0

is minimised by rates r_d = max(0, 1 + p_d . m) for the K numbers m with S / N - T / N + ridge * m = 0.
These are found by Newton steps with a line search: each step broadcasts the step's candidates and
adds up K and K x K sums over a compact table. No rates are stored, no lineage grows. The totals
miss the targets by ridge * m, which is below TOLERANCE unless rates would have to pass about 100.

Defined cases: null and empty texts have no tokens and keep rate 1; a domain without documents
can't be matched and only its residual remains (``report`` states it); a target of zero drives its
documents' rates down; repeated rows and equal texts each get a rate, the same one; labelled rows
without a quality or toxicity mark teach nothing, repeated and conflicting ones all count; other
columns of either table are not read; an empty table gives no rows.
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
from .toxicity import SparseModel, ftrl, logistic, table_of, text_sums

SAMPLE = 6_000
BITS = 18
RIDGE = 1e-6
STEPS = 200  # a bound that is not met: steps end when the equation holds
TOLERANCE = 1e-4  # of the totals, as shares of all tokens
_LENGTHS = 0.5 ** np.arange(16)  # of a Newton step, tried all at once
#: shares of the tokens that the query aims at, by (quality, toxic) of the labelled table
TARGETS = {"good": 0.85, "good_toxic": 0.03, "poor": 0.10, "poor_toxic": 0.02}
_GRID = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.99, 1.5, 3.0, 5.0, 7.0, 9.0])


def _ids(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (words, and one for the bin of each measurement), their bounds, tokens a text."""
    ids, first = X.gram_ids(buf, offs, bits - 1, pairs=False)
    x = X.measure(buf, offs)
    n = len(x)
    bins = np.searchsorted(_GRID, x) + np.arange(x.shape[1]) * (len(_GRID) + 1) + (1 << (bits - 1))
    own = np.repeat(np.arange(n), np.diff(first))
    key = np.concatenate([ids, bins.ravel().astype(np.int32)])
    owner = np.concatenate([own, np.repeat(np.arange(n), x.shape[1])])
    o = np.argsort(owner, kind="stable")
    return key[o], np.searchsorted(owner[o], np.arange(n + 1)), np.round(np.expm1(x[:, 0])).astype(np.int64)


@dataclass
class DomainModel:
    names: list[str]
    models: list[SparseModel]

    def posteriors(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = np.ones((len(first) - 1, len(self.names)))
        if self.models:
            table = table_of(self.models)
            p = logistic(np.array([m.bias for m in self.models]) + text_sums(table[np.minimum(ids, len(table) - 1)], first))
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], limit: int = SAMPLE, bits: int = BITS) -> DomainModel:
    """``labelled``: doc_id, domain. At most ``limit`` rows are learned from."""
    sample = X.labelled_sample(docs, labelled, F.col("domain"), F.lit(True), limit)

    rows, y = X.collect_features(sample, lambda buf, offs: _ids(buf, offs, bits)[:2])
    if not rows:
        return DomainModel(names, [])
    return DomainModel(names, [ftrl(rows, np.array([d == k for d in y], float), bits, epochs=3) for k in names])


def posteriors(docs: DataFrame, model: DomainModel, bits: int = BITS) -> DataFrame:
    """doc_id, n_tokens, posteriors (in the order of the model's names); one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text"):
                ids, first, n = _ids(buf, offs, bits)
                p = shared.value.posteriors(ids, first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), lists], ["doc_id", "n_tokens", "posteriors"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, posteriors array<double>")


def rates_at(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 + p @ m)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(batch.column(1), dtype=float)
    return n, np.asarray(batch.column(2).flatten()).reshape(len(n), -1)


def solve(table: DataFrame, targets: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The numbers m that ``rates_at`` turns into rates."""
    spark, k = table.sparkSession, len(targets)
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    m = np.zeros(k)
    if not total:
        return m
    tries = [m]
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(tries)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(sent.value), 1 + k + k * k))
            for batch in batches:
                n, p = _arrays(batch)
                for row, m in zip(out, sent.value, strict=True):
                    rate = rates_at(p, m)
                    row[0] += n @ rate**2
                    row[1 : k + 1] += (n * rate) @ p
                    row[k + 1 :] += (p.T @ (p * (n * (rate > 0))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["k", "s"])

        rows = table.mapInArrow(sums, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        sent.unpersist()
        got = np.zeros(len(tries) * (1 + k + k * k))
        for x in rows:
            got[x.k] = x.s / total
        got = got.reshape(len(tries), -1)
        # m minimises this convex function, whose gradient is the equation
        value = [g[0] / 2 - targets @ x + ridge / 2 * x @ x for g, x in zip(got, tries, strict=True)]
        best = int(np.argmin(value))
        m, g = tries[best], got[best]
        gradient = g[1 : k + 1] - targets + ridge * m
        if np.abs(gradient).max() < tolerance / 10:
            break
        step = np.linalg.solve(g[k + 1 :].reshape(k, k) + ridge * np.eye(k), gradient)
        tries = [m] + [m - length * step for length in _LENGTHS]
    return m


def rates(table: DataFrame, targets: np.ndarray, ridge: float = RIDGE, **how) -> DataFrame:
    """``table`` (doc_id, n_tokens, posteriors) with ``rate``."""
    m = solve(table, targets, ridge, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = _arrays(batch)
            rate = np.where(n > 0, rates_at(p, m), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["doc_id", "n_tokens", "posteriors", "rate"])

    return table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, n_tokens long, posteriors array<double>, rate double")


def report(rated: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Per domain: the target share of the tokens, the share that the rates reach, and the residual.

    ``rated`` is what ``mix`` returns. Shares are of the tokens before mixing, as in the objective.
    """
    n = F.col("n_tokens").cast("double")
    sums = rated.agg(F.sum(n).alias("n"), *[F.sum(n * F.col("rate") * F.col("posteriors")[k]).alias(f"s{k}") for k in range(len(targets))])
    rows = [F.struct(F.lit(name).alias("domain"), F.lit(float(t)).alias("target"), F.try_divide(F.col(f"s{k}"), F.col("n")).alias("reached")) for k, (name, t) in enumerate(targets.items())]
    return sums.select(F.inline(F.array(*rows))).withColumn("residual", F.col("reached") - F.col("target"))


def domains_of(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: good or poor, toxic or not."""
    name = F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("poor"))
    name = F.when(F.col("toxic") == 1, F.concat(name, F.lit("_toxic"))).otherwise(name)
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", name.alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **how) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate of every document."""
    names = list(targets)
    model = fit_domains(docs, domains_of(labels), names)
    table = C.cut(posteriors(docs, model), "posteriors")
    return rates(table, np.array([targets[k] for k in names]), **how)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, labels)
