"""Vector functions over array columns, and the hashed n-gram embedding."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, degenerate: float = 0.0) -> Column:
    n = norm(a) * norm(b)
    return F.when((norm(a) < 1e-12) | (norm(b) < 1e-12), F.lit(degenerate)).otherwise(dot(a, b) / n)


def normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x.cast("double") / n)


@functools.lru_cache(maxsize=200_000)
def _gram(gram: str, dim: int) -> tuple[int, int]:
    """Bucket and sign of a seeded n-gram."""
    d = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "little") % dim, 1 - 2 * (d[4] & 1)


def gram_counts(text: str, dim: int, seed: int) -> np.ndarray:
    """Signed hashed counts of the word 1- to 3-grams; a text without words is the word "empty"."""
    words = re.findall(r"[A-Za-z0-9_']+", text.lower()) or ["empty"]
    at = [_gram(f"{seed}:{n}:{' '.join(words[k : k + n])}", dim) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    where, sign = zip(*at, strict=True)
    return np.bincount(where, weights=sign, minlength=dim)


def embed_text(text: str, dim: int, seed: int) -> np.ndarray:
    """``gram_counts`` scaled to length one."""
    out = gram_counts(text, dim, seed).astype(np.float32)
    size = float(np.linalg.norm(out))
    return out / size if size > 0 else out


def embed(dim: int = 256, seed: int = 0):
    """An Arrow UDF: text to ARRAY<FLOAT>. A batch's grams are hashed once, repeats come from a cache."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([embed_text(t or "", dim, seed) for t in s])

    return run


def pool(prev: np.ndarray | None, new: np.ndarray, k_max: int, ema: float) -> np.ndarray:
    """The matrix after ``new`` rows are appended: while there are too many, the most alike
    neighbours merge; unit rows at the end. Similarities of untouched pairs are kept between merges."""
    rows = [np.asarray(r, np.float32) for r in ([] if prev is None else [*prev]) + [*np.atleast_2d(new)]]

    def like(a: np.ndarray, b: np.ndarray) -> float:
        na, nb = float(np.linalg.norm(a)), float(np.linalg.norm(b))
        return float(np.dot(a, b) / (na * nb)) if na >= 1e-12 and nb >= 1e-12 else -1.0

    sims = [like(a, b) for a, b in zip(rows, rows[1:], strict=False)]
    while len(rows) > k_max and sims:
        k = int(np.argmax(sims))
        rows[k : k + 2] = [(ema * rows[k] + (1.0 - ema) * rows[k + 1]).astype(np.float32)]
        sims[max(k - 1, 0) : k + 2] = [like(rows[i], rows[i + 1]) for i in range(max(k - 1, 0), min(k + 1, len(rows) - 1))]
    m = np.stack(rows).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def live_mask(k: int, k_max: int | None = None) -> np.ndarray:
    """Ones for the live rows, zeros for the free ones."""
    return (np.arange(k if k_max is None else k_max) < k).astype(np.float32)


def softmax(logits: Column, tau: float = 1.0) -> Column:
    """Of an array of numbers, at a temperature."""
    scaled = F.transform(logits, lambda x: x.cast("double") / max(tau, 1e-6))
    raised = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


