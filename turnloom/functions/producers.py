"""Producers of vectors by name. The hashed n-grams need nothing; model-backed ones load their library
in the worker when first used, and say so where it is missing."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import DEFAULT
from . import vectors as V

HASHED = "hashed-ngram"


@functools.cache
def _model(name: str):
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise RuntimeError(f"the producer {name} needs the sentence_transformers library on every worker") from e
    return SentenceTransformer(name)


def chosen(env: str = "TURNLOOM_EMBED") -> str:
    """The producer that the environment names; hashed n-grams by default."""
    return os.environ.get(env, "").strip() or HASHED


def embed(name: str | None = None, dim: int = DEFAULT.dim, seed: int = 0):
    """An Arrow UDF from text to ARRAY<FLOAT>; a model's rows are cut or padded to ``dim``, unit length."""
    name = name or chosen()
    if name == HASHED:
        return V.embed(dim, seed)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            m = np.asarray(_model(name).encode([t or "" for t in s]), np.float32)[:, :dim]
            m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
            yield pd.Series(list(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)))

    return run
