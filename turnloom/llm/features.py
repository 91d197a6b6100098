"""Text measurements for the learned operators, vectorised over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

NAMES = (
    "log_words", "word_bytes", "symbols", "exclaims", "uppercase", "digits", "distinct_words", "distinct_triples",
    "repeated_lines", "stops", "non_ascii", "lines", "bars", "top_word",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS, _EXCLAIM, _STOPS, _BAR, _NL = (_class(x) for x in (b"#*$%&|<>", b"!?", b".,;:", b"|", b"\n"))
_UPPER, _LOWER, _DIGIT = (_class(bytes(range(*r))) for r in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)))
_HIGH = np.arange(256) >= 0x80
_CLASSES = np.stack([_SYMBOLS, _EXCLAIM, _STOPS, _BAR, _HIGH, _UPPER, _LOWER, _DIGIT]).astype(np.int64)


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner (by 40 bits of their hash), and the count of its most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = (owner.astype(np.uint64) << C._U(40)) | (h >> C._U(24))
    key.sort()
    at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    own = (key[at] >> C._U(40)).astype(np.int64)
    top = np.zeros(n)
    some = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    top[own[some]] = np.maximum.reduceat(np.diff(np.append(at, len(key))), some)
    return np.bincount(own, minlength=n).astype(float), top


def measure(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) measurements; an empty text has zeros."""
    n = len(offs) - 1
    h, s, e, first = C.words_of(buf, offs, C.BLANK)
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    per = np.maximum(words, 1)
    bytes_of = np.stack([np.bincount(buf[a:b], minlength=256) for a, b in zip(offs[:-1], offs[1:], strict=True)])
    symbols, exclaims, stops, bars, high, upper, lower, digits = (bytes_of @ _CLASSES.T).T.astype(float)
    triples = C.shingle_hash(h, 3)
    n3 = np.maximum(np.diff(first) - 2, 0)
    at3 = C.ranges(first[:-1], n3)
    d1, top = _distinct(h, owner, n)
    d3, _ = _distinct(triples[at3], np.repeat(np.arange(n), n3), n)
    lh, _, _, lfirst = C.words_of(buf, offs, ~_NL)
    lines = np.diff(lfirst)
    dl, _ = _distinct(lh, np.repeat(np.arange(n), lines), n)
    size = np.diff(offs).astype(float)
    cols = [
        np.log1p(words), np.bincount(owner, weights=e - s, minlength=n) / per, symbols / per, exclaims / per, upper / np.maximum(upper + lower, 1),
        digits / np.maximum(size, 1), d1 / per, d3 / np.maximum(n3, 1), 1 - dl / np.maximum(lines, 1), stops / per, high / np.maximum(size, 1),
        lines / per, bars / per, top / per,
    ]
    return np.stack(cols, axis=1)


def gram_ids(buf: np.ndarray, offs: np.ndarray, bits: int, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: words, and with ``pairs`` neighbours and skip-grams
    over one word. Returns (feature ids, first feature of each text with an end)."""
    h, _, _, first = C.words_of(buf, offs, C.ALNUM, lower=True)
    n = np.diff(first)
    parts = [(h, np.repeat(np.arange(len(n)), n))]
    if pairs:
        with np.errstate(over="ignore"):
            for gap, salt in ((1, 0x51), (2, 0x52)):
                m = np.maximum(n - gap, 0)
                at = C.ranges(first[:-1], m)
                parts.append((C.mix64(h[at] * C._U(C._P) + h[at + gap] + C._U(salt)), np.repeat(np.arange(len(n)), m)))
    ids = np.concatenate([p[0] for p in parts]) >> C._U(64 - bits)
    owner = np.concatenate([p[1] for p in parts])
    key = (owner.astype(np.uint64) << C._U(bits)) | ids
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & C._U((1 << bits) - 1)).astype(np.int32), np.searchsorted(key >> C._U(bits), np.arange(len(n) + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, may_learn: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled rows, those of the smallest hashes of their
    ids. ``limit`` bounds what is broadcast and what the driver fits on."""
    rows = labels.where(may_learn).select(F.col("doc_id").alias("__id"), label.alias("y")).where("y IS NOT NULL AND __id IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")


def collect_features(sample: DataFrame, features: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list]:
    """Feature ids and labels of a labelled sample, ordered by doc_id and label.

    The ids travel as packed bytes, one partition at a time, so the driver holds them once: the
    sample's rows bound it, and no more than a partition of them is ever in the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text"):
                ids, first = features(buf, offs)
                ids = ids.astype(np.int32)
                packed = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed, batch.column(2).slice(i, j - i)], ["doc_id", "ids", "y"])

    kinds = sample.schema
    table = C.cut(sample.mapInArrow(run, f"doc_id {kinds['doc_id'].dataType.simpleString()}, ids binary, y {kinds['y'].dataType.simpleString()}"), "sample")
    rows = sorted(((r[0], r[2], r[1]) for r in table.toLocalIterator()), key=lambda r: r[:2])
    return [np.frombuffer(r[2], np.int32) for r in rows], [r[1] for r in rows]
