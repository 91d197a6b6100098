"""Between embedding spaces and words: decoding a matrix by a small vocabulary, the gated adapter,
and the older way to merge a hot set with extracted words."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, EngineConfig
from ..functions import lexicon as L
from ..functions import vectors as V
from .graph import keywords, overlap

_SOURCES = tuple(re.compile(p, f) for p, f in ((L.PATH_RE, re.I), (L.HEADING_RE, re.M), (L.QUOTED_RE, 0), (L.PROPER_RE, 0)))
_STOP = frozenset(L.STOP_WORDS)


def plain_gist(text: str, most: int) -> str:
    """``extract.gist`` for a string: words of paths, headings, quotes and names, phrases first."""
    found: dict[str, str] = {}
    for pattern in _SOURCES:
        for m in pattern.finditer(text):
            raw = m[m.lastindex or 0]
            phrase = raw.strip().strip("\"'")
            pieces = [phrase] if " " in phrase and 2 <= len(phrase) <= 80 else []
            pieces += [w for w in (p.strip(" .,;:") for p in re.split(r"[^\w./#-]+", raw)) if len(w) >= 2]
            for piece in pieces:
                if piece.lower() not in _STOP:
                    found.setdefault(piece.lower(), piece)
    order = sorted(found.values(), key=lambda x: (-len(x.split()), -len(x), x.lower()))
    words: dict[str, str] = {}
    for word in (w for x in order for w in x.split()):
        if len(word) >= 2 and word.lower() not in _STOP:
            words.setdefault(word.lower(), word)
    return " ".join(list(words.values())[: max(most, 0)])


def merge_forward(hot: str = "", extractive: str = "", p1: str = "", most: int = 32, allow_p1: bool = False, config: EngineConfig = DEFAULT) -> tuple[str, str]:
    """(text, method): the hot set, then at most ``most`` words it lacks, then a decoded text if it is
    like these and allowed."""
    hot, p1 = hot.strip(), p1.strip() if allow_p1 else ""
    first: dict[str, str] = {}
    for w in extractive.split():
        first.setdefault(w.lower(), w)
    words = list(first.values())[:most]
    inside = {w.lower() for w in re.findall(r"[A-Za-z0-9_./#-]+", hot)}
    more = " ".join(w for w in words if w.lower() not in inside)
    parts = [x for x in (hot, more) if x]
    if p1 and (not parts or overlap(keywords(p1), keywords(hot) | keywords(more)) >= config.p1_jaccard):
        return "\n".join([*parts, p1]), "p1-debug"
    return "\n".join(parts), ("extractive+hot" if more else "hot_set") if hot else "extractive" if more else "hot_set"


def alignment(a: list[str], b: list[str]) -> np.ndarray:
    """``lifecycle.align_vocabularies`` as a matrix, for vocabularies that fit a broadcast."""
    m = np.zeros((len(a), len(b)), np.float32)
    place = {w: j for j, w in enumerate(b)}
    for i, w in enumerate(a):
        like = [place[w]] if w in place else [j for j, x in enumerate(b) if x[:2] == w[:2]] or [i % len(b)]
        m[i, like] = 1 / len(like)
    return m


@dataclass
class Bridge:
    """A vocabulary and its frozen vectors on either side; a few hundred kB, broadcast to the tasks."""

    vocab: tuple[str, ...] = L.VOCABULARY
    target: tuple[str, ...] = L.VOCABULARY
    dim: int = DEFAULT.dim
    tau: float = 1.0
    head: np.ndarray | None = None  # of the producer, in place of the vocabulary's vectors
    table: np.ndarray = field(init=False)
    out_table: np.ndarray = field(init=False)
    across: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = np.stack([V.embed_text(w, self.dim, 1) for w in self.vocab])
        self.out_table = np.stack([V.embed_text(w, self.dim, 2) for w in self.target])
        self.across = alignment(list(self.vocab), list(self.target))

    def logits(self, matrix: np.ndarray) -> np.ndarray:
        return np.asarray(matrix, np.float32) @ (self.table if self.head is None else self.head).T @ self.across

    def shares(self, matrix: np.ndarray) -> np.ndarray:
        z = self.logits(matrix) / max(self.tau, 1e-6)
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def expectation(self, matrix: np.ndarray) -> np.ndarray:
        """The mean target vector of each row, scaled to length one."""
        x = self.shares(matrix) @ self.out_table
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-8)

    def decode(self, matrix: np.ndarray) -> list[str]:
        """Each row's likeliest word that no row before it took, until all are taken."""
        free, out = np.ones(len(self.target), bool), []
        for p in np.atleast_2d(self.shares(matrix)):
            k = int(np.argmax(np.where(free, p, -1.0) if free.any() else p))
            free[k] = False
            if not out or out[-1] != self.target[k]:
                out.append(self.target[k])
        return out


def decode_states(states: DataFrame, bridge: Bridge | None = None) -> DataFrame:
    """(conv_id, t, text, expectation) of each state's matrix."""
    shared = states.sparkSession.sparkContext.broadcast(bridge or Bridge())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mats = [np.array(m, np.float32) for m in batch.column(2).to_pylist()]
            out = [" ".join(shared.value.decode(m)) for m in mats]
            mean = [shared.value.expectation(m).tolist() for m in mats]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(mean, pa.list_(pa.list_(pa.float32())))], ["conv_id", "t", "text", "expectation"])

    kind = states.schema["conv_id"].dataType.simpleString()
    return states.select("conv_id", "t", "matrix").mapInArrow(run, f"conv_id {kind}, t long, text string, expectation array<array<float>>")


_WEIGHTS = ("w1", "b1", "w_g", "b_g", "w2", "b2", "w3", "b3")


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


@dataclass
class Adapter:
    """A gated network from one embedding space to another; training moves its last layer."""

    d_in: int
    d_out: int
    width: int = 64
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng, r = np.random.default_rng(0), self.width
        for w, b, shape in zip(_WEIGHTS[::2], _WEIGHTS[1::2], ((self.d_in, r), (r, r), (r, r), (r, self.d_out)), strict=True):
            if w not in self.weights:
                self.weights[w] = rng.normal(0, 0.05, shape).astype(np.float32)
                self.weights[b] = np.zeros(shape[1], np.float32)

    def _inner(self, x: np.ndarray) -> np.ndarray:
        p = self.weights
        h = _gelu(np.asarray(x, np.float32) @ p["w1"] + p["b1"])
        gate = 1 / (1 + np.exp(-np.clip(h @ p["w_g"] + p["b_g"], -40, 40)))
        return _gelu((h * gate) @ p["w2"] + p["b2"])

    def forward(self, x: np.ndarray) -> np.ndarray:
        return (self._inner(x) @ self.weights["w3"] + self.weights["b3"]).astype(np.float32)

    def train_step(self, x: np.ndarray, y: np.ndarray, rate: float = 1e-2, lam: float = 0.1) -> float:
        """The loss before a step down the squared error's gradient."""
        z = self._inner(x)
        out = z @ self.weights["w3"] + self.weights["b3"]
        diff = out - np.asarray(y, np.float32)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-8)
        loss = float((diff**2).mean()) + lam * (1 - float((unit(out) * unit(np.asarray(y, np.float32))).sum(axis=-1).mean()))
        grad = 2 * diff / max(diff.size, 1)
        self.weights["w3"] = self.weights["w3"] - rate * (z.T @ grad)
        self.weights["b3"] = self.weights["b3"] - rate * grad.sum(axis=0)
        return loss

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, d_in=self.d_in, d_out=self.d_out, width=self.width, **self.weights)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Adapter:
        with np.load(io.BytesIO(raw), allow_pickle=False) as got:
            return cls(int(got["d_in"]), int(got["d_out"]), int(got["width"]), {k: got[k] for k in _WEIGHTS})


def collect_pairs(states: DataFrame, targets: DataFrame, limit: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Matrix rows of two producers that stand at the same conversation, turn and slot; ``limit`` rows
    at most, in a fixed order, bound what the driver trains on."""
    slots = [x.selectExpr("conv_id", "t", f"posexplode(matrix) AS (slot, {n})") for x, n in ((states, "x"), (targets, "y"))]
    rows = slots[0].join(slots[1], ["conv_id", "t", "slot"]).orderBy("conv_id", "t", "slot").limit(limit).select("x", "y").toArrow()
    return tuple(np.array(rows.column(k).to_pylist(), np.float32) for k in (0, 1))


def train_adapter(x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 256, **how) -> Adapter:
    adapter = Adapter(x.shape[1], y.shape[1])
    for _ in range(epochs):
        for a in range(0, len(x), batch):
            adapter.train_step(x[a : a + batch], y[a : a + batch], **how)
    return adapter


def save_adapter(spark: SparkSession, adapter: Adapter, path: str) -> None:
    """One row, wherever Spark can write."""
    spark.createDataFrame([(bytearray(adapter.dumps()),)], "weights binary").write.mode("overwrite").parquet(path)


def load_adapter(spark: SparkSession, path: str) -> Adapter:
    return Adapter.loads(bytes(spark.read.parquet(path).first()[0]))


def adapt_states(states: DataFrame, adapter: Adapter) -> DataFrame:
    """``states`` with each matrix taken to the adapter's output space."""
    shared = states.sparkSession.sparkContext.broadcast(adapter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.forward(np.array(m, np.float32)).tolist() for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.float32())))], ["conv_id", "t", "matrix"])

    kind = states.schema["conv_id"].dataType.simpleString()
    return states.select("conv_id", "t", "matrix").mapInArrow(run, f"conv_id {kind}, t long, matrix array<array<float>>")
