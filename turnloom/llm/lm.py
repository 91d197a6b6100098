"""Language-model scores from a weighted backoff automaton.

The model is an interpolated absolute-discount bigram over all training tokens. As an automaton
(``Automaton``): a root state with an arc for every word, add-one smoothed with one share for unseen
words; a state for the text's start and for every context seen in training, with an arc for each word
seen after it and a failure arc to the root for all others. One left-to-right traversal carries the
state and adds up the log-weights of the arcs and failure arcs that it takes.

Neither the vocabulary nor the bigrams have a bound, so no model is broadcast. Texts are read
once into *segments* of a few MB (word ids of the segment's own dictionary); what a segment needs
to know of the corpus is gathered by hash ranges and sent back to it:

1. segments send their dictionaries with training counts, a blob a hash range;
2. each range adds the counts up and answers every segment's words;
3. segments send their bigrams the same way, dealt by context, or by the bigram itself where the
   context is so frequent that its followers would overload one range;
4. ranges answer with bigram counts and the number of different followers of the context;
5. each segment builds its part of the automaton and traverses its texts.

Words are told by 64 bits of their hash, a bigram's second word by 48.

Defined cases: a null or empty text is one end token; texts without training tokens score by the
unseen share alone; rows without a doc_id are learned from; repeated rows are scored row by row;
there are no ties; columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DISCOUNT = 0.75
MIN_STATE = 1
SEGMENT_BYTES = 8 << 20
RANGE_BYTES = 16 << 20  # of dictionary entries that a range task holds
_END = C._U(0x5D1E0F2C3B4A6978)
_START = C._U(0x1B873593CC9E2D51)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_ids(a: np.ndarray) -> bytes:
    """Byte planes: frequent words have small ids, so the upper planes nearly vanish."""
    return _pack(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unpack_ids(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _groups(rs: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, begin, end) of each run of a sorted array."""
    if not len(rs):
        return []
    b = np.concatenate([[0], np.flatnonzero(np.diff(rs)) + 1, [len(rs)]])
    return [(int(rs[x]), int(x), int(y)) for x, y in zip(b[:-1], b[1:], strict=True)]


def _word_order(u: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    r = (u % C._U(n_ranges)).astype(np.int64)
    order = np.argsort(r, kind="stable")
    return order, r[order]


_SEG = "seg string, n long, doc_ids array<{id}>, held array<boolean>, ids binary, words binary, sizes binary"
_LOW48 = C._U((1 << 48) - 1)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


_STR, _INT, _LONG, _BIN = pa.string(), pa.int32(), pa.int64(), pa.binary()


def segments(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row a segment: its texts as word ids, its dictionary (frequent words first), word counts
    of the texts, and ``n``, its training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text", segment_bytes):
                h, _, _, first = C.words_of(buf, offs, C.BLANK, lower=True)
                size = np.diff(first) + 1
                tok = np.full(len(h) + j - i, _END, np.uint64)
                tok[np.arange(len(h)) + np.repeat(np.arange(j - i), size - 1)] = h
                doc_ids = batch.column(0).slice(i, j - i)
                held = np.asarray(batch.column(2).slice(i, j - i).to_pylist(), bool)
                u, inv, n = np.unique(tok, return_inverse=True, return_counts=True)
                rank = np.empty(len(u), np.int32)
                by = np.argsort(-n, kind="stable")
                rank[by] = np.arange(len(u), dtype=np.int32)
                row = (uuid.uuid4().hex, int(size[~held].sum()), doc_ids.to_pylist(), held.tolist(), _pack_ids(rank[inv]), _pack(u[by]), _pack(size.astype(np.int32)))
                fields = [("seg", _STR), ("n", _LONG), ("doc_ids", pa.list_(doc_ids.type)), ("held", pa.list_(pa.bool_())), ("ids", _BIN), ("words", _BIN), ("sizes", _BIN)]
                yield from _table([row], fields).to_batches()

    return docs.mapInArrow(run, _SEG.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _word_parts(n_ranges: int):
    """Step 1: a segment's words and training counts, a row a hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                ids, u, size = _unpack_ids(one["ids"]), _unpack(one["words"], np.uint64), _unpack(one["sizes"], np.int32)
                train = np.bincount(ids, weights=np.repeat(~np.asarray(one["held"], bool), size), minlength=len(u)).astype(np.int64)
                order, rs = _word_order(u, n_ranges)
                rows = [(one["seg"], r, _pack(u[order[x:y]]), _pack(train[order[x:y]])) for r, x, y in _groups(rs)]
                yield from _table(rows, [("seg", _STR), ("r", _INT), ("a", _BIN), ("b", _BIN)]).to_batches()

    return run


def _count_words(hot_at: int):
    """Range task of step 2: the sum of each word's counts, for all who asked; words too frequent
    to deal by are named in a ``hot`` row, totals in a ``sum`` row."""

    def run(t: pa.Table) -> pa.Table:
        segs, sizes = t["seg"].to_pylist(), []
        hashes, counts = [], []
        for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True):
            hashes.append(_unpack(a, np.uint64))
            counts.append(_unpack(b, np.int64))
            sizes.append(len(hashes[-1]))
        u, inv = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate(counts)).astype(np.int64)
        ends = np.cumsum(sizes)
        r = t["r"][0].as_py()
        out = [("answer", s, r, 0, _pack(c[inv[e - n : e]]), None) for s, n, e in zip(segs, sizes, ends, strict=True)]
        out.append(("sum", "", r, int((c > 0).sum()), u[c >= hot_at].tobytes(), None))
        C.trim()
        return _table(out, _ANSWER)

    return run


def _answers(parts: pa.Table, column: str, kind, order: np.ndarray) -> np.ndarray:
    """The answers of all ranges, put back in the order in which the segment asked."""
    if not len(order):
        return np.zeros(0, kind)
    by = sorted(zip(parts["r"].to_pylist(), parts[column].to_pylist(), strict=True))
    flat = np.concatenate([_unpack(x, kind) for _, x in by])
    out = np.empty(len(order), kind)
    out[order] = flat
    return out


def _bigrams(ids: np.ndarray, u: np.ndarray, size: np.ndarray, c1: np.ndarray, min_state: int, hot: np.ndarray, n_ranges: int) -> dict:
    """The tokens whose context is a state, their distinct bigrams, and the order in which these
    are asked for: by range, then by context."""
    is_state = c1 >= min_state
    state = Automaton.states(ids, size, is_state)
    place = np.flatnonzero(state != Automaton.ROOT)
    state = state[place]
    ctx = np.where(state < 0, _START, u[np.maximum(state, 0)])
    word = u[ids[place]] & _LOW48
    g, at, inv = np.unique(_bigram_key(ctx, word), return_index=True, return_inverse=True)
    ctx, word = ctx[at], word[at]
    is_hot = np.isin(ctx, hot)
    r = (np.where(is_hot, g, ctx) % C._U(n_ranges)).astype(np.int64)
    order = np.lexsort((ctx, r))
    return {"is_state": is_state, "place": place, "state": state[at], "id": ids[place[at]], "ctx": ctx, "word": word, "inv": inv, "hot": is_hot, "order": order, "r": r[order]}


def _bigram_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of a 64-bit context and the 48 bits of a word that travel (a clash needs one context)."""
    with np.errstate(over="ignore"):
        return C.mix64(ctx * C._U(C._P) + word)


def _pack_asked(ctx: np.ndarray, word: np.ndarray) -> tuple[bytes, bytes]:
    runs = _groups_of(ctx)
    return _pack(np.concatenate([np.array([len(runs)], np.uint64), ctx[runs], np.diff(np.append(runs, len(ctx))).astype(np.uint64)])), word.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _groups_of(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def _unpack_asked(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = _unpack(a, np.uint64)
    k = int(x[0])
    word = np.zeros((len(b) // 6, 8), np.uint8)
    word[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return np.repeat(x[1 : k + 1], x[k + 1 :].astype(np.int64)), word.view(np.uint64).ravel()


def _count_bigrams(hot):
    """Range task of step 4: counts of bigrams, and how many different words follow each context
    (for hot contexts a part of that number, to be added up over the ranges)."""

    def run(t: pa.Table) -> pa.Table:
        segs, sizes, ctxs, words, ns = t["seg"].to_pylist(), [], [], [], []
        for a, b, c in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True):
            ctx, word = _unpack_asked(a, b)
            ctxs.append(ctx)
            words.append(word)
            ns.append(_unpack(c, np.int32))
            sizes.append(len(ctx))
        ctx = np.concatenate(ctxs)
        u, at, inv = np.unique(_bigram_key(ctx, np.concatenate(words)), return_index=True, return_inverse=True)
        c2 = np.bincount(inv, weights=np.concatenate(ns)).astype(np.int64)
        cu, ci = np.unique(ctx[at], return_inverse=True)
        follow = np.bincount(ci, weights=c2 > 0).astype(np.int64)
        is_hot = np.isin(cu, hot.value)
        t2 = np.where(is_hot, 0, follow)[ci]
        r, ends = t["r"][0].as_py(), np.cumsum(sizes)
        out = []
        for s, n, e in zip(segs, sizes, ends, strict=True):
            i = inv[e - n : e]
            out.append(("answer", s, r, 0, _pack(c2[i].astype(np.int32)), _pack(t2[i].astype(np.int32))))
        out.append(("sum", "", r, 0, cu[is_hot].tobytes(), follow[is_hot].tobytes()))
        C.trim()
        return _table(out, _ANSWER)

    return run


_ANSWER = [("kind", _STR), ("seg", _STR), ("r", _INT), ("n", _LONG), ("a", _BIN), ("b", _BIN)]
_ANSWER_DDL = "kind string, seg string, r int, n long, a binary, b binary"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], ["ctx", "n"])


@dataclass
class Automaton:
    """A segment's part of the automaton, over the words and the (state, word) steps of its texts.

    A state is the word that leads to it, START at a text's start, or ROOT for a word that is no
    context. Every arc over a word leads to that word's state, be it taken in a state or, behind a
    failure arc, in the root.
    """

    root: np.ndarray  # log10 weight of the root's arc over each word
    is_state: np.ndarray  # whether a word has a state of its own
    arc: np.ndarray  # log10 weight of each step: of its arc, interpolated, or of failure arc and root's arc
    dead: np.ndarray  # steps whose state has no followers in training; they are the root's

    START = -1
    ROOT = -2

    @staticmethod
    def states(ids: np.ndarray, size: np.ndarray, is_state: np.ndarray) -> np.ndarray:
        """The state before each token of the texts (``size`` tokens each), left to right."""
        out = np.empty(len(ids), np.int64)
        out[1:] = np.where(is_state[ids[:-1]], ids[:-1], Automaton.ROOT)
        out[np.cumsum(size) - size] = Automaton.START
        return out

    @classmethod
    def build(cls, c1: np.ndarray, total: float, is_state: np.ndarray, word: np.ndarray, seen: np.ndarray, count: np.ndarray, followers: np.ndarray, discount: float) -> Automaton:
        """c1: training count of each word; of each step: its word, how often its state was passed in
        training, how often the word followed, and how many different words did."""
        root = np.log10((c1 + 1) / total)
        dead = (seen <= 0) | (followers <= 0)
        times = np.where(dead, 1.0, seen)
        fail = discount * followers / times  # weight of the state's failure arc
        arc = np.where(dead, 1.0, np.maximum(count - discount, 0) / times + fail * 10 ** root[word])
        return cls(root, is_state, np.log10(arc), dead)

    def traverse(self, ids: np.ndarray, size: np.ndarray, step: np.ndarray) -> np.ndarray:
        """log10 weights of the tokens; ``step`` names the step of each token that stands in a state
        other than the root, in their order."""
        path = self.root[ids]
        place = np.flatnonzero(self.states(ids, size, self.is_state) != self.ROOT)
        live = ~self.dead[step]
        path[place[live]] = self.arc[step[live]]
        return path


def score(docs: DataFrame, discount: float = DISCOUNT, min_state: int = MIN_STATE, n_ranges: int | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Score ``docs`` (doc_id, text, held boolean): learn from those not held, score all.

    ``n_ranges`` follows the size of the segments' dictionaries, from spark.sql.shuffle.partitions up.
    """
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    segs = C.cut(segments(docs.select("doc_id", "text", "held"), segment_bytes), "segments", "none")
    sums = segs.agg(F.sum("n"), F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum(F.length("words"))).first()
    n_train, n_docs = int(sums[0] or 0), int(sums[1] or 0)
    ranges = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sums[2] or 0) // RANGE_BYTES + 1)

    parts = segs.select("seg", "held", "ids", "words", "sizes").mapInArrow(_word_parts(ranges), "seg string, r int, a binary, b binary")
    counted = C.cut(parts.groupBy("r").applyInArrow(_count_words(max(2, 2 * n_train // ranges)), _ANSWER_DDL), "counts", "none", "kind")
    sums = counted.where("kind = 'sum'").select("n", "a").collect()  # a row a range; at most ranges / 2 words are hot
    vocabulary = sum(x.n for x in sums)
    hot = spark.sparkContext.broadcast(np.unique(np.concatenate([np.frombuffer(x.a, np.uint64) for x in sums] + [np.array([_START])])))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 3: word counts come in, the segment's bigrams go out."""
        fields = [("seg", _STR), ("r", _INT), ("a", _BIN), ("b", _BIN), ("c", _BIN)]
        rows = []
        for one in left.to_pylist():
            ids, u, size = _unpack_ids(one["ids"]), _unpack(one["words"], np.uint64), _unpack(one["sizes"], np.int32)
            c1 = _answers(right, "a", np.int64, _word_order(u, ranges)[0])
            x = _bigrams(ids, u, size, c1, min_state, hot.value, ranges)
            train = np.repeat(~np.asarray(one["held"], bool), size)[x["place"]]
            n = np.bincount(x["inv"], weights=train, minlength=len(x["ctx"])).astype(np.int32)
            for r, b, e in _groups(x["r"]):
                o = x["order"][b:e]
                rows.append((one["seg"], r, *_pack_asked(x["ctx"][o], x["word"][o]), _pack(n[o])))
        C.trim()
        return _table(rows, fields)

    words = counted.where("kind = 'answer'").select("seg", "r", "a")
    asked = segs.select("seg", "held", "ids", "words", "sizes").groupBy("seg").cogroup(words.groupBy("seg")).applyInArrow(ask, "seg string, r int, a binary, b binary, c binary")
    answered = C.cut(asked.groupBy("r").applyInArrow(_count_bigrams(hot), _ANSWER_DDL), "followers", "none", "kind")

    follow = answered.where("kind = 'sum'").select("a", "b").mapInArrow(_spread, "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n")).collect()
    hot_ids = np.array([x.ctx for x in follow], np.int64).view(np.uint64)
    by = np.argsort(hot_ids)
    hot_follow = spark.sparkContext.broadcast((hot_ids[by], np.array([x.n for x in follow], np.int64)[by]))
    total = n_train + vocabulary + 1

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        """Step 5: the segment's part of the automaton, and one pass over its texts."""
        ids, u, size = _unpack_ids(left["ids"][0].as_py()), _unpack(left["words"][0].as_py(), np.uint64), _unpack(left["sizes"][0].as_py(), np.int32)
        two = np.asarray(right["order"].to_pylist()) == 2
        c1 = _answers(right.filter(pa.array(~two)), "a", np.int64, _word_order(u, ranges)[0])
        x = _bigrams(ids, u, size, c1, min_state, hot.value, ranges)
        right = right.filter(pa.array(two))
        c2 = _answers(right, "a", np.int32, x["order"]).astype(float)
        t2 = _answers(right, "b", np.int32, x["order"]).astype(float)
        hot_u, hot_n = hot_follow.value
        if x["hot"].any() and len(hot_u):
            own = x["ctx"][x["hot"]]
            k = np.minimum(np.searchsorted(hot_u, own), len(hot_u) - 1)
            t2[x["hot"]] = np.where(hot_u[k] == own, hot_n[k], 0)
        seen = np.where(x["state"] < 0, n_docs, c1[np.maximum(x["state"], 0)]).astype(float)
        model = Automaton.build(c1, total, x["is_state"], x["id"], seen, c2, t2, discount)
        logp, path = model.root[ids], model.traverse(ids, size, x["inv"])
        begin = np.cumsum(size) - size
        add = lambda v: np.add.reduceat(v, begin) if len(begin) else np.zeros(0)
        return pa.Table.from_arrays(
            [
                left["doc_ids"].combine_chunks().flatten(),
                left["held"].combine_chunks().flatten(),
                pa.array(size, pa.int64()),
                pa.array(add((c1 > 0)[ids].astype(np.int64)), pa.int64()),
                pa.array(np.full(len(size), n_train), pa.int64()),
                pa.array(add(logp), pa.float64()),
                pa.array(add(path), pa.float64()),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    out = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = words.select("seg", F.lit(1).alias("order"), "r", "a", F.lit(None).cast("binary").alias("b")).unionAll(answered.where("kind = 'answer'").select("seg", F.lit(2), "r", "a", "b"))
    return segs.groupBy("seg").cogroup(both.groupBy("seg")).applyInArrow(traverse, out)


def query(docs: DataFrame) -> DataFrame:
    held = F.coalesce(C.fold_of(F.col("doc_id"), 7) == 2, F.lit(False))
    return score(docs.select("doc_id", "text", held.alias("held")))
