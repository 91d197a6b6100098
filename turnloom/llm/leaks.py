"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents into segments, one row each: per term the sorted places of its
postings in the segment's run of words. A benchmark window is looked up in every segment from
its rarest term on: each further posting list, shifted by its term's offset, cuts the candidates
down. Building and searching are one narrow pass each; nothing is shuffled, however common a
word, line or passage is. Queries come in blocks of at most ``BLOCK_BYTES`` of benchmark text,
which is what bounds the broadcast; more blocks mean more passes over the index, never fewer hits.

Words: runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Terms are 64-bit hashes.

Defined cases: null or empty texts have no words and are never hit; an item of fewer words than
the window is one window, an item of none has none; repeated documents are judged row by row,
repeated items each count; items without an id hit like others, are one item and not named in the
list; ``without_hits`` goes by the text alone, so equal ids or none do no harm; ties don't occur;
columns other than the id and the text are not read; an empty benchmark hits nothing, empty documents
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
SEGMENT_BYTES = 1 << 21
BLOCK_BYTES = 8 << 20
SALTS = 32

INDEX_SCHEMA = "doc_ids array<{id}>, first binary, terms binary, bounds binary, places binary, hits binary, items array<array<string>>"


def _bin(a: np.ndarray) -> pa.Array:
    return pa.array([a.tobytes()], pa.binary())


def _postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, their bounds, and the places of each term in rising order."""
    n = len(h)
    if 0 < n <= 1 << 20:
        # hash and place share one integer, so plain sorting does; a clash of the kept bits is detected
        key = np.sort((h & ~C._U((1 << 20) - 1)) | np.arange(n, dtype=np.uint64))
        places = (key & C._U((1 << 20) - 1)).astype(np.int32)
        t = h[places]
        change = np.flatnonzero(t[1:] != t[:-1]) + 1
        if not np.all(key[change] >> C._U(20) != key[change - 1] >> C._U(20)):
            places = None
    else:
        places = None
    if places is None:
        places = np.argsort(h, kind="stable").astype(np.int32)
        t = h[places]
        change = np.flatnonzero(t[1:] != t[:-1]) + 1
    bounds = np.concatenate([[0], change, [n]]).astype(np.int32) if n else np.zeros(1, np.int32)
    return t[bounds[:-1]], bounds, places


def build_index(docs: DataFrame, text: str = "text", id_col: str = "doc_id", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row a segment. Write it as a table (``common.cut``) to search it more than once."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, text, segment_bytes):
                h, _, _, first = C.words_of(buf, offs, C.ALNUM, lower=True)
                terms, bounds, places = _postings(h)
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids),
                        _bin(first.astype(np.int32)),
                        _bin(terms),
                        _bin(bounds),
                        _bin(places),
                        _bin(np.zeros(0, np.uint8)),
                        pa.array([[[] for _ in range(j - i)]], pa.list_(pa.list_(pa.string()))),
                    ],
                    ["doc_ids", "first", "terms", "bounds", "places", "hits", "items"],
                )

    return docs.select(id_col, text).mapInArrow(run, INDEX_SCHEMA.format(id=kind.simpleString()))


class Segment:
    """A row of the index, ready for lookups."""

    def __init__(self, first: bytes, terms: bytes, bounds: bytes, places: bytes):
        self.first = np.frombuffer(first, np.int32)
        self.terms = np.frombuffer(terms, np.uint64)
        self.bounds = np.frombuffer(bounds, np.int32)
        self.places = np.frombuffer(places, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each term, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(h.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def postings(self, t: int) -> np.ndarray:
        return self.places[self.bounds[t] : self.bounds[t + 1]]

    def phrase(self, at: np.ndarray) -> np.ndarray:
        """Places where the terms (all present) stand in a row, inside one document."""
        size = self.bounds[at + 1] - self.bounds[at]
        order = np.argsort(size, kind="stable")
        cand = self.postings(at[order[0]]) - np.int32(order[0])
        for o in order[1:]:
            if not len(cand):
                return cand
            p = self.postings(at[o])
            want = cand + np.int32(o)
            k = np.minimum(np.searchsorted(p, want), len(p) - 1)
            cand = cand[p[k] == want]
        doc = np.searchsorted(self.first, cand, "right") - 1
        inside = (cand >= 0) & (cand + len(at) <= self.first[np.minimum(doc + 1, len(self.first) - 1)])
        return cand[inside]

    def near(self, at: np.ndarray, within: int) -> np.ndarray:
        """Places of the rarest term that have every other term of the query at most ``within``
        words away, in the same document."""
        size = self.bounds[at + 1] - self.bounds[at]
        order = np.argsort(size, kind="stable")
        cand = self.postings(at[order[0]]).astype(np.int64)
        doc = np.searchsorted(self.first, cand, "right") - 1
        low = np.maximum(cand - within, self.first[doc])
        high = np.minimum(cand + within + 1, self.first[doc + 1])
        ok = np.ones(len(cand), bool)
        for o in order[1:]:
            p = self.postings(at[o])
            ok &= np.searchsorted(p, low) < np.searchsorted(p, high)
        return cand[ok]


class Queries:
    """The distinct windows of a block of items, by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        found: dict[int, dict[bytes, int]] = {}
        owners: dict[int, list[list[str]]] = {}
        raw = "".join(t or "" for _, t in items).encode()
        offs = np.cumsum([0] + [len((t or "").encode()) for _, t in items])
        h, _, _, first = C.words_of(np.frombuffer(raw, np.uint8), offs, C.ALNUM, lower=True)
        for k, (item, _) in enumerate(items):
            own = h[first[k] : first[k + 1]]
            size = min(window, len(own))
            if not size:
                continue
            seen = found.setdefault(size, {})
            for s in range(len(own) - size + 1):
                key = own[s : s + size].tobytes()
                n = seen.setdefault(key, len(seen))
                lists = owners.setdefault(size, [])
                if n == len(lists):
                    lists.append([])
                if not lists[n] or lists[n][-1] != item:
                    lists[n].append(item)
        sizes = {size: np.frombuffer(b"".join(seen), np.uint64).reshape(-1, size) for size, seen in found.items()}
        # each distinct term is looked up once a segment; windows name their terms by place
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.ravel() for w in sizes.values())]))
        self.sizes = {size: np.searchsorted(self.terms, w).astype(np.int32) for size, w in sizes.items()}
        self.owners = owners

    def present(self, seg: Segment) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, window numbers, their terms' places in the segment) of the windows all of whose
        terms the segment has: a window goes with the first term that is missing."""
        at = seg.find(self.terms)
        for size, windows in self.sizes.items():
            left = np.arange(len(windows))
            for k in range(size):
                left = left[at[windows[left, k]] >= 0]
            yield size, left, at[windows[left]]


def search_block(index: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW) -> DataFrame:
    """Add the hits of one block of items to each segment's row."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(Queries(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                first, terms, bounds, places, hits = (one.column(k)[0].as_py() for k in range(1, 6))
                items_of = one.column(6)[0].as_py()
                seg = Segment(first, terms, bounds, places)
                total = int(seg.first[-1])
                old = np.frombuffer(hits, np.uint8)
                mark = np.unpackbits(old)[:total].astype(np.int32) if len(old) else np.zeros(total, np.int32)
                edge = np.zeros(total + 1, np.int32)
                for size, which, at in q.present(seg):
                    for w, terms in zip(which, at, strict=True):
                        where = seg.phrase(terms)
                        if len(where):
                            np.add.at(edge, where, 1)
                            np.add.at(edge, where + size, -1)
                            for d in np.unique(np.searchsorted(seg.first, where, "right") - 1):
                                items_of[d].extend(q.owners[size][w])
                mark = (mark + np.cumsum(edge[:-1])) > 0
                items_of = [sorted(set(x), key=lambda i: (i is None, i or "")) for x in items_of]
                yield pa.RecordBatch.from_arrays(
                    [one.column(k) for k in range(5)] + [_bin(np.packbits(mark)), pa.array([items_of], pa.list_(pa.list_(pa.string())))], one.schema.names
                )

    return index.mapInArrow(run, index.schema)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index with the hits of all items; a block of items at a time."""
    own = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text).alias("t"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)) + 64 * F.count(F.lit(1))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    for b in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64(F.coalesce("item", "t")), F.lit(n)) == b)
        index = search_block(index, sorted(((r.item, r.t) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or "")), window)
        if b + 1 < n:
            index = C.cut(index, "leaks")
    return index


def _hits(index: DataFrame, schema: str, each) -> DataFrame:
    """Rows made by each(doc_ids, first, mark, items) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                first = np.frombuffer(one.column(1)[0].as_py(), np.int32)
                mark = np.unpackbits(np.frombuffer(one.column(2)[0].as_py(), np.uint8))[: first[-1]].astype(bool)
                yield each(one.column(0).flatten(), first, mark, one.column(3)[0].as_py())

    return index.select("doc_ids", "first", "hits", "items").mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, and the sorted ids of the items with occurring windows."""
    index = C.cut(build_index(docs), "index")

    def each(ids, first, mark, items):
        c = np.concatenate([[0], np.cumsum(mark)])
        n_hit = c[first[1:]] - c[first[:-1]]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _hits(search(index, benchmark, window), f"doc_id {kind}, n_words long, n_hit long, items array<string>", each)


def proximity(docs: DataFrame, queries: list[tuple[str, str]], within: int) -> DataFrame:
    """(doc_id, query, n_matches) of the documents that hold all words of a query close together."""
    index = build_index(docs)
    wanted = []
    for name, text in queries:
        h, *_ = C.words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), C.ALNUM, lower=True)
        wanted.append((name, np.unique(h)))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                seg = Segment(*(one.column(k)[0].as_py() for k in range(1, 5)))
                ids = one.column(0).flatten()
                for name, h in shared.value:
                    at = seg.find(h)
                    if not len(at) or (at < 0).any():
                        continue
                    d, n = np.unique(np.searchsorted(seg.first, seg.near(at, within), "right") - 1, return_counts=True)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array([name] * len(d)), pa.array(n, pa.int64())], ["doc_id", "query", "n_matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(run, f"doc_id {kind}, query string, n_matches long")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    items = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0) -> DataFrame:
    """Rows whose text's share of hit words is at most ``max_share``, with all their columns."""
    key = F.unhex(F.md5(C.whole_text().cast("binary")))
    found = contamination(docs.select(key.alias("doc_id"), "text"), benchmark)
    bad = found.where(F.col("n_hit") > F.lit(max_share) * F.col("n_words")).select(F.col("doc_id").alias("bad")).distinct()
    # any text may be that of a third of all rows: rows are dealt by text and salt, verdicts to all salts
    bad = bad.withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(bad, (rows["key"] == bad["bad"]) & (rows["salt"] == bad["bad_salt"]), "left_anti").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
bi AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM bi),
sizes AS (SELECT DISTINCT size FROM bw),
di AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM di, sizes WHERE i + size - 1 <= len(w)),
m AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
