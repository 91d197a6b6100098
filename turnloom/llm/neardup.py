"""Near duplicates by DartMinHash signatures, banded joining and exact checks.

Signatures: the (weight x rank) region of every element is cut into cells of fixed shape; each
cell throws a hashed, Poisson-distributed number of darts, each at a hashed place and coordinate.
A coordinate keeps its dart of the earliest rank. Two texts agree on a coordinate with the
probability of their weighted Jaccard similarity, and a text throws about t ln t + 2t darts in all,
however many elements it has.

Identical texts are one text with copies. Texts that agree on a whole band are candidates. Each is
checked against the band's centre, by the exact Jaccard similarity of their shingle sets; then every
pair of a band that these links leave in different components is checked too: pair by pair in small
bands, in large ones block by block (a task holds two blocks of bounded size and names a forest of
their links). Classes are the connected components of the links.

A node is a text, whatever ids its rows have: its name is the smallest of these followed by the
text's 128-bit digest, so the smallest node of a class also names the class.

Words: runs of anything but blanks, A-Z lower-cased. A text of fewer words than a shingle is one
shingle. Defined cases: null is the empty text; texts without words are duplicates only of texts
that equal them; repeated rows are copies; rows of one doc_id with different texts are judged text
by text; rows without a doc_id belong to the class of their text, whose class_id is null only if all
its rows lack one; ties go to the smaller doc_id, then the smaller digest; columns other than doc_id
and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from . import common as C
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 130
ROWS = 5  # of a band: 1 - (1 - 0.8**5)**26 > 0.99996 of the pairs at the threshold share a band
FINEST = 1  # the lowest rank cell is 2**-FINEST wide
SMALL = 16  # texts of a band up to which its pairs are rows
BLOCK = 1024  # texts of a large band that are compared as one matrix, or as many as
BLOCK_BYTES = 4 << 20  # of shingles


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> C._U(11)).astype(np.float64) * 2.0**-53


def _cells(reach: float) -> list[tuple[float, float]]:
    """Rank cells that cover [0, reach): dyadic below 1, of width 1 above."""
    out, a, b = [], 0.0, 2.0**-FINEST
    while a < reach:
        out.append((a, b))
        a, b = b, b * 2 if b < 1 else b + 1
    return out


def dart_minhash(elements: np.ndarray, owner: np.ndarray, n: int, t: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """(n, t) signatures of ``n`` weighted sets; ``owner`` names each element's set.

    Weight w spans the strips [0, 1), [1, 2), .. of the weight axis, the last one in part. Repeats
    of an element throw the same darts. A set without elements has all zeros.
    """
    best = np.full(n * t, np.inf)
    sig = np.zeros(n * t, np.uint64)
    with np.errstate(over="ignore"):
        base = C.mix64(elements + C._U(seed) * C._U(C._P))
    share = np.ones(len(base))
    if weights is not None:
        strips = np.maximum(np.ceil(weights), 0).astype(np.int64)
        strip = C.ranges(np.zeros(len(base), np.int64), strips)
        share = np.minimum(np.repeat(weights, strips) - strip, 1.0)
        with np.errstate(over="ignore"):
            base = C.mix64(np.repeat(base, strips) + strip.astype(np.uint64) * C._U(0xC2B2AE3D27D4EB4F))
        owner = np.repeat(owner, strips)
    mass = np.bincount(owner, weights=share, minlength=n)
    reach = np.where(mass > 0, (t * np.log(t) + 2 * t) / np.maximum(mass, 1e-300), 0)
    todo = mass > 0
    done_to = np.zeros(n)  # ranks below this have been thrown
    while todo.any():
        act = np.flatnonzero(todo[owner])
        far, near = reach[owner[act]], done_to[owner[act]]
        for c, (lo, hi) in enumerate(_cells(float(far.max()))):
            live = far > lo
            if not live.all():
                act, far, near = act[live], far[live], near[live]
            pick = act[near < hi]
            if not len(pick):
                continue
            with np.errstate(over="ignore"):
                cell = C.mix64(base[pick] ^ (C._U(c + 1) * C._U(0xA0761D6478BD642F)))
            u, width = _unit(cell), hi - lo
            p = np.exp(-width)
            above, k = p, 0
            while len(pick):
                live = u >= above  # more than k darts
                pick, cell, u = pick[live], cell[live], u[live]
                if not len(pick):
                    break
                k += 1
                with np.errstate(over="ignore"):
                    dart = C.mix64(cell + C._U(k) * C._U(0xE7037ED1A0B428DB))
                    rank = lo + width * _unit(C.mix64(dart ^ C._U(0x8EBC6AF09C88C6E3)))
                    where = C.mix64(dart ^ C._U(0x589965CC75374CC3))
                hit = np.ones(len(pick), bool) if weights is None else _unit(C.mix64(dart ^ C._U(0x1D8E4E27C47D124F))) < share[pick]
                slot = owner[pick] * t + (where % C._U(t)).astype(np.int64)
                slot, rank, dart = slot[hit], rank[hit], dart[hit]
                np.minimum.at(best, slot, rank)
                won = best[slot] == rank
                sig[slot[won]] = dart[won]
                p = p * width / k
                above += p
                if p < 1e-18 and above >= 1 - 1e-15:
                    break
        done_to = np.where(todo, _cover(reach), done_to)
        todo &= np.isinf(best.reshape(n, t)).any(axis=1)
        reach = reach * 2
    return sig.reshape(n, t)


def _cover(reach: np.ndarray) -> np.ndarray:
    """The end of the last cell thrown for each reach."""
    low = 2.0 ** np.maximum(np.ceil(np.log2(np.maximum(reach, 2.0**-FINEST))), -FINEST)
    return np.where(reach <= 0, 0, np.where(reach <= 1, low, np.ceil(reach)))


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, its text), repeats included; nothing for a text without words."""
    h, _, _, first = C.words_of(buf, offs, C.BLANK, lower=True)
    n = np.diff(first)
    at = C.ranges(first[:-1], np.maximum(n - k + 1, 0))
    owner = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    out = C.shingle_hash(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([C.shingle_hash(h[first[d] : first[d + 1]], int(n[d]))[0] for d in short], np.uint64)
        out, owner = np.concatenate([out, own]), np.concatenate([owner, short])
    return out, owner


def _signatures(t: int, rows: int, k: int, target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text", target):
                sh, owner = shingles(buf, offs, k)
                sig = dart_minhash(sh, owner, j - i, t)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (j - i, t // rows)).copy()
                    for r in range(rows):
                        key = C.mix64(key * C._U(C._P) + sig[:, r::rows])
                some = np.bincount(owner, minlength=j - i) > 0
                size = np.where(some, t // rows, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(key[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), bands], ["doc_id", "key", "bands"])

    return run


def _sets(k: int, target: int):
    """Sorted distinct shingles of each text, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text", target):
                sh, owner = shingles(buf, offs, k)
                sh = sh >> C._U(16)
                o = np.lexsort((sh, owner))
                sh, owner = sh[o], owner[o]
                new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])]) if len(sh) else np.zeros(0, bool)
                sh, owner = sh[new], owner[new]
                raw = sh.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                cut = np.searchsorted(owner, np.arange(j - i + 1)) * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["node", "shingles"])

    return run


def _set_of(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims, last, held = [], None, None
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if x is not last:
                last, held = x, _set_of(x)
            z = _set_of(y)
            if not len(held) or not len(z):
                sims.append(0.0)
                continue
            at = np.minimum(np.searchsorted(held, z), len(held) - 1)
            both = int((held[at] == z).sum())
            sims.append(both / (len(held) + len(z) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])


def _forest(a: list, b: list) -> list[int]:
    """The places of those pairs that join parts not joined before."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out.append(k)
    return out


def _block_links(threshold: float):
    """Links between a block's texts ``x`` and its texts ``y`` (or within ``x``, if there are no
    ``y``) of different roots, as far as they join roots not joined before."""

    def run(t: pa.Table) -> pa.Table:
        node, root, y = t["node"].to_pylist(), t["root"].to_pylist(), np.asarray(t["y"].to_pylist(), bool)
        sets = [_set_of(r) for r in t["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        _, word, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        own, word = np.repeat(np.arange(len(sets)), size)[n[word] > 1], word[n[word] > 1]
        by = np.argsort(word, kind="stable")
        own, word = own[by], np.unique(word[by], return_inverse=True)[1]
        rows, cols = np.flatnonzero(~y), np.flatnonzero(y) if y.any() else np.flatnonzero(~y)
        both = np.zeros((len(rows), len(cols)), np.float32)
        step = 4096
        for lo in range(0, int(word[-1]) + 1 if len(word) else 0, step):
            i, j = np.searchsorted(word, [lo, lo + step])
            m = np.zeros((len(sets), step), np.float32)
            m[own[i:j], word[i:j] - lo] = 1
            both += m[rows] @ m[cols].T
        sim = both.astype(float) / np.maximum(size[rows][:, None] + size[cols][None] - both, 1)
        label = np.unique(np.array(root), return_inverse=True)[1]
        r, c = np.nonzero((sim >= threshold) & (label[rows][:, None] != label[cols][None]))
        keep = _forest(label[rows[r]].tolist(), label[cols[c]].tolist())
        found = [(*sorted((node[rows[r[k]]], node[cols[c[k]]])), float(sim[r[k], c[k]])) for k in keep]
        return pa.table({n: pa.array([x[k] for x in found], t) for k, (n, t) in enumerate((("a", pa.binary()), ("b", pa.binary()), ("sim", pa.float64())))})

    return run


def _blocks(members: DataFrame, sets: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(band, i, j, y, node, root, shingles): the texts of each pair of blocks to compare. Texts of a
    band's commonest root are all in one component, so their blocks meet only the others' blocks."""
    some = members.join(large, "band").withColumn("major", F.col("root") == F.col("top"))
    some = some.join(sets, "node").select("band", "node", "root", "major", "shingles")
    tally = [F.greatest(F.ceil(F.count(F.when(w, 1)) / block), F.ceil(F.coalesce(F.sum(F.when(w, F.length("shingles"))), F.lit(0)) / BLOCK_BYTES)).cast("int").alias(n) for w, n in ((~F.col("major"), "p"), (F.col("major"), "q"))]
    some = some.join(some.groupBy("band").agg(*tally), "band")
    own = F.pmod(F.xxhash64("node", "band"), F.when(F.col("major"), F.col("q")).otherwise(F.col("p"))).cast("int")
    # blocks of the others are 0 .. p - 1, those of the commonest root p .. p + q - 1
    some = some.withColumn("own", F.when(F.col("major"), F.col("p") + own).otherwise(own))
    other = F.when(F.col("major"), F.sequence(F.lit(0), F.col("p") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))
    some = some.withColumn("other", F.explode(other))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return some.select("band", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).alias("y"), "node", "root", "shingles")


def _node(kind: DataType, doc_id: Column, key: Column) -> Column:
    """A flag, the id in bytes that sort as ids do, and the text's digest; nodes without an id come last."""
    if isinstance(kind, IntegralType):
        raw = F.unhex(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        raw = F.concat(F.encode(doc_id.cast("string"), "utf-8"), F.lit(b"\0"))
    return F.coalesce(F.concat(F.lit(b"\0"), raw, key), F.concat(F.lit(b"\1"), key))


def _id_of(kind: DataType, node: Column) -> Column:
    size = F.length(node)
    if isinstance(kind, IntegralType):
        own = (F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast(kind)
    else:
        own = F.decode(F.substr(node, F.lit(2), size - F.lit(18)), "utf-8").cast(kind)
    return F.when(size > 17, own)


def links(
    docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, t: int = COORDINATES, rows: int = ROWS, part_bytes: int = 1 << 22, small: int = SMALL, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, key; texts: key, node, copies; links: a, b, sim). Links join nodes; they
    suffice to join all the texts of a class, and between texts joined by others some are left out."""
    field = docs.schema["doc_id"].dataType
    kind = field.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    keyed = docs.select("doc_id", key.alias("key"), text.alias("text"))
    signed = C.cut(keyed.mapInArrow(_signatures(t, rows, k, part_bytes), f"doc_id {kind}, key binary, bands array<long>"), "signatures")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    texts = C.cut(texts.withColumn("node", _node(field, F.col("id"), F.col("key"))), "texts")

    bands = C.cut(texts.select(F.col("node"), F.explode("bands").alias("band")), "bands")
    # a centre is the first text of its band in an order that goes by the band too, so that a text
    # meets several centres over its bands
    first = F.min(F.struct(F.xxhash64("node", F.pmod("band", F.lit(4))).alias("h"), F.col("node").alias("n"))).getField("n")
    centres = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), first.alias("centre")).where("m > 1").select("band", "centre")
    met = C.cut(bands.join(centres, "band").where("node <> centre").select("band", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), "node"), "met")
    C.forget(bands)
    pairs = C.cut(met.select("a", "b").distinct(), "pairs")
    need = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    own = texts.join(need, "node", "left_semi").select("node", "id", F.col("key").alias("k"))
    full = keyed.join(own, keyed["doc_id"].eqNullSafe(own["id"]) & (keyed["key"] == own["k"])).select("node", "text")
    sets = C.cut(full.mapInArrow(_sets(k, part_bytes), "node binary, shingles binary").dropDuplicates(["node"]), "sets", "none")

    def check(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return C.cut(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_similar, "a binary, b binary, sim double"), "similar")

    tried = check(pairs)
    found = tried.where(F.col("sim") >= threshold)

    # the centres are done; of the others of a band, those pairs are open that have different roots
    roots = components(found.select("a", "b"))
    members = C.cut(met.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "members")
    C.forget(met, pairs)
    counts = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.groupBy("band").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("r"), F.max(F.struct("n", "root")).getField("root").alias("top")).where("r > 1")
    open_ = C.cut(open_.select("band", "m", "top"), "open")
    few = members.join(open_.where(F.col("m") <= small).select("band"), "band")
    one, two = (few.select("band", F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in "ab")
    pairs = one.join(two, "band").where("a < b AND ra <> rb").select("a", "b").distinct()
    pairs = C.cut(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    found = found.unionAll(check(pairs).where(F.col("sim") >= threshold))
    blocks = _blocks(members, sets, open_.where(F.col("m") > small).select("band", "top"), block)
    linked = C.cut(blocks.groupBy("band", "i", "j").applyInArrow(_block_links(threshold), "a binary, b binary, sim double"), "linked")
    C.forget(members, open_, pairs, sets)
    return signed.select("doc_id", "key"), texts.select("key", "node", "copies"), found.unionAll(linked.dropDuplicates(["a", "b"]))


HOT = 1000  # a text of more than a thousandth of all rows is hot, so there are at most as many


def _rows_of(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, key; named, one row a text: key, node, root, copies; its hot rows)."""
    members, texts, found = links(docs, **how)
    found = C.cut(found, "links")
    roots = components(found.select("a", "b"))
    named = C.cut(texts.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "copies"), "classes")
    C.forget(found)
    total = named.agg(F.sum("copies")).first()[0] or 0
    return members, named, named.where(F.col("copies") * HOT > F.lit(total))


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), copies (rows with the same text)."""
    kind = docs.schema["doc_id"].dataType
    members, named, hot = _rows_of(docs, **how)
    class_of = named.select("key", _id_of(kind, F.col("root")).alias("class_id"), "copies")
    # a hot text's rows meet it where they are; the rest meet theirs by key
    few = class_of.join(F.broadcast(hot.select("key")), "key", "left_semi")
    many = members.join(F.broadcast(hot.select("key")), "key", "left_anti").join(class_of, "key")
    return members.join(F.broadcast(few), "key").unionByName(many).select("doc_id", "class_id", "copies")


def query(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each class, that of the smallest doc_id, with all its columns; of
    rows that repeat both doc_id and text, one."""
    kind = docs.schema["doc_id"].dataType
    _, named, _ = _rows_of(docs.select("doc_id", "text"), **how)
    keep = named.where("node = root").select(F.col("key").alias("k"), _id_of(kind, F.col("node")).alias("i"))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(C.whole_text().cast("binary"))).alias("key"), F.col("doc_id").alias("id"))
    return rows.join(keep, (rows["key"] == keep["k"]) & rows["id"].eqNullSafe(keep["i"])).dropDuplicates(["key"]).select("row.*")
