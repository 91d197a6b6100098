"""Exact removal of passages of ``LENGTH`` bytes or more that stand elsewhere in the corpus.

A byte goes if any ``LENGTH``-byte string that covers it also starts somewhere else, in another
document or the same one. Suffix arrays decide it, built in shards that need not hold the corpus:

1. Every window of ``LENGTH`` bytes is named by its smallest hashed ``GRAM``-byte piece. Equal
   windows have equal names, so a window is judged in one shard, that of its name. A run of
   neighbouring windows with one name is a *context*: the bytes they cover together.
2. Names found once in the distinct texts cannot repeat; only the others' contexts travel.
3. Each shard sorts the suffixes of its distinct contexts (Larsson-Sadakane doubling: only groups
   that are still tied are sorted again), and Kasai's scan gives the common prefixes.
4. A name with very many contexts is dealt over several shards. These write their distinct windows,
   sorted by fingerprint; cross-shard repeats are found by binary search while the lists merge.

Identical texts (told by a 128-bit digest) count as repeats of each other at once and travel once.
Contexts are told by 64-bit fingerprints within a shard, windows of hot names within their ranges.

Defined cases: a null text is an empty one; texts under ``LENGTH`` bytes keep all bytes; repeated
rows, and rows of one doc_id or none, are documents of their own and so repeat each other; there are
no ties, as all places of a repeated string go; columns of any name pass through ``without_repeats``
as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 21
HOT = 1000  # a text of more than a thousandth of all rows is hot
_CONTEXT = 290  # bytes of an average context, to plan shards


# ------------------------------------------------------------------ suffix arrays


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` bytes, rank of each suffix). Ties share a rank.

    Larsson-Sadakane: suffixes are sorted by a short prefix; then, with doubled prefix each round,
    only those in groups of two or more are sorted again, by the rank of the suffix ``h`` further on.
    At most 2**21 bytes, so that rank, next rank and place share one 64-bit integer.
    """
    n = len(text)
    if n > 1 << 21:
        raise ValueError("a shard holds 2**21 bytes at most")
    bits = C._U(21)
    low = C._U((1 << 21) - 1)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = min(4, depth)
    key = np.zeros(n, np.uint64)
    for i in range(h):  # nine bits a byte: what lies beyond the end is less than any byte
        key[: n - i] |= (text[i:].astype(np.uint64) + C._U(1)) << C._U(9 * (3 - i))
    packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    new = np.concatenate([[True], (packed[1:] >> bits) != (packed[:-1] >> bits)])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slots, 0))
    tied = slots[~(new & np.concatenate([new[1:], [True]]))]  # slots in groups of two or more
    while h < depth and len(tied):
        step = min(h, depth - h)
        at = sa[tied]
        further = at + step
        nxt = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        packed = np.sort((rank[at].astype(np.uint64) << C._U(42)) | (nxt.astype(np.uint64) << bits) | at.astype(np.uint64)) if n < 1 << 21 else None
        if packed is None:
            o = np.lexsort((at, nxt, rank[at]))
            group, at, nxt = rank[at][o], at[o], nxt[o]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        else:
            at = (packed & low).astype(np.int64)
            new = np.concatenate([[True], (packed[1:] >> bits) != (packed[:-1] >> bits)])
        sa[tied] = at
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        h += step
    return sa, rank


def kasai(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, cap: int, lanes: int = 16384) -> np.ndarray:
    """Common prefix (up to ``cap``) of each suffix in ``sa`` with the one before it.

    Kasai's scan in text order loses one byte a step and gains by comparing on; here many stretches
    of the text are scanned side by side, eight bytes a comparison. Suffixes that share a rank
    agree up to ``cap``; after such a pair the order of the next one is not known from it, so the
    comparison starts anew there.
    """
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    pad = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(pad, 8)[: n + cap + 8]
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lanes = max(1, min(lanes, n // 64 + 1))
    size = -(-n // lanes)
    start = np.arange(0, n, size)
    h = np.zeros(len(start), np.int64)
    tied = np.zeros(n, bool)  # suffixes that share a rank with the one before them
    tied[sa[1:]] = rank[sa[1:]] == rank[sa[:-1]]
    plcp = np.zeros(n, np.int64)
    for s in range(size):
        i = start + s
        on = i < n
        i = np.minimum(i, n - 1)
        j = before[i]
        tie = tied[i]
        h = np.where(tie, cap, np.where((h >= cap) | (j < 0), 0, np.maximum(h - 1, 0)))
        act = np.flatnonzero(on & (j >= 0) & ~tie)
        while len(act):
            x, y = i[act] + h[act], j[act] + h[act]
            room = np.minimum(cap - h[act], n - np.maximum(x, y))
            diff = eight[x] ^ eight[y]
            # bytes that agree before the first difference (little endian: the lowest set byte)
            same = np.bitwise_count((diff & (~diff + C._U(1))) - C._U(1)).astype(np.int64) >> 3
            gain = np.minimum(same, np.maximum(room, 0))
            h[act] += gain
            act = act[(gain == 8) & (room > 8)]
        plcp[i[on]] = h[on]
    return plcp[sa]


def repeated_starts(text: np.ndarray, eligible: np.ndarray, length: int) -> np.ndarray:
    """Class of each eligible start: (flag) whether its ``length`` bytes start at another one too."""
    sa, rank = suffix_array(text, length)
    lcp = kasai(text, sa, rank, length)
    group = np.cumsum(lcp < length)
    ok = eligible[sa]
    n = np.bincount(group[ok], minlength=int(group[-1]) + 1 if len(group) else 1)
    flag = np.zeros(len(text), bool)
    flag[sa] = ok & (n[group] > 1)
    return flag


# ------------------------------------------------------------------ names and contexts


def _names(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at each place, name of the window at each place); shorter by the width."""
    with np.errstate(over="ignore"):
        h = C._table(False)[buf]
        w, mul = 1, C._P
        while w < gram:
            h = h[:-w] * C._U(mul) + (h[w:] ^ (h[w:] >> C._U(29)))
            w, mul = w * 2, (mul * mul + 2 * w) & C._MASK
    h = C.mix64(h)
    return h, C.sliding(h, length - gram + 1)


def _starts(offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All window starts that stay inside a text, and the text of each."""
    n = np.maximum(np.diff(offs) - length + 1, 0)
    return C.ranges(offs[:-1], n), np.repeat(np.arange(len(n)), n)


def _anchors(length: int, gram: int, target: int):
    """Per distinct name and text: (name, text key, places that carry it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in C.text_parts(batch, "text", target):
                if len(buf) < length:
                    continue
                h, m = _names(buf, length, gram)
                s, d = _starts(offs, length)
                if not len(s):
                    continue
                # a place carries a name if some window around it, inside its text, chose its gram
                new = np.flatnonzero(np.concatenate([[True], (m[s[1:]] != m[s[:-1]]) | (d[1:] != d[:-1])]))
                last = np.append(new[1:], len(s)) - 1
                a, b, t = s[new], s[last] + length - gram, d[new]  # grams a..b belong to the run
                # inside a run the smallest gram may occur more than once: count them all
                width = b - a + 1
                place = C.ranges(a, width)
                same = h[place] == np.repeat(m[a], width)
                n = np.add.reduceat(same.astype(np.int64), np.cumsum(width) - width)
                o = np.lexsort((m[a], t))
                name, text = m[a][o], t[o]
                g = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[g].view(np.int64)), batch.column(0).take(pa.array(i + text[g])), pa.array(np.add.reduceat(n[o], g))], ["name", "key", "n"]
                )

    return run


def _z(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _u(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


_CTX_FIELDS = ["shard", "bytes", "head", "refs"]


def _contexts(length: int, gram: int, target: int, n_shards: int, per_salt: float):
    """Contexts of the wanted names, each distinct one once a part, packed by shard.

    head: per context name, fingerprint, length, hot; refs: per occurrence context, text key, place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            wanted = batch.column(2)
            for i, j, buf, offs in C.text_parts(batch, "text", target):
                if len(buf) < length:
                    continue
                _, m = _names(buf, length, gram)
                s, d = _starts(offs, length)
                if not len(s):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (m[s[1:]] != m[s[:-1]]) | (d[1:] != d[:-1])]))
                last = np.append(new[1:], len(s)) - 1
                a, e, t = s[new], s[last] + length, d[new]
                part = wanted.slice(i, j - i)
                flat = part.flatten()
                own = np.repeat(np.arange(j - i), np.asarray(pa.compute.list_value_length(part)))
                names, count = np.asarray(flat.field("name")).view(np.uint64), np.asarray(flat.field("n"))
                with np.errstate(over="ignore"):
                    tag = lambda x, y: C.mix64(x + (y.astype(np.uint64) + C._U(1)) * C._U(C._P))
                    have, want = tag(m[a], t), tag(names, own)
                by = np.argsort(want)
                if not len(by):
                    continue
                k = np.minimum(np.searchsorted(want[by], have), len(by) - 1)
                pick = np.flatnonzero(want[by][k] == have)
                if not len(pick):
                    continue
                n = count[by][k][pick]
                a, e, t = a[pick], e[pick], t[pick]
                name = m[a]
                finger = C.span_hash(buf, a, e)
                salts = np.ceil(n / per_salt).astype(np.uint64)
                hot = salts > 1
                with np.errstate(over="ignore"):
                    shard = np.where(hot, C.mix64(name + (finger % np.maximum(salts, C._U(1)) + C._U(1)) * C._U(C._P)), name)
                shard = (C.mix64(shard) % C._U(n_shards)).astype(np.int64)
                o = np.lexsort((finger, shard))
                cut = np.flatnonzero(np.concatenate([[True], (shard[o][1:] != shard[o][:-1])]))
                rows = []
                for x, y in zip(cut, np.append(cut[1:], len(o)), strict=True):
                    p = o[x:y]
                    u, at, inv = np.unique(finger[p], return_index=True, return_inverse=True)
                    q = p[at]
                    size = e[q] - a[q]
                    head = np.stack([name[q], u, size.astype(np.uint64), hot[q].astype(np.uint64)])
                    refs = np.stack([inv.astype(np.int64), keys[i:j][t[p]], a[p] - offs[t[p]]])
                    rows.append((int(shard[o[x]]), _z(buf[C.ranges(a[q], size)]), _z(head), _z(refs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(4)], _CTX_FIELDS
                )

    return run


_OUT = "kind string, r long, key long, a binary, b binary, c binary"


def _out(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "r", "key", "a", "b", "c"])


def _spans(key: np.ndarray, a: np.ndarray, e: np.ndarray) -> list[tuple]:
    """Merged byte ranges, one row a text."""
    if not len(key):
        return []
    o = np.lexsort((a, key))
    key, a, e = key[o], a[o], e[o]
    rows = []
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for x, y in zip(cut, np.append(cut[1:], len(key)), strict=True):
        reach = np.maximum.accumulate(e[x:y])
        first = np.concatenate([[True], a[x + 1 : y] > reach[:-1]])
        ends = reach[np.append(np.flatnonzero(first)[1:] - 1, y - x - 1)]
        rows.append(("span", None, int(key[x]), np.stack([a[x:y][first], ends]).astype(np.int64).tobytes(), None, None))
    return rows


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _judge(length: int, n_ranges: int, shard_bytes: int):
    """One shard: suffix array and common prefixes over its distinct contexts."""

    def run(t: pa.Table) -> pa.Table:
        texts, heads, refs, base = [], [], [], 0
        for raw, head, ref in zip(t["bytes"].to_pylist(), t["head"].to_pylist(), t["refs"].to_pylist(), strict=True):
            texts.append(_u(raw, np.uint8))
            heads.append(_u(head, np.uint64).reshape(4, -1))
            r = _u(ref, np.int64).reshape(3, -1).copy()
            r[0] += base
            refs.append(r)
            base += heads[-1].shape[1]
        text, head, ref = np.concatenate(texts), np.concatenate(heads, axis=1), np.concatenate(refs, axis=1)
        size = head[2].astype(np.int64)
        begin = np.cumsum(size) - size
        # identical contexts of different parts become one
        _, at, inv = np.unique(head[1], return_index=True, return_inverse=True)
        owner = inv[ref[0]]
        times = np.bincount(owner, minlength=len(at))
        name, size, begin, hot = head[0][at], size[at], begin[at], head[3][at] > 0
        # a name whose only context is met here, whole, needs no sorting: its windows all repeat or none does
        o = np.argsort(name, kind="stable")
        flags: list[np.ndarray] = [np.zeros(0, bool)] * len(at)
        pending: list[int] = []
        total = 0
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(group: list[int], mixed: bool) -> None:
            if not group:
                return
            g = np.array(group)
            n = size[g]
            flat = text[C.ranges(begin[g], n)]
            where = np.cumsum(n) - n
            windows = n - length + 1
            eligible = np.zeros(len(flat), bool)
            eligible[C.ranges(where, windows)] = True
            flag = repeated_starts(flat, eligible, length)
            for k, c in enumerate(group):
                f = flag[where[k] : where[k] + windows[k]]
                flags[c] = np.ones(windows[k], bool) if times[c] > 1 else f
            spread = g[hot[g] | mixed]
            if len(spread):
                pos = np.flatnonzero(np.isin(g, spread))
                p = C.ranges(where[pos], windows[pos])
                finger = C.span_hash(flat, p, p + length)
                ctx = np.repeat(g[pos], windows[pos])
                off = C.ranges(np.zeros(len(pos), np.int64), windows[pos])
                fresh.append((finger, ctx, off))

        first = np.unique(name[o], return_index=True)[1]
        for x, y in zip(first, np.append(first[1:], len(o)), strict=True):
            own = o[x:y].tolist()
            weight = int(size[own].sum())
            if weight > shard_bytes:  # one name fills more than a shard: several, merged like those of a hot one
                some, w = [], 0
                for c in own:
                    if w + size[c] > shard_bytes and some:
                        settle(some, True)
                        some, w = [], 0
                    if size[c] > shard_bytes:
                        settle_long(c, flags, text, begin, size, times, length)
                        fp = C.span_hash(text, begin[c] + np.arange(size[c] - length + 1), begin[c] + np.arange(size[c] - length + 1) + length)
                        fresh.append((fp, np.full(len(fp), c), np.arange(len(fp))))
                        continue
                    some.append(c)
                    w += int(size[c])
                settle(some, True)
                continue
            if total + weight > shard_bytes:
                settle(pending, False)
                pending, total = [], 0
            pending += own
            total += weight
        settle(pending, False)

        keys, starts, ends = [], [], []
        by = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by], np.arange(len(at) + 1))
        for c, flag in enumerate(flags):
            if flag.any():
                a, e = _runs(flag)
                who = by[edges[c] : edges[c + 1]]
                keys.append(np.repeat(ref[1][who], len(a)))
                starts.append((ref[2][who][:, None] + a[None, :]).ravel())
                ends.append((ref[2][who][:, None] + (e + length - 1)[None, :]).ravel())
        rows = _spans(*(np.concatenate(x) for x in (keys, starts, ends))) if keys else []
        flat_flags = np.concatenate(flags)
        flag_at = np.cumsum([0] + [len(f) for f in flags])
        for finger, ctx, off in fresh:
            done = flat_flags[flag_at[ctx] + off]
            one = by[edges[ctx]]  # an undecided window has one place only
            key, place = np.where(done, 0, ref[1][one]), np.where(done, -1, ref[2][one] + off)
            r = (finger % C._U(n_ranges)).astype(np.int64)
            o2 = np.lexsort((place, finger, r))
            first = np.concatenate([[True], finger[o2][1:] != finger[o2][:-1]])
            o2 = o2[first]
            cut = np.flatnonzero(np.concatenate([[True], r[o2][1:] != r[o2][:-1]]))
            for x, y in zip(cut, np.append(cut[1:], len(o2)), strict=True):
                p = o2[x:y]
                rows.append(("list", int(r[p[0]]), None, _z(finger[p]), _z(key[p]), _z(place[p].astype(np.int64))))
        C.trim()  # between groups, not only between batches: a worker judges many shards
        return _out(rows)

    return run


def settle_long(c: int, flags: list, text: np.ndarray, begin: np.ndarray, size: np.ndarray, times: np.ndarray, length: int) -> None:
    """A single context over a shard's size (a periodic stretch of one text): exact by fingerprints."""
    p = begin[c] + np.arange(size[c] - length + 1)
    _, inv, n = np.unique(C.span_hash(text, p, p + length), return_inverse=True, return_counts=True)
    flags[c] = (n[inv] > 1) | (times[c] > 1)


def merge_shards(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of windows that stand in two shards or more.

    Each list is sorted by fingerprint and names a window once; it is looked up by binary search in
    all that came before, then merged into it.
    """
    seen = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, places = [], []
    for finger, key, place in lists:
        at = np.searchsorted(seen[0], finger)
        k = np.minimum(at, max(0, len(seen[0]) - 1))
        hit = seen[0][k] == finger if len(seen[0]) else np.zeros(len(finger), bool)
        for kk, pp in ((key[hit], place[hit]), (seen[1][k[hit]], seen[2][k[hit]])):
            keys.append(kk[pp >= 0])
            places.append(pp[pp >= 0])
        seen[2][k[hit]] = -1  # told once
        new = ~hit
        seen = tuple(np.insert(s, at[new], x[new]) for s, x in zip(seen, (finger, key, place), strict=True))
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merge(length: int):
    def run(t: pa.Table) -> pa.Table:
        lists = [(_u(a, np.uint64), _u(b, np.int64), _u(c, np.int64)) for a, b, c in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["c"].to_pylist(), strict=True)]
        key, place = merge_shards(lists)
        return _out(_spans(key, place, place + length))

    return run


# ------------------------------------------------------------------ the operator


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, name_bytes: int = 1 << 17, part_bytes: int = 1 << 20, shard_bytes: int = SHARD_BYTES, n_shards: int | None = None) -> DataFrame:
    """(row, copies, spans): each row of ``docs``, how many rows have its text, and the repeated
    ranges of the text, as lists of packed starts and ends."""
    spark = docs.sparkSession
    text = C.whole_text()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    anchors = keyed.select("key", "text").mapInArrow(_anchors(length, gram, name_bytes), "name long, key binary, n long")
    anchors = C.cut(anchors.groupBy("name", "key").agg(F.max("n").alias("n")), "anchors")
    names = anchors.groupBy("name").agg(F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("n > 1 OR lo < hi").select("name", "n")
    wanted = anchors.select("name", "key").join(names, "name").groupBy("key").agg(F.collect_list(F.struct("name", "n")).alias("names"))
    copies = C.cut(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    rows = int(copies.agg(F.sum("copies")).first()[0] or 0)
    # inside the shards a text goes by a number, which this table fixes
    wanted = C.cut(wanted.join(copies, "key").select("key", F.monotonically_increasing_id().alias("num"), "rep", "names"), "wanted")
    C.forget(anchors)
    total = int(wanted.select(F.sum(F.size("names"))).first()[0] or 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = n_shards or max(parts, total * _CONTEXT // (4 * shard_bytes) + 1)
    per_salt = max(64.0, total / shards / 2, 1.0)
    per_salt = min(per_salt, shard_bytes / 2 / _CONTEXT)
    own = keyed["id"].eqNullSafe(wanted["rep"]) & (keyed["key"] == wanted["key"])
    contexts = keyed.select("id", "key", "text").join(wanted, own).select("num", "text", "names")
    contexts = contexts.mapInArrow(_contexts(length, gram, part_bytes, shards, per_salt), "shard long, bytes binary, head binary, refs binary")
    judged = C.cut(contexts.groupBy("shard").applyInArrow(_judge(length, shards, shard_bytes), _OUT), "judged", "none", "kind")
    merged = judged.where("kind = 'list'").select("r", "a", "b", "c").groupBy("r").applyInArrow(_merge(length), _OUT)
    spans = judged.where("kind = 'span'").select("key", "a").unionAll(merged.select("key", "a")).groupBy("key").agg(F.collect_list("a").alias("spans"))
    spans = spans.join(wanted.select("num", F.col("key").alias("text_key")), spans["key"] == wanted["num"]).select("text_key", "spans")
    many = copies.where("copies > 1")
    info = many.join(spans, many["key"] == spans["text_key"], "full_outer").select(F.coalesce("key", "text_key").alias("k"), F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    info = C.cut(info, "spans")
    C.forget(judged, wanted)
    # at most HOT texts are hot. Their rows, which go whole or not at all, meet the number of their
    # copies where they are; the rest meet theirs by key
    hot = copies.where("copies > 1").where(F.col("copies") * HOT > F.lit(rows)).select("key", "copies")
    warm = keyed.select("row", "key").join(F.broadcast(hot), "key").select("row", "copies", F.lit(None).cast("array<binary>").alias("spans"))
    cold = keyed.select("row", "key").join(F.broadcast(hot.select("key")), "key", "left_anti")
    return warm.unionByName(cold.join(info, cold["key"] == info["k"], "left").select("row", "copies", "spans"))


def removed_mask(n: int, copies: int | None, spans: list[bytes] | None, length: int) -> np.ndarray:
    mask = np.zeros(n + 1, np.int32)
    if (copies or 1) > 1 and n >= length:
        return np.ones(n, bool)
    for s in spans or []:
        a, e = np.frombuffer(s, np.int64).reshape(2, -1)
        np.add.at(mask, a, 1)
        np.add.at(mask, e, -1)
    return np.cumsum(mask)[:n] > 0


def query(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digest = [], [], [], []
            for text, copies, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                gone = removed_mask(len(raw), copies, spans, length)
                n_bytes.append(len(raw))
                n_removed.append(int(gone.sum()))
                n_spans.append(len(_runs(gone)[0]))
                digest.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeats(docs.select("doc_id", "text"), length, **how).select("row.*", "copies", "spans")
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """``docs`` with the repeated ranges cut out of ``text``; a character that is cut in part goes.
    All other columns stay as they are."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, spans in zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1)), strict=True):
                if text is None:
                    out.append(None)
                    continue
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = removed_mask(len(raw), copies, spans, length)
                out.append(raw[~gone].tobytes().decode(errors="ignore") if gone.any() else text)
            cols = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    found = repeats(docs, length, **how)
    cols = [F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(names)]
    return found.select(*cols, "copies", "spans").mapInArrow(run, docs.schema)
