"""What the training-data operators share: scratch tables, Arrow text access, byte-level words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one JVM (tests, a laptop) gets a folder of its own; a cluster has none that
    all of its machines see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when their SQL execution ends: its result is a written table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str, compression: str = "zstd", partition: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    a lost executor costs a re-read, and later reads do no work twice."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/turnloom-{uuid.uuid4().hex}/{name}"
    _SCRATCH.append(path)
    writer = df.write.option("compression", compression)
    with shuffle_files_go(spark):
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            _delete(df.sparkSession, path)


def mark() -> set[str]:
    """The scratch tables there are now, for ``release`` to spare."""
    return set(_SCRATCH)


def release(spark: SparkSession, spare: set[str] | None = None) -> None:
    """Delete the scratch tables of finished queries, but for those to ``spare``. Call it when no
    result is in use any more."""
    for path in [p for p in _SCRATCH if p not in (spare or ())]:
        _SCRATCH.remove(path)
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k: the folds of the training contracts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


# ---------------------------------------------------------------- Arrow text access


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back to the system: idle Python workers stay small between stages."""
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)
    pa.default_memory_pool().release_unused()


def text_parts(batch: pa.RecordBatch, column: str, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``target`` bytes (one row at least).

    Yields (first row, end row, UTF-8 bytes, offsets). A null text is an empty one.
    """
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, wide)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + target, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    trim()


# ---------------------------------------------------------------- byte-level words

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C17  # odd, so it has an inverse modulo 2**64
_U = np.uint64


def byte_class(word: str) -> np.ndarray:
    """``blank``: words are runs of anything but 0x20 and 0x09-0x0D.
    ``alnum``: runs of 0-9, A-Z, a-z and every byte of a non-ASCII character."""
    t = np.zeros(256, bool)
    if word == "blank":
        t[:] = True
        t[[0x20, 9, 10, 11, 12, 13]] = False
    else:
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


BLANK, ALNUM = byte_class("blank"), byte_class("alnum")


@functools.cache
def _table(lower: bool) -> np.ndarray:
    t = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


_BLOCK = 16  # bits of a block's size: hashing holds one block's tables, however long a text is


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            a = np.full((1 << _BLOCK) + 1, base, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit. Arrays wrap around silently."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def word_spans(buf: np.ndarray, offs: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross the texts' borders."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = cls[buf]
    new = np.zeros(len(buf) + 1, bool)
    new[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~new[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~new[1:]
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range (starts in rising order): table values times powers.

    Block by block, from prefix sums of one block; a range over several blocks adds up its pieces."""
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    up, down = _powers()
    size, first = 1 << _BLOCK, starts >> _BLOCK
    n_more = np.maximum((ends - 1 >> _BLOCK) - first, 0)
    far = np.flatnonzero(n_more)
    block = ranges(first[far] + 1, n_more[far])  # of the pieces beyond a range's first block
    owner = np.repeat(far, n_more[far])
    by = np.argsort(block, kind="stable")
    block, owner = block[by], owner[by]
    values = _table(lower)
    c = np.zeros(size + 1, _U)
    with np.errstate(over="ignore"):
        for b in np.union1d(first, block):
            lo = int(b) << _BLOCK
            part = buf[lo : lo + size]
            np.cumsum(values[part] * up[: len(part)], out=c[1 : len(part) + 1])
            i, j = np.searchsorted(first, [b, b + 1])
            s = starts[i:j] - lo
            out[i:j] += (c[np.maximum(np.minimum(ends[i:j] - lo, size), s)] - c[s]) * down[s]
            i, j = np.searchsorted(block, [b, b + 1])
            if i < j:
                own = owner[i:j]
                out[own] += c[np.minimum(ends[own] - lo, size)] * np.power(_U(_P), (lo - starts[own]).astype(_U))
        return mix64(out + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def words_of(buf: np.ndarray, offs: np.ndarray, cls: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words and the first word's index of every text (with an end)."""
    s, e = word_spans(buf, offs, cls)
    return span_hash(buf, s, e, lower), s, e, np.searchsorted(s, offs).astype(np.int64)


def sliding(h: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over h[i : i + width] for every i, by doubling."""
    m, w = h, 1
    while w * 2 <= width:
        m = op(m[:-w], m[w:])
        w *= 2
    r = width - w
    return op(m[: len(m) - r], m[r:]) if r else m


def shingle_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of k words in a row, for every start."""
    if len(h) < k:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            out = mix64(out * _U(_P) + h[i : len(h) - k + 1 + i])
    return out


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[0] .. starts[0]+lens[0]-1, starts[1] .. and so on."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    return first + np.arange(total, dtype=np.int64)
