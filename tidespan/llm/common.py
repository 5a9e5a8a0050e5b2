"""Shared pieces of the text operators: shared-folder tables, byte-level words and hashes, bit maps.

Hashes are 64-bit polynomials over bytes (for words) or over words (for windows), computed for a whole Arrow
batch at once with prefix sums; every hash is finished with a mixing step.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import importable, shared_dir

#: Texts are handled in slices of at most this many bytes (a longer single text is one slice).
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between Spark and a Python worker (Spark's own default is 64 MB; texts are long rows).
BATCH_BYTES = 4 << 20


#: A table whose plan reads fewer bytes per core than this is dealt out anew before costly work on its texts.
SPREAD_BYTES = 4 << 20
#: Rows of ids up to which a table of them is broadcast (some 16 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Tables of stored() that still exist: path -> (Hadoop file system, Hadoop path).
_live: dict[str, tuple] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table is deleted by discard(), by kept_alone(), or at the latest when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidespan_{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    _live[path] = (at.getFileSystem(sc._jsc.hadoopConfiguration()), at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    system, at = _live.pop(path)
    system.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    for df in tables:
        _delete(df.stored_at)


def kept_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stored(make()), and the tables that were stored on the way deleted."""
    before = set(_live)
    out = stored(make(), name)
    for path in set(_live) - before - {out.stored_at}:
        _delete(path)
    return out


@atexit.register
def _delete_all() -> None:
    for path in list(_live):
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly if it is so small that its few file splits would leave cores idle; else as it is."""
    sc = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(sc.defaultParallelism) if size < sc.defaultParallelism * SPREAD_BYTES else df


def give_back_heap(spark: SparkSession) -> None:
    """A full collection on every executor, after which the JVM returns heap that it doesn't need to the system.  Without
    one, an executor keeps the largest heap it ever had, next to its Python workers.  One short task for each executor;
    those of executors that are busy may go to others."""
    sc = spark.sparkContext
    n = max(1, len(sc._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is one of them
    collected = F.expr("java_method('java.lang.System', 'gc')").alias("collected")  # not deterministic, so no constant
    spark.range(0, n, 1, n).select(collected).write.format("noop").mode("overwrite").save()


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (distinct, not null, a column of the same name).  Few ids are
    broadcast, so that no text moves; more than BROADCAST_ROWS are joined by shuffle."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, column, "left_anti")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema); when a task ends, its worker gives freed memory back to the system, because workers
    live on and share an executor's memory with what comes next.  Where the session has the default, batches are limited
    to BATCH_BYTES (spark.sql.execution.arrow.maxBytesPerBatch)."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) == f"{64 << 20}b":
        conf.set(limit, f"{BATCH_BYTES}b")

    def tidy(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only in the GNU C library
            ctypes.CDLL(None).malloc_trim(0)

    importable(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of the words [^\x20\x09-\x0D]+; multi-byte characters consist of bytes over 0x7F, so bytes suffice.
SPACE_WORDS = ~byte_table((9, 13), (32, 32))
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z is lower-cased.
ALNUM_WORDS = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = {"byte": np.uint64(0x9E3779B97F4A7C15), "word": np.uint64(0xD6E8FEB86659FD93)}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the kind's odd base modulo 2**64, and of its inverse."""
    have = _powers.get(kind)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        base = int(_P[kind])
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Yield (lo, hi, bytes, offsets): rows lo..hi of the batch as one byte array; null counts as empty.  The bytes are
    those of the batch, not copies of them."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(starts, ends, doc): byte spans of the maximal runs of table's bytes, and the row that each is in."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    on = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, on[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, on[1:]
    starts = np.flatnonzero(on & (~before | cut[:n]))
    ends = np.flatnonzero(on & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power("byte", len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; those that cross a document's end are for the caller to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power("word", len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k : k + n] - total[:n]) * down[:n])


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of the LONG column modulo 2**bits, gathered as 2**bits / 64 words at most."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    cells = (
        df.select(F.shiftrightunsigned(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    out[cells.column("w").to_numpy()] = cells.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(words_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    at = h & np.uint64(len(words_) * 64 - 1)
    return (words_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
