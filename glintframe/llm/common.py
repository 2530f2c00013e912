"""Helpers shared by the operators of this subpackage.

The text operators run numpy over chunks of about a quarter megabyte, so a worker's
memory does not depend on how many documents a partition or a batch holds.
"""

from __future__ import annotations

import ctypes
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy handles at once.
CHUNK_BYTES = 1 << 18
#: Bytes of text that one block of documents should hold.
BLOCK_BYTES = 12 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, so long documents do not inflate them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a default of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "file:/tmp/checkpoints"


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later plans start there.

    ``made``: gets the folder's path, for ``discard`` when no plan needs it any more.
    """
    spark = df.sparkSession
    where = f"{checkpoint_dir(spark)}/glintframe-{uuid.uuid4().hex}"
    df.write.parquet(where)
    if made is not None:
        made.append(where)
    return spark.read.schema(df.schema).parquet(where)


def counted(df: DataFrame, made: list[str] | None = None) -> tuple[DataFrame, int]:
    """As ``cut``, with the number of rows, which the job that writes them counts."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n")), made), seen.get["n"]


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete written tables through Spark's own file system; frames that read them are of no use afterwards."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for where in made:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
    made.clear()


#: Rows of one 64-bit key that may be broadcast: some 60 MB in an executor.
BROADCAST_ROWS = 2_000_000


def small_enough(keys: DataFrame, count: int | None = None) -> DataFrame:
    """A written table of one 64-bit key, marked for broadcast if its count allows it; else joins shuffle."""
    return F.broadcast(keys) if (keys.count() if count is None else count) <= BROADCAST_ROWS else keys


def trim(result):
    """Give the memory of a worker's large arrays back to the system, once ``result`` is made from them."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)
    return result


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus == remainder


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(df: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``block_bytes`` hold the column (one cheap aggregate job)."""
    total = df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / block_bytes))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct integers, by a plain sort: for 64-bit values much faster than hashing them."""
    ranked = np.sort(values)
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] if len(ranked) else ranked


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (i, j) whose lengths add up to about ``most``; a longer row is alone."""
    i, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while i < n:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield i, min(j, n)
        i = j


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0] : offsets[-1]]


# --- hashing -----------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C13
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, grown when needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                up = np.full(n, _BASE & _MASK, np.uint64)
                up[0] = 1
                self.up = np.multiply.accumulate(up)
                down = np.full(n, _INVERSE, np.uint64)
                down[0] = 1
                self.down = np.multiply.accumulate(down)


POWERS = Powers()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P[i] = sum of codes[j] * base**j for j < i, modulo 2**64."""
    POWERS.reach(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * POWERS.up[: len(codes)], out=out[1:])
    return out


#: Codes that one polynomial spans.  Modulo 2**64 it is the same for some texts of 512 codes and more, whatever the base.
PIECE = 64


def _polynomial(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * POWERS.down[start]


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end]; equal ranges have equal hashes wherever they stand.

    A long range is hashed in pieces of ``PIECE`` codes, each mixed into the next.
    """
    size = end - start
    out = mix(_polynomial(prefix, start, np.minimum(end, start + PIECE)) + size.astype(np.uint64))
    more = np.flatnonzero(size > PIECE)
    at = start[more] + PIECE
    while len(more):
        out[more] = mix(out[more] * np.uint64(_BASE) + _polynomial(prefix, at, np.minimum(end[more], at + PIECE)))
        at = at + PIECE
        left = at < end[more]
        more, at = more[left], at[left]
    return out


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, by document, the first word's index.

    Words never cross documents, even where one ends without white space.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        glued = inner[(~_SPACE[data[inner - 1]]) & (~_SPACE[data[inner]])]
        if len(glued):
            starts, ends = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([ends, glued]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(byte_codes(data)), starts, ends)


def window_hashes(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` codes that lie within one document.

    ``first``: index of each document's first code, and the end.  Returns the
    windows' start indices and their hashes.
    """
    size = len(codes)
    if size < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.ones(size, bool)
    for e in range(1, width):  # a window may not start in the last width-1 codes of a document
        stop = first[1:] - e
        ok[stop[stop >= first[:-1]]] = False
    start = np.flatnonzero(ok)
    start = start[start + width <= size]
    return start, range_hash(prefix_hash(codes), start, start + width)
