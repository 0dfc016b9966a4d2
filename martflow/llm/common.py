"""What the text operators share: tables, the shared folder, words as arrays of hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.session import scratch

#: White space that separates words: tab, newline, vertical tab, form feed, return, space.
BLANKS = b"\t\n\x0b\x0c\r "
#: A word by the same rule, as a pattern.
WORD = r"[^\x20\x09-\x0D]+"


def bounded(spark: SparkSession) -> SparkSession:
    """Rows handed to Python at a time: whole texts are long, so a thousand, which bounds both sides' buffers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) != "1000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{root}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that all executors share."""
    return f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: a lost executor costs no recomputation."""
    path = folder(bounded(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one long job, in a folder of its own; what no later plan reads can go while the job runs."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, folder(bounded(spark), name)
        self._paths: dict[str, DataFrame] = {}
        self._number = 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{self._number}"
        self._number += 1
        df.write.parquet(path)
        self._paths[path] = self.spark.read.schema(df.schema).parquet(path)
        return self._paths[path]

    def keep(self, *tables: DataFrame | None) -> None:
        """Remove all tables but these. Spark then also removes the shuffles that made them, once they are collected."""
        for path in [p for p, df in self._paths.items() if not any(df is t for t in tables)]:
            del self._paths[path]
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.collect()

    def collect(self) -> None:
        """Let Spark remove the shuffles of plans that are done; it does so once the driver has collected them."""
        gc.collect()
        self.spark._jvm.System.gc()


#: Bits of a summary of keys, which every task gets: one megabyte, whatever the input.
SUMMARY_BITS = 1 << 23


def _slots(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(SUMMARY_BITS)) for k in range(2)]


def summary(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of fixed size, as bytes: two bits for each key. However full it gets, no key is missing."""
    bits = keys.select(F.explode(F.array(*_slots(key))).alias("bit"))
    word = F.floor(F.col("bit") / 32)
    words = bits.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("bits")).toArrow()
    full = np.zeros(SUMMARY_BITS // 32, "<u4")
    full[words["word"].to_numpy()] = words["bits"].to_numpy()
    return full.view(np.uint8)


def named(wanted: np.ndarray, key: str) -> Column:
    """Whether a summary may hold the row's key."""
    holds = lambda x: (wanted[x >> 3] >> (x & 7)) & 1 == 1
    return F.arrow_udf(lambda x, y: pa.array(holds(x.to_numpy()) & holds(y.to_numpy())), T.BooleanType())(*_slots(key))


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Return free memory to the system: Python workers stay for later tasks and keep what they once had."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def giving_back(run):
    """A function over batches that gives its free memory back when it is through."""

    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number, to size partitions and sketches."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def string_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, and where each row begins (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(column: pa.Array, size: int = 4 << 20):
    """The column in runs of rows of about `size` bytes, at least one row each."""
    wide, i = column.cast(pa.large_string()), 0
    at = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield column.slice(i, j - i)
        i = j


def batch_slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """The batch in runs of rows with about `size` bytes in the column."""
    i = 0
    for part in row_slices(batch[column], size):
        yield batch.slice(i, len(part))
        i += len(part)


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def find_words(raw: np.ndarray, at: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each word, its length, and the row it is in. `blank`: which bytes part words; a row's end does too."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~blank[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = at[(at > 0) & (at < len(raw))]
    first[edges] = ink[edges]
    starts = np.flatnonzero(first)
    upto = np.append(starts[1:], len(raw))
    count = np.concatenate([[0], np.cumsum(ink)])
    lengths = count[upto] - count[starts]
    return starts, lengths, np.searchsorted(at, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LOW: dict[int, np.ndarray] = {}


def word_hashes(raw: np.ndarray, starts: np.ndarray, seed: int, block: int = 1 << 20, blank: np.ndarray = _BLANK) -> np.ndarray:
    """A 64-bit hash of each word's bytes, `block` bytes at a time."""
    base = (0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * seed) % (1 << 64) | 1
    if base not in _LOW:
        _LOW[base] = _powers(base, 1 << 16)
    low = _LOW[base]
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(raw))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block, "left")))
        a, b = int(starts[i]), int(ends[j - 1])
        part = raw[a:b]
        value = np.where(blank[part], 0, part.astype(np.uint64) + np.uint64(1)).astype(np.uint64)
        own = starts[i:j] - a
        place = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
        weight = low[place & 0xFFFF]
        if place.max(initial=0) >> 16:  # a word of over 65,536 bytes
            weight = weight * _powers(base ^ 0x5851F42D4C957F2C, int(place.max() >> 16) + 1)[place >> 16]
        out[i:j] = np.add.reduceat(value * weight, own)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive words (rows' ends not yet regarded)."""
    n = max(0, len(words) - size + 1)
    base = np.uint64((0xD1342543DE82EF95 + 2 * 0x2545F4914F6CDD1D * seed) % (1 << 64) | 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * base + words[k : k + n]
    return mix(out)
