"""Finished tables as topics: copies whose files arrive slice by slice, one slice a micro-batch.

A slice holds the rows of a span of event time, so a stream over a topic goes through several
micro-batches: state outlives a batch, watermarks move, and what is late is late. The clock is a
topic beside the others, whose last tick moves every watermark past all rows: windows close, and
outer joins give what found no partner.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slices, and so micro-batches with rows.
BATCHES = 5
#: Bytes of one file of a slice at most, as its rows are in memory, about: a micro-batch is read by a task a file.
FILE_BYTES = 32 << 20
#: The last tick, after anything a table holds; the ticks before it; the text of a tick.
FAR, NEVER, TICK = "2200-01-01 00:00:00", "1900-01-01 00:00:00", "tick"
_NUMBER = "_slice"
#: Bytes of a row group, about: a file of long texts is read in as many parts.
GROUP_BYTES = 4 << 20
#: Bytes of the given files behind a slice at most, about, where a topic is bounded.
SLICE_BYTES = 128 << 20


def _row_bytes(schema: T.StructType) -> int:
    """Bytes of a row, about: texts count as 20, maps and arrays as ten texts."""
    wide = (T.MapType, T.ArrayType)
    return sum(200 if isinstance(f.dataType, wide) else 20 if isinstance(f.dataType, T.StringType) else 8 for f in schema.fields)


@dataclass
class Arrivals:
    """Topics under a folder; the first one's event times set the slices of all.

    A slice has a file for each task that wrote some of it, and one more for each `FILE_BYTES` of a task's rows. All
    slices of a topic have the same number, as a stream takes that many files for a micro-batch.
    """

    spark: SparkSession
    folder: str
    batches: int = BATCHES
    cuts: list[int] | None = field(default=None)

    def bound(self, *tables: DataFrame) -> None:
        """As many more slices as keep the given files behind one below `SLICE_BYTES`; before the first topic.

        A micro-batch, and with it the state that does not outlive one by much, is then bounded however large the tables are.
        """
        files = {file for rows in tables for file in rows.inputFiles()}
        self.batches = max(self.batches, -(-sum(map(self._bytes, files)) // SLICE_BYTES))

    def _slice(self, rows: DataFrame, time: str) -> Column:
        micros = F.unix_micros(time)
        if self.cuts is None:
            shares = [k / self.batches for k in range(1, self.batches)]
            self.cuts = rows.agg(F.percentile_approx(micros, shares, 10_000)).first()[0] or []
        return sum((F.coalesce(micros > cut, F.lit(False)).cast("int") for cut in self.cuts), F.lit(0))

    def topic(self, name: str, rows: DataFrame, time: str = "et", slices: Column | None = None) -> DataFrame:
        """The rows as a stream, in slices of event time, or as `slices` numbers them from 0.

        The rows are written once, a folder a slice; a stream takes files by their time, which is set slice by slice.
        """
        if slices is None:
            slices = self._slice(rows, time)
        path, key = f"{self.folder}/topics/{name}", "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key)
        # A task holds a file of each slice open, so its rows need not be sorted by slice.
        self.spark.conf.set(key, str(self.batches))
        try:
            numbered = rows.withColumn(_NUMBER, F.coalesce(slices.cast("int"), F.lit(0)))
            most = max(1, FILE_BYTES // _row_bytes(rows.schema))
            writer = numbered.write.options(**{"maxRecordsPerFile": most, "parquet.block.size": GROUP_BYTES, "compression": "zstd"})
            writer.partitionBy(_NUMBER).parquet(path)
        finally:
            self.spark.conf.set(key, before)
        rows.limit(0).write.parquet(f"{self.folder}/empty/{name}")
        return self._stream(f"{path}/{_NUMBER}=*", rows.schema, self._in_order(name))

    def _in_order(self, name: str) -> int:
        """Set the times of a topic's files, slice by slice, and fill the slices up with empty files; the files of a slice."""
        system, path = self._where(f"{self.folder}/topics/{name}")
        util, conf = self.spark._jvm.org.apache.hadoop.fs.FileUtil, self.spark._jsc.hadoopConfiguration()
        empty = self._files(f"{self.folder}/empty/{name}")[0]
        found = [self._files(f"{path}/{_NUMBER}={k}") for k in range(self.batches)]
        files, now = max(1, *map(len, found)), self.spark._jvm.java.lang.System.currentTimeMillis() // 1000 * 1000
        for k, slice_files in enumerate(found):
            for n in range(files - len(slice_files)):
                more = self._where(f"{path}/{_NUMBER}={k}/part-empty-{n}.parquet")[1]
                util.copy(system, empty, system, more, False, conf)
                slice_files.append(more)
            for file in slice_files:
                system.setTimes(file, now + k * 1000, -1)
            if system.getFileStatus(slice_files[-1]).getModificationTime() != now + k * 1000:
                raise OSError(f"{path}: a file system that keeps no set file times cannot deal out slices in order")
        return files

    def clock(self) -> DataFrame:
        """Ticks as a stream: `tick`, an idle one with each slice, and after them the one that closes everything."""
        path, files = f"{self.folder}/topics/clock", []
        for name, tick in (("idle", NEVER), ("last", FAR)):
            one = self.spark.range(0, 1, 1, 1).select(F.lit(tick).cast("timestamp").alias("tick"))
            one.write.parquet(f"{self.folder}/empty/clock-{name}")
            files += self._files(f"{self.folder}/empty/clock-{name}")
        (system, _), conf = self._where(path), self.spark._jsc.hadoopConfiguration()
        now = self.spark._jvm.java.lang.System.currentTimeMillis() // 1000 * 1000
        for k, file in enumerate([files[0]] * self.batches + [files[1]]):
            copy = self._where(f"{path}/part-{k:05d}.parquet")[1]
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, file, system, copy, False, conf)
            system.setTimes(copy, now + k * 1000, -1)
        return self._stream(path, one.schema, 1)

    def size(self) -> int:
        """Bytes of the topics' files."""
        return self._bytes(f"{self.folder}/topics")

    def _where(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _bytes(self, path: str) -> int:
        system, where = self._where(path)
        return system.getContentSummary(where).getLength() if system.exists(where) else 0

    def _files(self, path: str) -> list:
        """Files of a folder, markers and checksums aside."""
        system, where = self._where(f"{path}/part-*")
        return [status.getPath() for status in system.globStatus(where)]

    def _stream(self, path: str, schema, files: int) -> DataFrame:
        # The stream remembers all files it has listed, so no batch ends where its memory does.
        seen = max(10_000, files * (self.batches + 1))
        return self.spark.readStream.schema(schema).options(maxFilesPerTrigger=files, maxCachedFiles=seen).parquet(path)


def ticking(rows: DataFrame, clock: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows with a watermark on `time` that the clock moves too; rows without a time are left out.

    A tick passes the watermark and goes: the filter reads the event time, so Spark keeps it above. A tick's
    texts are not null, as later joins and filters let Spark drop rows without a value before the watermark sees them.
    """
    texts = {f.name: F.lit(TICK) for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    both = rows.unionByName(clock.select(F.col("tick").alias(time), *[t.alias(n) for n, t in texts.items()]), allowMissingColumns=True)
    both = both.withWatermark(time, delay)
    return both.where((F.col(time) > F.lit(NEVER).cast("timestamp")) & (F.col(time) < F.lit(FAR).cast("timestamp")))
