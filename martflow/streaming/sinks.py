"""Sinks for micro-batches. All are idempotent: a repeated batch overwrites its own part."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from martflow.operators.first import latest_version

Batch = Callable[[DataFrame, int], None]


def write_part(df: DataFrame, path: str, batch_id: int, *by: str) -> None:
    """Rows of one batch under `batch_id=…/by=…`.

    The batch's folder is replaced whole, so nothing of an earlier try stays, whatever that one
    wrote; other batches are left alone.
    """
    writer = df.write.mode("overwrite").options(partitionOverwriteMode="static", compression="zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/batch_id={batch_id}")


def drop_part(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what a batch wrote, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_parts(like: DataFrame, path: str) -> DataFrame:
    """Everything written so far, with `batch_id`; empty before the first batch."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return like.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.withColumn("batch_id", F.lit(-1).cast("bigint")).where(F.lit(False))


def read_part(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """What one batch wrote, in the columns of `like`."""
    return read_parts(like, path).where(F.col("batch_id") == batch_id).select(*like.columns)


@dataclass(frozen=True)
class UpsertTable:
    """An upsert table in buckets by key hash, merged when it is read, compacted bucket by bucket.

    A batch writes one folder, `batch_id=…/bucket=…`: its own rows, and of the buckets whose turn it is also
    the current rows of the batches before. Every bucket has its turn once in `every` batches, so a batch compacts
    one part in `every` of the table and a reader opens `every` folders, however long the stream has run. A repeated
    batch replaces its folder and reads earlier ones only. The latest row of a key is that of the greatest
    `order`, then of the last batch; a row whose `deleted` is true removes the key, and is kept as a mark, as a
    change that `order` puts before it may still arrive. A folder goes once neither a reader nor a repeated batch
    reads it: the last `every` and one more stay.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int = 16
    every: int = 4

    def _parts(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What the buckets hold after a batch, each from its last turn on."""
        first = max(0, batch_id - self.every + 1)
        paths = [f"{self.path}/batch_id={k}" for k in range(first, batch_id + 1)]
        more = [T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
        rows = spark.read.schema(T.StructType([*self.schema.fields, *more])).option("basePath", self.path).parquet(*paths)
        since = F.lit(batch_id) - F.pmod(F.col("bucket") + batch_id, F.lit(self.every))
        return rows.where(F.col("batch_id") >= since)

    def write(self, df: DataFrame, batch_id: int) -> None:
        rows = df.select(*self.schema.names).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        if batch_id:
            before = self._parts(df.sparkSession, batch_id - 1)
            turn = F.pmod(F.col("bucket") + batch_id, F.lit(self.every)) == 0
            rows = rows.unionByName(before.where(turn))
        # The sort by bucket and key that finds the latest is the one that the files are written in.
        kept = latest_version(rows, ["bucket", *self.keys], [*self.order, "batch_id"])
        write_part(kept.drop("batch_id"), self.path, batch_id, "bucket")
        if batch_id > self.every:
            drop_part(df.sparkSession, self.path, batch_id - self.every - 1)

    def read(self, spark: SparkSession, batch_id: int, *by: str) -> DataFrame:
        """Current rows after a batch; dealt out by `by`, some of the keys, so that what groups or joins by them shuffles no more."""
        rows = self._parts(spark, batch_id)
        rows = latest_version(rows.repartition(*by) if by else rows, list(self.keys), [*self.order, "batch_id"])
        rows = rows.drop("batch_id", "bucket")
        return rows.where("NOT coalesce(deleted, false)").drop("deleted") if "deleted" in self.schema.names else rows


def append_sink(path: str, *by: str) -> Batch:
    """Plain parts, e.g. one folder per destination or per day."""
    return lambda df, batch_id: write_part(df, path, batch_id, *by)


def text_sink(path: str, *by: str) -> Batch:
    """Records as JSON text, one `value` per line."""

    def write(df: DataFrame, batch_id: int) -> None:
        rest = [c for c in df.columns if c not in by]
        lines = df.select(*by, F.to_json(F.struct(*rest)).alias("value"))
        writer = lines.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*by) if by else writer).text(f"{path}/batch_id={batch_id}")

    return write


def read_current(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Latest row per key of an upsert table; a key whose latest row is a tombstone is gone.

    A tombstone is a row whose `deleted` is true; tables without that column have none.
    """
    rows = latest_version(spark.read.parquet(path), keys, [*order, "batch_id"]).drop("batch_id")
    return rows.where("NOT coalesce(deleted, false)").drop("deleted") if "deleted" in rows.columns else rows


def read_sums(spark: SparkSession, path: str, measures: Sequence[str]) -> DataFrame:
    """Window table whose batches hold partial sums."""
    rows = spark.read.parquet(path)
    keys = [c for c in rows.columns if c not in (*measures, "batch_id")]
    return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def start(df: DataFrame, sink: Batch, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Begin to process what is there, then stop; `trigger` replaces the availableNow trigger."""
    writer: DataStreamWriter = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def run(df: DataFrame, sink: Batch, checkpoint: str, mode: str = "append", **trigger) -> None:
    start(df, sink, checkpoint, mode, **trigger).awaitTermination()
