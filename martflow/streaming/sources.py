"""Streams over the given tables, over text folders and over topics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.sources.tables import Tables


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system Spark reads is a file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


@dataclass(frozen=True)
class StreamTables(Tables):
    """The given tables as file streams: a file, or a folder of files, of exactly that name.

    Files arrive oldest first, `files_per_trigger` at a time; 0 takes all at once.
    """

    files_per_trigger: int = 0

    def __call__(self, name: str) -> DataFrame:
        if name not in self._read:
            path = f"{self.root}/{name}.parquet"
            stream = self.spark.readStream.schema(self.spark.read.parquet(path).schema)
            if self.files_per_trigger:
                stream = stream.option("maxFilesPerTrigger", str(self.files_per_trigger))
            if is_file(self.spark, path):  # a file source takes folders only: its folder, and this name
                path, stream = self.root, stream.option("pathGlobFilter", f"{name}.parquet")
            self._read[name] = stream.parquet(path)
        return self._read[name]

    def whole(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def topic_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Committed text records of a topic from its beginning, with their arrival number.

    Needs Spark's Kafka package on the cluster. Offsets repeat across partitions, so the number
    is made of the offset and the partition: no two records share it, and it orders the records
    of one key, which live in one partition.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.isolation.level", "read_committed")
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .where("value IS NOT NULL")
        .select(F.col("value").cast("string").alias("value"), arrival_number(F.col("offset"), F.col("partition")).alias("seq"))
    )


def arrival_number(offset: Column, partition: Column) -> Column:
    """Offset first, then partition (below 65 536), in one number."""
    return F.shiftleft(offset, 16) + partition


def config_table(spark: SparkSession, url: str, table: str, sink_type: str, **options: str) -> DataFrame:
    """Routing table of a database, as snapshot rows of a configuration log.

    The filter on the sink type runs in the database.
    """
    rows = (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
        .where(F.col("sink_type") == sink_type)
    )
    return rows.select(
        F.lit("r").alias("op"), F.lit(0).cast("bigint").alias("ts"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(None).cast(rows.select(F.struct("*").alias("s")).schema["s"].dataType).alias("before"),
        F.struct("*").alias("after"),
    )

