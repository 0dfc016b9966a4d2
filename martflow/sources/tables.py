"""The given Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from martflow.session import prepare


@dataclass(frozen=True)
class Tables:
    """A folder of Parquet tables, read lazily: `Tables(spark, root)("orders")`."""

    spark: SparkSession
    root: str
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        prepare(self.spark)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._read[name]

    def whole(self, name: str) -> DataFrame:
        """The table as a finished one, also where tables arrive as streams: the side of a join that is there."""
        return self(name)
