"""Window tables and their daily sums on disk, one folder per table, partitioned by day.

The reports of a day add up sums, so they read the daily sums (`rolled`) as they read window tables: by the same
names. When windows of some days change, `refresh` replaces the sums of their months only.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.plans.dws import REFUND_KEYS
from martflow.plans.warehouse import WindowTables


def write_windows(tables: Mapping[str, DataFrame], path: str, names: Iterable[str] | None = None) -> None:
    """Write window tables; days present in the result replace what was stored for them.

    Rebalancing by day keeps small days in one file and splits a large one.
    """
    for name in names or tables:
        (
            tables[name].hint("rebalance", "cur_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("cur_date")
            .parquet(f"{path}/{name}")
        )


def write_months(tables: Mapping[str, DataFrame], path: str, names: Iterable[str]) -> None:
    """Write window tables by month (yyyymm), for jobs that take whole months of them, such as `refresh`."""
    for name in names:
        rows = tables[name].withColumn("month", F.date_format("cur_date", "yyyyMM").cast("int"))
        rows.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/{name}")


def stored_windows(spark: SparkSession, path: str, names: Iterable[str]) -> WindowTables:
    """Stored window tables; a filter on cur_date, or on month where they lie by month, reads those folders only."""

    def reader(name: str):
        return lambda: spark.read.parquet(f"{path}/{name}")

    return WindowTables({name: reader(name) for name in names})


#: Window tables whose reports need days only, and what the reports group by besides; measures are all other columns.
ROLLED: dict[str, tuple[str, ...]] = {
    "home_detail": (), "user_login": (), "user_register": (), "cart_add_uu": (), "order": (), "payment_suc": (),
    "keyword": ("keyword",), "province_order": ("province_id", "province_name"), "refund": REFUND_KEYS,
}


def rolled(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A window table's sums by day and by what its reports group by."""
    df, dims = tables[name], ROLLED[name]
    measures = [c for c in df.columns if c not in ("stt", "edt", "cur_date", "month", *dims)]
    return df.groupBy("month", "cur_date", *dims).agg(*[F.sum(m).alias(m) for m in measures])


def refresh(tables: Mapping[str, DataFrame], path: str, names: Iterable[str], months: Column | None = None) -> None:
    """Write the daily sums; with `months`, a condition on `month` (yyyymm), of these months, the others stay as they are.

    Daily sums are few rows a day, so a folder holds a month: changed windows cost the sums of their months.
    """
    for name in names:
        rows = tables[name]
        if "month" not in rows.columns:
            rows = rows.withColumn("month", F.date_format("cur_date", "yyyyMM").cast("int"))
        rows = rolled({name: rows if months is None else rows.where(months)}, name)
        (
            rows.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("month").parquet(f"{path}/{name}")
        )


def stored_days(spark: SparkSession, path: str, names: Iterable[str]) -> WindowTables:
    """Stored daily sums; a filter on cur_date is checked against the files' own least and greatest day."""

    def reader(name: str):
        return lambda: spark.read.parquet(f"{path}/{name}").drop("month")

    return WindowTables({name: reader(name) for name in names})
