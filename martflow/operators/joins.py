"""Joins of facts with dimensions and of facts with facts.

No broadcast is forced: Spark broadcasts a side when its size, known or measured at run
time, is below `spark.sql.autoBroadcastJoinThreshold`, and otherwise shuffles both sides,
splitting hot partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(
    df: DataFrame, dim: DataFrame, key: str, columns: Mapping[str, str], dim_key: str = "id"
) -> DataFrame:
    """Left join with a dimension; `columns` maps new names to dimension columns.

    The dimension has one row per key. Rows without a match keep NULLs.
    """
    side = dim.select(
        F.col(dim_key).alias("_id"), *[F.col(src).alias(name) for name, src in columns.items()]
    )
    return df.join(side, F.col(key) == F.col("_id"), "left").drop("_id")


def flat_sku(
    sku: DataFrame,
    spu: DataFrame,
    trademark: DataFrame,
    category3: DataFrame,
    category2: DataFrame,
    category1: DataFrame,
) -> DataFrame:
    """The six product dimensions as one row per sku.

    The chain is resolved between the dimensions, so a fact is joined (and, if the result
    is large, shuffled) once instead of six times. An id is NULL where its row is missing.
    """
    c3 = category3.select(
        F.col("id").alias("category3_id"), F.col("name").alias("category3_name"),
        F.col("category2_id").alias("_c2"),
    )
    c2 = category2.select(
        F.col("id").alias("category2_id"), F.col("name").alias("category2_name"),
        F.col("category1_id").alias("_c1"),
    )
    c1 = category1.select(F.col("id").alias("category1_id"), F.col("name").alias("category1_name"))
    tm = trademark.select(F.col("id").alias("trademark_id"), F.col("tm_name").alias("trademark_name"))
    sp = spu.select(F.col("id").alias("spu_id"), "spu_name")
    base = sku.select(
        F.col("id").alias("sku_id"), "sku_name", "price", F.col("spu_id").alias("_spu"),
        F.col("tm_id").alias("_tm"), F.col("category3_id").alias("_c3"),
    )
    return (
        base.join(sp, F.col("_spu") == F.col("spu_id"), "left")
        .join(tm, F.col("_tm") == F.col("trademark_id"), "left")
        .join(c3, F.col("_c3") == F.col("category3_id"), "left")
        .join(c2, F.col("_c2") == F.col("category2_id"), "left")
        .join(c1, F.col("_c1") == F.col("category1_id"), "left")
        .drop("_spu", "_tm", "_c3", "_c2", "_c1")
    )


def with_sku(df: DataFrame, flat: DataFrame, key: str = "sku_id") -> DataFrame:
    side = flat.withColumnRenamed("sku_id", "_sku")
    return df.join(side, F.col(key) == F.col("_sku"), "left").drop("_sku")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    left_time: str,
    right_time: str,
    within_seconds: int,
) -> DataFrame:
    """Pairs of equal key whose right time lies in [left time - within, left time].

    Time is cut into bins of the interval's length and the bin is part of the join key: a
    left row looks into its own bin and the one before, so a hot key is spread over its bins
    and only rows of neighbouring bins meet. The left side, which is doubled, should be the
    smaller one. Column names of the two sides must differ.
    """
    micros = within_seconds * 1_000_000
    lbin = F.floor(F.unix_micros(left_time) / micros)
    lhs = left.withColumn("_lbin", F.explode(F.array(lbin - 1, lbin)))
    rhs = right.withColumn("_rbin", F.floor(F.unix_micros(right_time) / micros))
    cond = F.col("_lbin") == F.col("_rbin")
    for a, b in on.items():
        cond = cond & (F.col(a) == F.col(b))
    span = F.expr(f"INTERVAL {within_seconds} SECONDS")
    cond = cond & F.col(right_time).between(F.col(left_time) - span, F.col(left_time))
    return lhs.join(rhs, cond).drop("_lbin", "_rbin")


def window_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two windowed results, row by row of the same window."""
    return left.join(right, ["stt", "edt", "cur_date"])


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Full outer join on ids; descriptive columns come from whichever side has them."""
    rhs = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in [*keys, *names]],
        *[c for c in right.columns if c not in keys and c not in names],
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    joined = left.join(rhs, cond, "full_outer")
    for k in [*keys, *names]:
        joined = joined.withColumn(k, F.coalesce(k, f"_r_{k}"))
    return joined.drop(*[f"_r_{k}" for k in [*keys, *names]])
