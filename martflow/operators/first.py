"""First/latest versions, "first time" flags and return detection.

One key may hold a large part of all rows, so nothing here sorts a whole key in one task:

* keeping one row per key is `row_number() = 1`, which Spark prunes to one row per key in
  every map task before the shuffle;
* flags on all rows are joined back on key and arrival number, which spreads evenly;
* running values are taken within one second of a key, over a day's seconds (86 400 rows at
  most) and over days, and joined; no window holds all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martflow import codes


def _one_per_key(df: DataFrame, keys: Sequence, order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_version(df: DataFrame, keys: Sequence, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Earliest row of each key."""
    return _one_per_key(df, keys, [F.col(c).asc() for c in order])


def latest_version(df: DataFrame, keys: Sequence, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Latest row of each key."""
    return _one_per_key(df, keys, [F.col(c).desc() for c in order])


def latest_values(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the latest row of each key, as an aggregate.

    Spark knows the result to be unique per key, so a left join with it is dropped from
    plans that use none of its columns.
    """
    latest = F.max_by(F.struct(*columns), order).alias("_latest")
    return df.groupBy(*keys).agg(latest).select(*keys, "_latest.*")


def day_of(ts: str = "ts") -> Column:
    """Calendar day of an epoch-millisecond column."""
    return F.to_date(F.timestamp_millis(ts))


def flag_first(
    df: DataFrame, keys: Sequence, flag: str, order: Sequence[str] = ("ts", "seq"), row: str = "seq"
) -> DataFrame:
    """Every row with `flag` = 1 on the first row of its key and 0 elsewhere."""
    return flagged(df, first_version(df, keys, order), [*keys, row], flag)


def flagged(df: DataFrame, firsts: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Every row with `flag` = 1 where `firsts` holds it, and 0 elsewhere."""
    first = firsts.select(*[F.col(c).alias(f"_{c}_") for c in by], F.lit(1).alias(flag))
    mine = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by])
    found = df.join(first, mine, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))
    return found.select(*df.columns, flag)


def daily_unique(df: DataFrame, key: str = "mid", flag: str = "uv_ct") -> DataFrame:
    return flag_first(df.withColumn("_day", day_of()), [key, "_day"], flag).drop("_day")


def session_first(df: DataFrame, key: str = "sid", flag: str = "sv_ct") -> DataFrame:
    return flag_first(df, [key], flag)


def first_days(df: DataFrame, key: str = "mid", flag: str = "is_new") -> DataFrame:
    """First day of each device, one row per device: (_key, _first).

    The first record of a device sets it; an "old" first record means the day before.
    """
    return first_day_of(first_version(df.select(key, flag, "ts", "seq"), [key], ["ts", "seq"]), key, flag)


def first_day_of(firsts: DataFrame, key: str = "mid", flag: str = "is_new") -> DataFrame:
    """The same from the first record of each device."""
    day = day_of()
    return firsts.select(
        F.col(key).alias("_key"),
        F.when(F.col(flag) == "0", F.date_sub(day, 1)).otherwise(day).alias("_first"),
    )


def correct_new(df: DataFrame, days: DataFrame, key: str = "mid", flag: str = "is_new") -> DataFrame:
    """Reset a "new visitor" mark on records after the device's first day.

    A device with very many records is split by the adaptive skew join.
    """
    late = (F.col(flag) == "1") & (F.col("_first") < day_of())
    return (
        df.join(days, F.col(key) == F.col("_key"), "left")
        .withColumn(flag, F.when(late, "0").otherwise(F.col(flag)))
        .drop("_key", "_first")
    )


def fix_first_visit(df: DataFrame, key: str = "mid", flag: str = "is_new") -> DataFrame:
    return correct_new(df, first_days(df, key, flag), key, flag)


def page_unique(df: DataFrame, key: str = "mid", page: str = "page_id") -> DataFrame:
    """First record of each device and page on each day."""
    return first_version(df, [key, page, day_of()], ["ts", "seq"])


def back_flow(df: DataFrame, key: str = "uid") -> DataFrame:
    """First record of each user and day; back_ct = 1 after more than seven days away."""
    return returns_of(first_version(df.withColumn("_day", day_of()), [key, "_day"], ["ts", "seq"]), key)


def returns_of(days: DataFrame, key: str = "uid") -> DataFrame:
    """The same from the first record of each user and day, which has its `_day`."""
    previous = F.lag("_day").over(Window.partitionBy(key).orderBy("_day"))
    away = F.datediff("_day", previous) > codes.BACK_AFTER_DAYS
    return (
        days.withColumn("back_ct", F.when(away, 1).otherwise(0))
        .withColumn("uu_ct", F.lit(1))
        .drop("_day")
    )


def first_payment(df: DataFrame, key: str = "user_id") -> DataFrame:
    """First payment of each user and day; new_ct = 1 on the user's first day."""
    return new_payers_of(first_version(df.withColumn("_day", day_of()), [key, "_day"], ["ts", "seq"]), key)


def new_payers_of(days: DataFrame, key: str = "user_id") -> DataFrame:
    """The same from the first payment of each user and day, which has its `_day`."""
    earliest = F.min("_day").over(Window.partitionBy(key))
    return (
        days.withColumn("new_ct", F.when(F.col("_day") == earliest, 1).otherwise(0))
        .withColumn("unique_ct", F.lit(1))
        .drop("_day")
    )


def running_min(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """Running minimum of `value` per key, for keys of few rows: one per second of a day at most."""
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(time)))


def _carried(df: DataFrame, keys: Sequence[str], part: Column, value: str) -> DataFrame:
    """Of each key and part of time, the minimum of the parts before it, as `_earlier`; keys are null-safe."""
    parts = df.groupBy(*keys, part.alias("_part")).agg(F.min(value).alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_earlier", F.min("_least").over(before))
    return parts.select(*[F.col(k).alias(f"_{k}_") for k in keys], "_part", "_earlier")


def _with_earlier(df: DataFrame, keys: Sequence[str], part: Column, value: str, out: str, within: str) -> DataFrame:
    """`out`: the least of `within` and of what earlier parts of time hold."""
    carried = _carried(df, keys, part, value)
    mine = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys] + [part == F.col("_part")])
    found = df.join(carried, mine).withColumn(out, F.least(within, "_earlier"))
    return found.drop(*[f"_{k}_" for k in keys], "_part", "_earlier", within)


def first_of_day(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """Every row with the running minimum of `value` per key in order of `time`; keys hold a day.

    The minimum is taken within the row's second, and joined with that of the day's earlier
    seconds, of which there is one row each.
    """
    second = F.date_trunc("second", time)
    within = df.withColumn("_within", F.min(value).over(Window.partitionBy(*keys, second).orderBy(time)))
    return _with_earlier(within, keys, second, value, out, "_within")


def first_ever(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """The same for keys without a day: running within days, then over earlier days."""
    dated = df.withColumn("_day", F.to_date(time))
    today = first_of_day(dated, [*keys, "_day"], time, value, "_today")
    return _with_earlier(today, keys, F.col("_day"), value, out, "_today").drop("_day")


def least_ever(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """`first_ever` for rows already reduced to one per key and second: no join within the day."""
    dated = df.withColumn("_day", F.to_date(time))
    today = running_min(dated, [*keys, "_day"], time, value, "_within")
    return _with_earlier(today, keys, F.col("_day"), value, out, "_within").drop("_day")
