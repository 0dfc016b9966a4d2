"""The running minimum of each user as a stream: state that Spark keeps by user, and groupings after it.

Whether an order time is the earliest of its day, or the earliest ever, as of its moment depends on all moments of
the user before it. No aggregation gives that for every row, so a stateful operator holds the two minima
and passes every moment on with its flags, and with its event time, on which the windows behind it close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from martflow import codes
from martflow.operators.windows import stamped, tumble

#: State of this kind needs a store that holds several values by key; a batch writes what it changed, not all that the store holds.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: The same store for other operators: state on disk, with a bound to the memory that all its parts share, and no count of its rows.
ON_DISK = {
    **STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
MOMENTS = "user_id STRING, et TIMESTAMP, today BIGINT, ever BIGINT"
#: A day in milliseconds.
_DAY = 86_400_000
#: Staged bytes for a group of users, about.
GROUP_BYTES = 1 << 20
#: Before any moment.
_BEFORE = np.iinfo(np.int64).min


def running_min(group: np.ndarray, moment: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each row the least value of its group up to its moment; rows of one moment see each other."""
    levels, code = np.unique(value, return_inverse=True)
    order = np.lexsort((code, moment, group))
    # Each group's codes lie below those of the groups before, so the minimum starts anew with it.
    shift = group[order].astype(np.int64) * len(levels)
    found = np.empty(len(value), np.int64)
    found[order] = np.minimum.accumulate(code[order] - shift) + shift
    return levels[found]


def least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each group 0, 1, …"""
    found = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(found, group, value)
    return found


class Earliest(StatefulProcessor):
    """Of each user the earliest order time of every day still open, and of all days; all users of a group are one value: a read and a write a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState(
            "kept", "users ARRAY<STRING>, ever ARRAY<BIGINT>, owners ARRAY<STRING>, days ARRAY<INT>, least ARRAY<BIGINT>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        rows = pd.concat(list(rows), ignore_index=True)
        held = self.kept.get() or ([], [], [], [], [])
        known = rows["created"].notna().to_numpy()
        came = rows[known]
        moment, created, day = (came[c].to_numpy(np.int64) for c in ("moment", "created", "day"))
        kept_days, kept_least = np.array(held[3], np.int64), np.array(held[4], np.int64)
        # What is held stands before all that came.
        codes_of, users = pd.factorize(pd.Series([*held[0], *held[2], *came["user_id"]], dtype=object))
        n, m = len(held[0]), len(held[2])
        of_users, of_days, of_rows = codes_of[:n], codes_of[n:n + m], codes_of[n + m:]
        ever_group, ever_value = np.concatenate([of_users, of_rows]), np.concatenate([np.array(held[1], np.int64), created])
        ever = running_min(ever_group, np.concatenate([np.full(n, _BEFORE), moment]), ever_value)[n:]
        # Users and days as one number each: days are numbered anew.
        days, day_code = np.unique(np.concatenate([kept_days, day]), return_inverse=True)
        pairs, day_group = np.unique(np.concatenate([of_days, of_rows]) * max(1, len(days)) + day_code, return_inverse=True)
        day_value = np.concatenate([kept_least, created])
        today = running_min(day_group, np.concatenate([np.full(m, _BEFORE), moment]), day_value)[m:]
        self._keep(timers, users, least(ever_group, ever_value), pairs, days, least(day_group, day_value), day_group[:m], kept_days)
        rows["today"] = pd.Series(np.where(created == today, 1.0, 0.0), came.index)
        rows["ever"] = pd.Series(np.where(created == ever, 1.0, 0.0), came.index)
        found = rows.groupby(["user_id", "slot"], as_index=False, sort=False).agg({"et": "max", "today": "max", "ever": "max"})
        yield found.astype({"today": "Int64", "ever": "Int64"})[["user_id", "et", "today", "ever"]]

    def _keep(self, timers, users, ever, pairs, days, mins, held, held_days) -> None:
        """Write the minima back, without the days held before that are over."""
        limit = timers.getCurrentWatermarkInMs()
        open_days = np.ones(len(pairs), bool)
        if limit > 0:
            # Lines come within a day of their order, so a day is over two days behind the watermark.
            open_days[held[(held_days + 3) * _DAY < limit]] = False
        owners, day = np.divmod(pairs[open_days], max(1, len(days)))
        users = np.asarray(users, dtype=object)
        self.kept.update((users.tolist(), ever.tolist(), users[owners].tolist(), days[day].tolist(), mins[open_days].tolist()))

    def close(self) -> None:
        pass


def order_windows(lines: DataFrame, groups: int = 64) -> DataFrame:
    """Users whose line is their first of the day, and their first ever, per window; `lines` has a watermark on `et`.

    `groups` is the number of groups of users; a checkpoint keeps it for ever.
    """
    rows = lines.where("user_id IS NOT NULL").select(
        F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("part"), "user_id", "et", F.unix_micros("et").alias("moment"),
        F.unix_micros(F.window("et", codes.WINDOW)["start"]).alias("slot"),
        F.unix_date(F.to_date("create_time")).alias("day"), F.unix_micros("create_time").alias("created"))
    # Of a window, the earliest order time is a running minimum at its moment or none is: one row stands for all of a batch.
    moments = rows.groupBy("part").transformWithStateInPandas(
        statefulProcessor=Earliest(), outputStructType=MOMENTS, outputMode="Append", timeMode="EventTime", eventTimeColumnName="et")
    users = tumble(moments, "et", "user_id").agg(F.max("today").alias("today"), F.max("ever").alias("ever"))
    return stamped(users.groupBy("window").agg(
        F.sum("today").alias("order_unique_user_count"), F.sum("ever").alias("order_new_user_count")))
