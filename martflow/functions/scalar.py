"""Small column helpers shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column) -> Column:
    """An amount; one that does not fit stops the job rather than become NULL."""
    return col.cast("decimal(16,2)")


def total(col: Column) -> Column:
    """A sum of amounts."""
    return col.cast("decimal(38,2)")


def not_blank(col: Column) -> Column:
    return F.coalesce(F.trim(col) != "", F.lit(False))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """Quotient as DOUBLE; NULL when the divisor is zero or absent."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def two_places(col: Column) -> Column:
    """Two decimal places, half-even on the exact binary value of a double.

    Rounding functions go by the shortest decimal text instead, which shows 75.165 as a tie
    although the double lies beside it. The fraction is taken in units of 2^-56.
    """
    whole = F.floor(col)
    units = F.floor((col - whole) * 2.0**56).cast("bigint") * 100
    cents, rest = F.shiftright(units, 56), units.bitwiseAND(2**56 - 1)
    half = 2**55
    up = (rest > half) | ((rest == half) & (cents % 2 == 1))
    return (whole * 100 + cents + up.cast("int")).cast("double") / 100


def percent(col: Column) -> Column:
    return two_places(col * 100)


def safe_average(total: Column, count: Column, unit: int = 1) -> Column:
    """Average in a unit, to two places; 0.0 when there is nothing to divide by."""
    return F.when(count == 0, F.lit(0.0)).otherwise(two_places(ratio(total, count) / unit))


def text_map(**cols: Column) -> Column:
    """MAP<STRING,STRING> from named columns."""
    pairs: list[Column] = []
    for name, col in cols.items():
        pairs += [F.lit(name), col.cast("string")]
    return F.create_map(*pairs)


def merge(*maps: Column) -> Column:
    """Union of text maps; a later map wins over an earlier one, absent maps are empty.

    Needs `spark.sql.mapKeyDedupPolicy` = LAST_WIN, see `session`.
    """
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(*[F.coalesce(m, empty) for m in maps])


def kept_keys(listed: Column) -> Column:
    """The keys of a comma list, and `op_type`."""
    return F.concat(F.split(listed, ","), F.array(F.lit("op_type")))


def keep_keys(data: Column, kept: Column) -> Column:
    """Entries of a map whose key is among the kept ones."""
    return F.map_filter(data, lambda k, _: F.array_contains(kept, k))


def plain_op(op: Column) -> Column:
    return F.replace(op, F.lit("bootstrap-"), F.lit(""))
