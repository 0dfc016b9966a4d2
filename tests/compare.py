"""Runs the registered queries against their SQL and reports the differences."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

DATA = os.environ.get("TESTDATA", "/root/testdata")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when the two results agree, else what differs."""
    return differences(entry.queries()[name](spark, sf_dir), con, name)


def differences(df, con, name: str) -> str | None:
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if mine != theirs:
        return f"{mine.total()} / {theirs.total()} rows; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"
    return None if mine.total() else "no rows"


if __name__ == "__main__":
    import time

    from martflow.session import build

    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"{DATA}/{sys.argv[1]}"
    con = database(sf)
    for name in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        try:
            found = compare(spark, con, name, sf)
        except Exception as error:  # report and go on
            found = f"ERROR {str(error)[:500]}"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
