from collections import Counter

import duckdb
import pytest


@pytest.fixture(scope="session")
def rows_of(small):
    """Rows of one of the small tables, as tuples."""

    def read(table: str, *columns: str) -> list[tuple]:
        return duckdb.connect().execute(f"SELECT {', '.join(columns)} FROM '{small}/{table}.parquet'").fetchall()

    return read


@pytest.fixture(scope="session")
def same():
    """Asserts that a DataFrame's named columns hold these rows, in any order."""

    def check(df, columns: list[str], want: list[tuple]) -> None:
        got = Counter(tuple(r) for r in df.select(*columns).collect())
        assert got == Counter(map(tuple, want))

    return check
