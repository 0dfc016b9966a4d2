"""Quality rules with a verdict on hosts: how much a failed rule counts depends on where a document is from.

1. Every document is measured (words, symbols, repeated lines and word sequences) and held against rules:
   hard ones, which reject it, and soft ones, which may be a false alarm.
2. Failures are summed by host. A host's rate is shrunk towards the mean of all hosts by a beta prior
   fitted to the hosts' rates (method of moments), so that a host of few documents is judged by its
   documents only as far as they go.
3. A host whose shrunk rate lies more than `AWAY` of the prior's standard deviations above its mean is `watched`,
   others are `trusted`. The verdicts are joined back: a document of a trusted host may fail one soft rule, one of
   a watched host none. A host's verdict takes this tolerance away and no more: a document that fails no rule stays.

Hosts are summed before the shuffle. The host table is written to the shared folder, so Spark knows its
size and broadcasts it only below its threshold; else it splits hot hosts of the join at run time.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.llm.common import _BLANK, find_words, mix, row_slices, stored, string_bytes, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: The prior's standard deviations above its mean from which a host is watched.
AWAY = 1.0
#: Least and greatest number of documents that the prior counts as.
STRENGTH = (1.0, 1000.0)
_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, how many of its bytes have the flag."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _measure_slice(column: pa.Array) -> list[np.ndarray]:
    raw, at = string_bytes(column)
    starts, _, row = find_words(raw, at)
    n, rows = len(starts), len(column)
    n_words = np.bincount(row, minlength=rows)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    head = (raw & 0xC0) != 0x80  # not a continuation byte: one for each code point
    # Three-word windows of one document, by a 64-bit hash of the words and the row.
    windows = np.flatnonzero(row[2:] == row[:-2]) if n > 2 else np.zeros(0, np.int64)
    keys = mix(window_hashes(word_hashes(raw, starts, 0), 3, 0)[windows] + mix(row[windows].astype(np.uint64)))
    _, own, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = windows[counts[own] > 1]
    cover = np.zeros(n + 3, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = np.bincount(row[np.cumsum(cover[:n]) > 0], minlength=rows)
    lines = [[line for line in (t or "").split("\n") if line.strip("\t\n\x0b\x0c\r ")] for t in column.to_pylist()]
    n_lines = np.array([len(x) for x in lines], np.int64)
    distinct = np.array([len(set(x)) for x in lines], np.int64)
    return [n_words, _sums(head & ~_BLANK[raw], at), _sums(symbol[raw], at), n_lines - distinct, repeated, n_lines]


def _measure_rows(texts: pa.Array) -> pa.Array:
    parts = [_measure_slice(part) for part in row_slices(texts)]
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[]] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], MEASURES)


def measure(text: Column) -> Column:
    """A struct of the measures of a text; null counts as empty. Evaluated once for each row."""

    def run(texts: pa.Array) -> pa.Array:
        return _measure_rows(texts)

    return F.arrow_udf(run, _TYPE).asNondeterministic()(text)


def hard_failure(m: str) -> Column:
    return F.expr(f"{m}.n_words < 50 OR 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def soft_failures(m: str) -> Column:
    """Soft rules failed: symbols, repeated lines, repeated word sequences, word length."""
    rules = [
        f"10 * {m}.n_symbols > {m}.n_words", f"2 * {m}.n_dup_lines > {m}.n_lines",
        f"100 * {m}.n_repeat_words > 30 * {m}.n_words",
        f"{m}.word_chars < 2 * {m}.n_words OR {m}.word_chars > 12 * {m}.n_words",
    ]
    return sum((F.expr(f"CAST({rule} AS INT)") for rule in rules[1:]), F.expr(f"CAST({rules[0]} AS INT)"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """`host`, `n`, `failed`, `rate` (shrunk) and `verdict`, of rows with `host`, `hard` and `soft`."""
    failed = (F.col("hard") | (F.col("soft") > 0)).cast("long")
    hosts = stored(measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("failed")), "hosts")
    own = F.col("failed") / F.col("n")
    mean, spread = hosts.agg(F.sum("failed") / F.sum("n"), F.var_pop(own)).first()
    mean, spread = mean or 0.0, spread or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else STRENGTH[1]
    strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
    rate = (F.col("failed") + strength * mean) / (F.col("n") + strength)
    limit = mean + AWAY * sqrt(mean * (1 - mean) / (strength + 1))
    verdict = F.when(F.col("rate") > limit, "watched").otherwise("trusted")
    return hosts.withColumn("rate", rate).withColumn("verdict", verdict)


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """A row per input row: `doc` (the whole input row), `m` (measures), `hard`, `soft`, `verdict`, `kept`.

    A null or empty text has no words and fails. Rows of a null host count as one host of their own. Input
    columns may have any names, as they are inside `doc`. No rows give no rows.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(host).alias("host"), measure(F.col(text)).alias("m"))
    rows = rows.select("*", hard_failure("m").alias("hard"), soft_failures("m").alias("soft"))
    hosts = host_verdicts(rows.select("host", "hard", "soft")).select(F.col("host").alias("own"), "verdict")
    allowed = F.when(F.col("verdict") == "trusted", 1).otherwise(0)
    kept = ~F.col("hard") & (F.col("soft") <= allowed)
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("own")))
    return joined.select("doc", "m", "hard", "soft", "verdict", kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with the columns they have."""
    return judge(docs, text, host).filter("kept").select("doc.*")
