"""Secrets in texts: patterns, and strings of high entropy. Built-in expressions only.

A candidate is a run of 20 or more signs of the base-64 and URL alphabets that holds a letter and a digit.
A window of `WINDOW` signs slides over it; the counts of signs, and the sum of c log c from which the
entropy follows, are changed by the sign that enters and the sign that leaves. The highest entropy is held
against the threshold of the candidate's character class. Candidates that an allow-list pattern matches,
and those inside a span that a pattern found, are left out. Work follows a text's length, however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group that must have so many signs, and how many; in the order that ties follow. Fixed values.
KINDS = [
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Character class, pattern of the whole candidate, and the entropy in bits from which it counts; the first that fits.
CLASSES = [("hex", r"^[0-9a-fA-F-]+$", 3.0), ("base64", r"^.*$", 3.7)]
#: Strings that look random and are no secrets: UUIDs, documentation keys, runs of the alphabet, digests named as such.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example", r"(?i)abcdefgh|01234567",
    r"(?i)^(sha(1|224|256|384|512)|md5)[-_=]",
]

#: Numbers that are summed in one go.
RUN = 256


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The sums (or what `join` makes, starting from 0) of an array of numbers up to each of them.

    An array grows by copying, so runs of `RUN` numbers are summed apart, then the runs: work follows the length.
    """
    empty, last = F.array().cast("array<int>"), lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0))
    grow = lambda sums, x: F.concat(sums, F.array(join(last(sums), x)))
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, RUN))
    within = F.transform(runs, lambda run: F.aggregate(run, empty, grow))
    before = F.aggregate(F.transform(within, last), F.array(F.lit(0)), grow)
    return F.flatten(F.zip_with(within, F.slice(before, 1, F.size(within)), lambda run, sum: F.transform(run, lambda x: join(sum, x))))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern: code points between the last one and it (`gap`), its own, and the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(found, words, lambda m, w: F.struct(F.char_length(m).alias("long"), w.alias("word")))
    parts = F.zip_with(pairs, F.split(text, pattern, -1), lambda p, g: F.struct(F.char_length(g).alias("gap"), p["long"].alias("long"), p["word"].alias("word")))
    return F.when(F.size(found) > 0, F.filter(parts, lambda x: x["long"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,long:int,word:string>>"))


def _located(rows: DataFrame, text: str, kinds: Sequence[tuple]) -> DataFrame:
    """The rows with a column for each kind instead of the text: arrays of struct(start, end, word), in code points."""
    others, names = [c for c in rows.columns if c != text], [kind for kind, *_ in kinds]
    rows = rows.select(*others, *[_matches(F.col(text), pattern, group).alias(kind) for kind, pattern, group, _ in kinds])
    lengths = {kind: F.transform(kind, lambda x: x["gap"] + x["long"]) for kind in names}
    rows = rows.select(*others, *names, *[lengths[kind].alias(f"{kind} long") for kind in names])
    rows = rows.select(*others, *names, *[_running(F.col(f"{kind} long"), lambda a, b: a + b).alias(f"{kind} end") for kind in names])

    def spans(kind: str, least: int) -> Column:
        span = lambda x, end: F.struct((end - x["long"]).alias("start"), end.alias("end"), x["word"].alias("word"))
        return F.filter(F.zip_with(kind, f"{kind} end", span), _at_least(least))

    return rows.select(*others, *[spans(kind, least).alias(kind) for kind, _, _, least in kinds])


def peak_entropy(word: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of `window` consecutive signs of a string of ALPHABET.

    Counts are signs of one string, a place for each of ALPHABET, of which the entering and the leaving are replaced.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1)
    leaving = F.concat(F.array_repeat(F.lit(0), window), codes)
    moves = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    moves = F.filter(moves, lambda x: x["a"].isNotNull())
    zero = 48
    empty = F.struct(F.lit(chr(zero) * (len(ALPHABET) + 1)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    count = lambda counts, k: F.ascii(F.substring(counts, k, F.lit(1))) - zero
    put = lambda counts, k, n: F.overlay(counts, F.char((n + zero).cast("long")), k, F.lit(1))

    def step(state: Column, move: Column) -> Column:
        a, b, counts = move["a"], move["b"], state["counts"]
        old, gone = count(counts, a), count(counts, b) + F.when(a == b, 1).otherwise(0)
        total = state["sum"] + F.get(table, old + 1) - F.get(table, old)
        total = total + F.when(b > 0, F.get(table, gone - 1) - F.get(table, gone)).otherwise(0.0)
        entered = put(counts, a, old + 1)
        moved = F.when(b > 0, put(entered, b, gone - 1)).otherwise(entered)
        n = state["n"] + 1
        bits = F.when(n >= window, F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct(moved.alias("counts"), total.alias("sum"), n.alias("n"), F.greatest(state["best"], bits).alias("best"))

    return F.aggregate(moves, empty, step)["best"]


def _random(word: Column) -> Column:
    least = F.coalesce(*[F.when(word.rlike(pattern), F.lit(bits)) for _, pattern, bits in CLASSES])
    return F.when(word.rlike("[0-9]") & word.rlike("[A-Za-z]"), peak_entropy(word) >= least).otherwise(False)


def _at_least(n: int):
    return lambda x: F.char_length(x["word"]) >= n


def _ranked(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", allowed: Sequence[str] = tuple(ALLOWED)) -> DataFrame:
    """`id`, and arrays of struct(start, end, word) of each kind and of `entropy`, a row per input row.

    Places are code points, ends exclusive. A null or empty text has no spans. Only the two named columns
    are looked at. No rows give no rows.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, base = _located(rows, "text", [*KINDS, ("candidates", CANDIDATE, 0, 0)]), [kind for kind, *_ in KINDS]
    # By start, spans of patterns first: a candidate is inside one if the greatest end so far reaches its own.
    found = lambda kind, first, word: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(first).alias("first"), x["end"].alias("end"), word(x).alias("word")))
    events = [found(kind, 0, lambda x: F.lit("")) for kind in base] + [found("candidates", 1, lambda x: x["word"])]
    rows = rows.select("id", *base, F.array_sort(F.concat(*events)).alias("events"))
    rows = rows.select("id", *base, "events", F.transform("events", lambda x: F.when(x["first"] == 0, x["end"]).otherwise(0)).alias("ends"))
    rows = rows.select("id", *base, "events", _running(F.col("ends"), lambda a, b: F.greatest(a, b)).alias("reach"))

    def wanted(x: Column) -> Column:
        listed = F.lit(False)
        for pattern in allowed:
            listed |= x["word"].rlike(pattern)
        return F.when((x["first"] == 0) | (x["reach"] >= x["end"]) | listed, False).otherwise(_random(x["word"]))

    reached = F.zip_with("events", "reach", lambda x, r: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"), x["first"].alias("first"), r.alias("reach")))
    entropy = F.transform(F.filter(reached, wanted), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word")))
    return rows.select(F.col("id").alias(id), *base, entropy.alias("entropy"))


def span_list(kinds: Sequence[str]) -> Column:
    """`kind:start:end` of all spans of some columns, by start, then kind as listed, joined by commas."""
    placed = [F.transform(kind, _ranked(k)) for k, kind in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    line = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*placed)), line))
