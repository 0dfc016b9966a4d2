"""Personal data: labelling functions vote, EM weighs them, a trained classifier decides on further spans.

1. Patterns propose candidates; four of them (email, ip, card, phone) are the base, whose matches always
   stand. The others are looser: numbers without a plus sign, cards within longer rows of digits, social
   security and bank account numbers, spelt-out addresses, titles with names, and base matches that fail
   their check.
2. Five labelling functions vote on each candidate (for, against, or abstaining): the strict form, the
   checksum or range, a gazetteer (top-level domains, calling codes, countries, first letters), trigger words
   before it, and its borders.
3. Votes are summed by kind and pattern of votes, at most KINDS x 3^5 rows, whatever the corpus. EM on that
   table estimates each labeller's reliability and the probability of each pattern.
4. A logistic model over votes and shape is fitted to those probabilities on at most `TRAIN_ROWS`
   candidates, the lowest by a hash. It decides on the candidates that are not base.

The statistics cover all candidates; only the classifier's training rows are bounded. Texts are read twice
and never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.llm.common import row_slices, stored

#: In the order of span lists; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "person"]
EMAIL, IP, CARD, PHONE, SSN, IBAN, PERSON = range(7)
LABELLERS = ["form", "check", "gazetteer", "context", "border"]
TRAIN_ROWS = 20_000
THRESHOLD = 0.5

# Gazetteers and trigger words. Fixed values.
DOMAINS = set("com org net edu gov mil int info biz io co de fr es it uk us nl ch at be eu ca au jp cn in br mx ru pl se no fi dk".split())
CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
BANKS = set("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
TRIGGERS = {
    EMAIL: "mail contact write reach", IP: "ip host server address connect", CARD: "card visa mastercard amex credit payment",
    PHONE: "phone call tel mobile fax dial contact", SSN: "ssn social security", IBAN: "iban bank account transfer", PERSON: "dear name from by patient",
}
AGAINST = re.compile(r"(?i)\b(?:version|release|section|isbn|issn|page|figure|table|build)\W*$")
_CONTEXT = {kind: re.compile(r"(?i)\b(?:" + "|".join(words.split()) + r")") for kind, words in TRIGGERS.items()}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, as the one before it takes the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOOSE = [
    (SSN, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (IBAN, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (CARD, re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{16,19}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
]
_SPELT = re.compile(r"[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}\b")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?\b")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def _emails(text: str):
    """Every address, in time linear in the text: the local part ends at the @, so it is looked for backwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = at - (len(head) - len(head.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _proposals(text: str):
    """(kind, start, end, fits): base patterns, and whether the match passes its check."""
    for start, end in _emails(text):
        yield EMAIL, start, end, True
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            yield IP, m.start(), m.end(), _octets(m[0])
        for m in _CARD.finditer(text):
            if len(m[0]) >= 13:
                digits = _digits(m[0])
                if len(digits) >= 13:
                    yield CARD, m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
        for m in _PHONE.finditer(text):
            yield PHONE, m.start(), m.end(), 8 <= len(_digits(m[0])) <= 15


def _loose(text: str):
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE:
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()
    if "dot" in text:
        for m in _SPELT.finditer(text):
            yield EMAIL, m.start(), m.end()
    if any(title in text for title in ("Mr", "Ms", "Dr", "Prof")):
        for m in _TITLE.finditer(text):
            yield PERSON, m.start(), m.end()


def _votes(text: str, kind: int, start: int, end: int, fits: bool | None) -> list[int]:
    """One vote of each labeller: 1, 0 (abstains) or -1."""
    word, digits = text[start:end], _digits(text[start:end])
    form = 1 if fits else -1 if fits is False else 0
    check = 0
    if kind == CARD:
        check = 1 if luhn(digits) and len(set(digits)) > 1 else -1
    elif kind == IP:
        check = 1 if _octets(word) and not word.startswith("0") else -1
    elif kind == PHONE:
        check = 1 if 8 <= len(digits) <= 15 else -1
    elif kind == SSN:
        check = -1 if word[:3] in ("000", "666") or word[0] == "9" or word[4:6] == "00" or word[7:] == "0000" else 1
    elif kind == IBAN:
        plain = word.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    gazetteer = 0
    if kind == EMAIL:
        gazetteer = 1 if re.split(r"[.\s\])]+", word)[-1].lower() in DOMAINS else -1
    elif kind == PHONE and word[0] == "+":
        gazetteer = 1 if any(digits[:k] in CALLING for k in (1, 2)) else -1
    elif kind == IBAN:
        gazetteer = 1 if word[:2] in BANKS else -1
    elif kind == PERSON:
        gazetteer = 1
    before = text[max(0, start - 40) : start]
    context = -1 if AGAINST.search(before) else 1 if _CONTEXT[kind].search(before) else 0
    border = -1 if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else 1
    return [form, check, gazetteer, context, border]


def _features(word: str, kind: int, votes: list[int]) -> list[float]:
    n = len(word)
    shape = [min(n, 40) / 40, sum(c.isdigit() for c in word) / n, sum(not c.isalnum() for c in word) / n]
    return [1.0, *[float(k == kind) for k in range(len(KINDS))], *map(float, votes), *shape]


N_FEATURES = 1 + len(KINDS) + len(LABELLERS) + 3


def find_candidates(text: str) -> list[tuple[int, int, int, bool, int, list[float]]]:
    """(kind, start, end, base, pattern of votes, features), by kind and start."""
    found = list(_proposals(text))
    taken = _Taken([(start, end) for _, start, end, fits in found if fits])
    for kind, start, end in _loose(text):
        if not taken.overlaps(start, end):
            found.append((kind, start, end, None))
    out = []
    for kind, start, end, fits in found:
        votes = _votes(text, kind, start, end, fits)
        code = sum((v + 1) * 3**k for k, v in enumerate(votes))
        out.append((kind, start, end, bool(fits), code, _features(text[start:end], kind, votes)))
    return sorted(out, key=lambda x: x[:3])


class _Taken:
    """Base spans, which may be long and overlap each other: asked by the greatest end so far."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)  # spans that begin before the end
        return before > 0 and self.ends[before - 1] > start


@dataclass(frozen=True)
class Model:
    """Reliability of the labellers, probability of each vote pattern, and weights of the span classifier."""

    weights: tuple[float, ...] = (0.0,) * N_FEATURES
    #: By labeller: probability of a vote against, none, for, given no personal data and personal data.
    reliability: dict[str, list[list[float]]] = field(default_factory=dict)
    trained: bool = False

    def accepts(self, features: list[float]) -> bool:
        return self.trained and sum(w * x for w, x in zip(self.weights, features)) >= np.log(THRESHOLD / (1 - THRESHOLD))


def _patterns() -> np.ndarray:
    codes = np.arange(3 ** len(LABELLERS))
    return np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))], 1)


def estimate(counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for labellers that err independently: counts by kind and pattern give P(data | kind, pattern) and P(vote | truth)."""
    votes, labellers = _patterns(), np.arange(len(LABELLERS))
    emit = np.empty((2, len(LABELLERS), 3))
    emit[0], emit[1] = (0.45, 0.4, 0.15), (0.1, 0.4, 0.5)
    prior = np.full(len(counts), 0.5)
    for _ in range(rounds):
        logs = np.log(emit[:, labellers, votes]).sum(2)
        odds = logs[1] - logs[0] + np.log(prior / (1 - prior))[:, None]
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = ((counts * truth).sum(1) + 1) / (counts.sum(1) + 2)
        for y, share in enumerate((1 - truth, truth)):
            mass = (counts * share).sum(0)
            for j in labellers:
                own = np.bincount(votes[:, j], mass, 3) + 10 * np.array([(0.45, 0.4, 0.15), (0.1, 0.4, 0.5)][y])
                emit[y, j] = own / own.sum()
    return truth, emit


def train(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on probabilities, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_CANDIDATE = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("features", T.ArrayType(T.FloatType()))]))


def _propose(texts: pa.Array) -> pa.Array:
    rows = [
        [{"kind": k, "code": c, "features": f} for k, _, _, _, c, f in find_candidates(t or "")]
        for part in row_slices(texts) for t in part.to_pylist()
    ]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("code", pa.int32()), ("features", pa.list_(pa.float32()))]))
    return pa.array(rows, kind)


def fit(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """The model of a corpus. Without candidates nothing but base spans is ever accepted."""

    def run(texts: pa.Array) -> pa.Array:
        return _propose(texts)

    found = docs.select(F.arrow_udf(run, _CANDIDATE).asNondeterministic()(F.col(text)).alias("c")).select(F.inline("c"))
    counts = np.zeros((len(KINDS), 3 ** len(LABELLERS)))
    summed = found.groupBy("kind", "code", "features").agg(F.count("*").alias("n"))
    summed = stored(summed, "pii-votes")  # shapes of candidates with their numbers: small, read twice
    for kind, code, n in summed.groupBy("kind", "code").agg(F.sum("n")).collect():
        counts[kind, code] = n
    if not counts.sum():
        return Model()
    truth, emit = estimate(counts)
    rows = summed.orderBy(F.xxhash64("kind", "code", "features"), "kind", "code", "features").limit(train_rows).collect()
    x = np.array([r["features"] for r in rows], float)
    target = np.array([truth[r["kind"], r["code"]] for r in rows])
    weights = train(x, target)
    reliability = {name: [emit[0, j].tolist(), emit[1, j].tolist()] for j, name in enumerate(LABELLERS)}
    return Model(tuple(weights.tolist()), reliability, True)


def find_spans(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start; added spans overlap neither base spans nor each other."""
    found = find_candidates(text)
    out = [(k, a, b, True) for k, a, b, base, _, _ in found if base]
    taken = _Taken([(a, b) for _, a, b, _ in out])
    end = 0
    for a, b, k, f in sorted((a, b, k, f) for k, a, b, base, _, f in found if not base):
        if a >= end and not taken.overlaps(a, b) and model.accepts(f):
            out.append((k, a, b, False))
            end = b
    return sorted(out)


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts, then what is left of others goes."""
    parts, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def spans_of(text: Column, model: Model) -> Column:
    """Array of struct(kind, start, end, base) of a text; null has none."""

    def run(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "base")
        rows = [[dict(zip(names, s)) for s in find_spans(t or "", model)] for part in row_slices(texts) for t in part.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))

    return F.arrow_udf(run, _SPANS).asNondeterministic()(text)


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and `spans` (struct of kind number, start, end, base), a row per input row, by kind and start.

    Places are code points, ends exclusive. A null or empty text has no spans. Only the two named columns are
    looked at. No rows give no rows.
    """
    model = fit(docs, text)
    return docs.select(F.col(id), spans_of(F.col(text), model).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, their personal data replaced in the text; a null text stays null. All columns stay."""
    model = fit(docs, text)

    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else redacted(t, find_spans(t, model)) for part in row_slices(texts) for t in part.to_pylist()]
        return pa.array(rows, pa.string())

    return docs.withColumn(text, F.arrow_udf(run, T.StringType()).asNondeterministic()(F.col(text)))
