"""Byte-level BPE encoding by replaying the merges over all words at once, and decoding.

A task takes the new distinct words (pre-tokens) of `CORPUS` signs of its documents as one corpus. The bytes of all
words are laid out in one array; an inverted index leads from each pair of neighbouring tokens, named by
the rank of the token they make, to the positions where it stands. Ranks are taken in order; a merge
looks at its positions from left to right and updates the two neighbours it touches. If a merge makes a
pair of lower rank, that rank comes next, so the result is what encoding word by word gives.

Words already replayed are kept for the next chunks (`KEPT_WORDS` at most, then the store starts anew;
that changes the time only). A corpus-wide table of words would need a shuffle of every occurrence of
every word, so the index is per task: no shuffle at all, and no driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush
from typing import TypeVar

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import batch_slices, giving_back
from martflow.llm.pretokens import pretokens

VOCABULARY = "byte_bpe_50k.tiktoken"
KEPT_WORDS = 200_000
#: Bytes; longer words are replayed one by one.
LONG_WORD = 256
#: Bytes of text that are split into words at once; signs of text whose new words make one corpus.
SLICE, CORPUS = 1 << 20, 4 << 20
T = TypeVar("T")


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, which is also the rank of its merge."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def vocabulary(path: str) -> dict[int, bytes]:
    return {i: token for token, i in ranks(path).items()}


@cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id << 32 | right id) of all pairs that make a token, and the token's rank; a key above all at the end."""
    rank, keys, made = ranks(path), [], []
    for token, r in rank.items():
        for k in range(1, len(token)):
            left, right = rank.get(token[:k]), rank.get(token[k:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                made.append(r)
    keys, made = np.array([*keys, np.iinfo(np.int64).max], np.int64), np.array([*made, -1], np.int64)
    order = np.argsort(keys)
    return keys[order], made[order]


class Replay:
    """Token ids of words. Ids of word number k are flat[at[k]:at[k + 1]]; words yet to be replayed have a number, and no ids."""

    def __init__(self, path: str):
        self.rank, self.token = ranks(path), vocabulary(path)
        self.keys, self.made = pair_table(path)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _replay_new(self) -> None:
        """Replay the words that have no ids yet, as one corpus."""
        corpus, long, places, ids, counts = [], [], [], [], []
        whole_places, whole_ids, corpus_places, long_places = [], [], [], []
        for k, word in enumerate(self.new):
            raw = word.encode()
            if (whole := self.rank.get(raw)) is not None:
                whole_places.append(k)
                whole_ids.append(whole)
            elif len(raw) <= LONG_WORD:
                corpus_places.append(k)
                corpus.append(raw)
            else:
                long_places.append(k)
                long.append(raw)
        for own, (found, n) in (
            (whole_places, (np.array(whole_ids, np.int32), np.ones(len(whole_ids), np.int64))),
            (corpus_places, self._merge_corpus(corpus)),
            (long_places, self._merge_long(long)),
        ):
            places.append(np.array(own, np.int64))
            ids.append(found)
            counts.append(n)
        place, count, flat = np.concatenate(places), np.concatenate(counts), np.concatenate(ids)
        ends = np.zeros(len(self.new), np.int64)
        ends[place] = count
        order = np.argsort(np.repeat(place, count), kind="stable")
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(ends)])
        self.flat = np.concatenate([self.flat, flat[order].astype(np.int32)])
        self.new = []

    def _lay_out(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words' bytes, an edge (-1) before the first word and after each; each position's word."""
        lengths = np.array([1, *(len(w) + 1 for w in words)], np.int64)
        symbol = self.single.astype(np.int32)[np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)]
        symbol[np.cumsum(lengths) - 1] = -1
        return symbol, np.repeat(np.arange(-1, len(words), dtype=np.int32), lengths)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair of neighbours makes, or -1. An edge makes a key that no pair has."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _merge_corpus(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        symbol, owner = self._lay_out(words)
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        # Of each position the rank of its pair now, so that a place in the index is known to be out of date.
        found, run = np.full(n, -1, np.int32), 1 << 16
        for k in range(0, n - 1, run):
            found[k : min(k + run, n - 1)] = self._ranks(symbol[k : min(k + run, n - 1)], symbol[k + 1 : k + 1 + run])
        places = np.flatnonzero(found >= 0)
        places = places[np.argsort(found[places], kind="stable")]
        order, begins = np.unique(found[places], return_index=True)
        index = dict(zip(order.tolist(), np.split(places, begins[1:])))
        pushed: dict[int, list[int]] = {}
        order = order.tolist()  # ascending, so a heap
        while order:
            r = order[0]
            at = index.pop(r, None)
            if r in pushed:
                more = np.array(pushed.pop(r), np.int64)
                at = np.unique(more if at is None else np.concatenate([at, more]))
            at = at[found[at] == r]  # others went into another merge meanwhile
            if not len(at):
                heappop(order)
                continue
            # The leftmost of each word; its others wait, as this merge may make a pair of lower rank.
            own = owner[at]
            later = own[1:] == own[:-1]
            if later.any():
                first = np.append(True, ~later)
                index[r], at = at[~first], at[first]
            else:
                heappop(order)
            gone, left = after[at], before[at]
            then = after[gone]
            symbol[at], symbol[gone], found[gone], after[at], before[then] = r, -2, -1, then, at
            touched = np.concatenate([left, at])
            new = self._ranks(symbol[touched], symbol[np.concatenate([at, then])])
            found[touched] = new
            some = np.flatnonzero(new >= 0)
            for x, p in zip(new[some].tolist(), touched[some].tolist()):
                if x in pushed:
                    pushed[x].append(p)
                else:
                    pushed[x] = [p]
                    if x not in index:
                        heappush(order, x)
        alive = symbol >= 0
        return symbol[alive], np.bincount(owner[alive], minlength=len(words))

    def _merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words, position by position, so that a word of one repeated sign stays fast."""
        ids = [np.array(self._merge_word(raw), np.int32) for raw in words]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _merge_word(self, raw: bytes) -> list[int]:
        rank, token, known = self.rank, self.token, {}
        symbol = [*self.single[np.frombuffer(raw, np.uint8)].tolist(), -1]
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))

        def made(p: int) -> int:
            a, b = symbol[p], symbol[after[p]]
            if a < 0 or b < 0:
                return -1
            if (a, b) not in known:
                known[a, b] = rank.get(token[a] + token[b], -1)
            return known[a, b]

        index: dict[int, list[int]] = {}
        for p in range(len(raw)):
            if (r := made(p)) >= 0:
                index.setdefault(r, []).append(p)  # ascending, so a heap
        order = sorted(index)
        while order:
            r = order[0]
            places = index[r]
            while places and order[0] == r:  # until a pair of lower rank turns up
                p = heappop(places)
                if made(p) != r:
                    continue
                q = after[p]
                symbol[p], symbol[q], after[p], before[after[q]] = r, -2, after[q], p
                for t in (before[p], p):
                    if t >= 0 and (x := made(t)) >= 0:
                        if x not in index:
                            index[x] = []
                            heappush(order, x)
                        heappush(index[x], t)
            if not places and order[0] == r:
                heappop(order)
                del index[r]
        return [x for x in symbol if x >= 0]

    def _ids(self, own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, count = self.at[own], self.at[own + 1] - self.at[own]
        ends = np.cumsum(count)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)
        return self.flat[place], np.concatenate([[0], ends])[edges]

    def encode_all(self, parts: Iterable[tuple[T, list[str]]]) -> Iterator[tuple[T, np.ndarray, np.ndarray]]:
        """Each part's name, the ids of all its texts, and where each text's ids begin (one more entry than texts).

        Parts wait as numbers of their words until `CORPUS` signs have come; then the new words of all are replayed at once.
        """
        waiting, size = [], 0

        def done():
            self._replay_new()
            for name, own, edges in waiting:
                yield name, *self._ids(own, edges)
            waiting.clear()

        for name, texts in parts:
            words, edges = pretokens(texts)
            new = set(words).difference(self.number)
            if len(self.number) + len(new) > KEPT_WORDS:
                yield from done()
                self.clear()
                new, size = set(words), 0
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.new.extend(new)
            waiting.append((name, np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)), edges))
            size += sum(map(len, texts))
            if size >= CORPUS:
                yield from done()
                size = 0
        yield from done()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one more entry than texts)."""
        [(_, ids, at)] = self.encode_all([(None, texts)])
        return ids, at


_REPLAYS: dict[str, Replay] = {}


def _encode(path: str):
    def run(batches):
        # Kept for the worker's later tasks; one that ended early may have left words without ids.
        replay = _REPLAYS.pop(path, None) or Replay(path)
        parts = (part for batch in batches for part in batch_slices(batch, "text", SLICE))
        texts = ((part["id"], [t or "" for t in part["text"].to_pylist()]) for part in parts)
        for id, ids, at in replay.encode_all(texts):
            yield pa.RecordBatch.from_arrays([id, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["id", "ids"])
        _REPLAYS[path] = replay

    return run


def _decode(path: str):
    def run(batches):
        token = vocabulary(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                decoded = [b"".join(map(token.__getitem__, ids.values.to_numpy().tolist())) for ids in part["ids"]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and `ids` (array of int), a row per input row; a null or empty text has no ids.

    `path` names a vocabulary of ranks that every executor can read. Other columns are not looked at.
    No special tokens: their strings are ordinary text.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(path), f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str | None = None, id: str = "doc_id") -> DataFrame:
    """`id`, `ids` and `decoded` (the bytes of the ids); ids must be of the vocabulary."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema[id].dataType.simpleString()
    rows = encoded.select(F.col(id).alias("id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(path), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`decode(encode(docs))` in one pass: one worker for each task instead of two."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    forth, back = _encode(path), _decode(path)
    return rows.mapInArrow(giving_back(lambda batches: back(forth(batches))), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id)
