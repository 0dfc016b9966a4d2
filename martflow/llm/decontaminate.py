"""Training documents that hold test items: BM25 retrieval with block-max pruning, then overlap checks.

The test items are indexed, the training passages are the queries.

1. Items become postings (item, term, impact). An impact is the term's BM25 weight in the item as a share of
   the item's own total, so a score is the share of the item that a passage has, and one threshold fits all.
   Document frequencies and lengths are of all items. Spark makes the postings; they are handed to the tasks
   in shards of bounded size (`SHARD_POSTINGS`), each a pass over the documents.
2. Every document is cut into passages of twice the longest item's words, overlapping by half, so every
   stretch as long as an item lies in one. A passage is a set of terms.
3. As in WAND, a passage's terms are ordered by their greatest impact: an item that holds only terms of the
   prefix that stays below the threshold cannot reach it, so candidates come from the other, rare terms'
   postings. Postings are kept in blocks of items with the greatest impact of each: a block whose sum of block
   maxima stays below the threshold is passed over, only the blocks left are scored. All passages of a slice
   are taken at once, as arrays. Every item at or above the threshold is found.
4. A hit stands if the share of the question's word sequences that the passage has, and that of the answer's,
   reach `OVERLAP`. The question is the item without its last sentence, which is the answer; an item of one
   sentence is both. As a last sentence may be a word, a hit also stands if the share of the whole item's word
   sequences reaches `WHOLE`: a copy that lacks the end, or has another, is a copy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.llm.common import batch_slices, find_words, give_back, giving_back, stored, string_bytes, word_hashes

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, RUN = 0.6, 0.6, 3
#: Share of the whole item's word sequences from which a hit stands whatever its answer.
WHOLE = 0.8
#: Items in a block; postings and bytes of item text in a shard, which bounds what a task is handed.
BLOCK, SHARD_POSTINGS, SHARD_BYTES = 16, 1_000_000, 16 << 20
#: Bytes of text whose passages are searched at once; postings of all their terms are in memory.
SLICE = 1 << 19

# Words are runs of letters, digits and bytes beyond ASCII, in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the row it is in."""
    raw, at = string_bytes(column)
    raw = _LOWER[raw]
    starts, _, row = find_words(raw, at, _APART)
    return word_hashes(raw, starts, 0, blank=_APART), row


def _postings(batches):
    for batch in batches:
        for part in batch_slices(batch, "text"):
            words, row = terms(part["text"])
            keys, counts = np.unique(np.stack([row.astype(np.uint64), words], 1), axis=0, return_counts=True)
            own = keys[:, 0].astype(np.int64)
            length = np.bincount(row, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part["item"].take(pa.array(own)), pa.array(keys[:, 1].view(np.int64)), pa.array(counts, pa.int64()), pa.array(length[own], pa.int64())],
                ["item", "term", "n", "length"],
            )


def impacts(items: DataFrame) -> DataFrame:
    """`item`, `term`, `impact` (share of the item's BM25 total) and `length`, of rows with `item` and `text`."""
    found = stored(items.mapInArrow(_postings, "item long, term long, n long, length long"), "postings")
    each = found.groupBy("item").agg(F.first("length").alias("length"))
    n_items, mean = each.agg(F.count("*"), F.avg("length")).first()
    n_items, mean = n_items or 0, mean or 1.0
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = rarity * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / mean))
    weighed = stored(found.join(frequency, "term").select("item", "term", "length", weight.alias("weight")), "impacts")
    total = weighed.groupBy("item").agg(F.sum("weight").alias("total"))
    return weighed.join(total, "item").select("item", "term", (F.col("weight") / F.col("total")).alias("impact"), "length")


def _ragged(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ranges [begin, begin + count), and of which range each is."""
    ends = np.cumsum(count)
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count), which


def _sentences(text: str) -> tuple[str, str]:
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass(frozen=True)
class Index:
    """A shard of the items, by number: postings by term and item, and the same by block.

    Each text of an item is an item here; `items` are their ids, which may repeat.
    """

    items: np.ndarray
    vocabulary: np.ndarray  # sorted hashes
    greatest: np.ndarray  # impact, by term
    at: np.ndarray  # first posting of each term
    number: np.ndarray
    impact: np.ndarray
    block_at: np.ndarray  # first block of each term
    block: np.ndarray
    block_greatest: np.ndarray
    block_first: np.ndarray  # first posting of each block, one more entry than blocks
    window: int
    question: list[np.ndarray]
    answer: list[np.ndarray]
    whole: list[np.ndarray]

    @staticmethod
    def build(postings, texts) -> Index:
        """postings: table of entry, term, impact, length; texts: table of entry, item, text, a row per entry."""
        texts = texts.sort_by("entry")
        items = texts["item"].to_numpy()
        number = np.searchsorted(texts["entry"].to_numpy(), postings["entry"].to_numpy())
        vocabulary, term = np.unique(postings["term"].to_numpy().view(np.uint64), return_inverse=True)
        order = np.lexsort((number, term))
        number, term, impact = number[order], term[order], postings["impact"].to_numpy()[order]
        key = term * (len(items) // BLOCK + 1) + number // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        parts = [[], [], []]
        for text in texts["text"].to_pylist():
            for side, words in zip(parts, (*_sentences(text or ""), text or "")):
                side.append(terms(pa.array([words]))[0])
        return Index(
            items, vocabulary, np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(vocabulary)))) if len(term) else impact,
            np.searchsorted(term, np.arange(len(vocabulary) + 1)), number, impact,
            np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), number[first] // BLOCK,
            np.maximum.reduceat(impact, first) if len(term) else impact, np.append(first, len(term)),
            2 * int(max([1, *postings["length"].to_pylist()])), *parts,
        )

    def search(self, words: np.ndarray, row: np.ndarray, threshold: float):
        """Row, first word (of all words given), item number and score of each passage that has an item."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        known = np.flatnonzero(self.vocabulary[at] == words) if len(self.vocabulary) else np.zeros(0, np.int64)
        n_words = np.bincount(row, minlength=int(row.max(initial=-1)) + 1)
        begin = np.cumsum(n_words) - n_words
        half = self.window // 2
        steps = np.maximum(-(-n_words // half) - 1, 1)  # passages of each row
        passages = np.cumsum(steps) - steps
        place = (known - begin[row[known]]) // half
        term, own = at[known], row[known]
        last = place == steps[own]  # a last part that is shorter belongs to the passage before it
        pairs = [np.stack([passages[own] + place, term], 1)[~last], np.stack([passages[own] + place - 1, term], 1)[place > 0]]
        width = len(self.vocabulary) + 1
        keys = np.unique(np.concatenate(pairs) @ np.array([width, 1]))
        passage, term = keys // width, keys % width
        # WAND: by greatest impact; the terms from which the sum can reach the threshold.
        order = np.lexsort((self.greatest[term], passage))
        passage, term = passage[order], term[order]
        total = np.cumsum(self.greatest[term])
        head = np.searchsorted(passage, passage)
        reach = total - (total[head] - self.greatest[term[head]]) >= threshold
        n_blocks = len(self.items) // BLOCK + 1

        def blocks(some):
            places, which = _ragged(self.block_at[term[some]], np.diff(self.block_at)[term[some]])
            return places, passage[some][which] * n_blocks + self.block[places]

        _, candidate = blocks(np.flatnonzero(reach))
        candidate = np.unique(candidate)
        # Block maxima of all terms, for the candidate blocks of the passages that have any.
        some = np.flatnonzero(np.isin(passage, candidate // n_blocks))
        places, key = blocks(some)
        slot = np.minimum(np.searchsorted(candidate, key), max(len(candidate) - 1, 0))
        hit = candidate[slot] == key if len(candidate) else np.zeros(0, bool)
        places, slot = places[hit], slot[hit]
        bound = np.bincount(slot, self.block_greatest[places], len(candidate))
        good = bound >= threshold
        some = good[slot]
        places, slot = places[some], slot[some]
        # Scores of the items in the blocks left.
        posting, which = _ragged(self.block_first[places], np.diff(self.block_first)[places])
        key = (candidate[slot[which]] // n_blocks) * len(self.items) + self.number[posting]
        found, which = np.unique(key, return_inverse=True)
        score = np.bincount(which, self.impact[posting], len(found))
        found, score = found[score >= threshold], score[score >= threshold]
        passage, item = found // len(self.items), found % len(self.items)
        own = np.searchsorted(passages, passage, "right") - 1
        return own, begin[own] + (passage - passages[own]) * half, item, score

    def overlaps(self, words: np.ndarray, item: int) -> tuple[float, float, float]:
        """Shares of the question's, of the answer's and of the whole item's runs of words that the passage has."""
        return _share(self.question[item], words), _share(self.answer[item], words), _share(self.whole[item], words)


def _share(part: np.ndarray, words: np.ndarray) -> float:
    n = min(RUN, len(part))
    if not n:
        return 1.0
    runs = lambda x: {x[k : k + n].tobytes() for k in range(len(x) - n + 1)}
    own = runs(part)
    return len(own & runs(words)) / len(own)


#: From here down are the numbers of texts without an id.
NAMELESS = -(1 << 62)
_MATCH = T.StructType([T.StructField("id", T.LongType()), T.StructField("item", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("score", "question", "answer")])


def _search(index: Index, threshold: float, overlap: float):
    """The best passage of each document and item, of those that stand."""

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text", SLICE):
                words, row = terms(part["text"])
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                best: dict[tuple[int, int], tuple] = {}
                for own, at, item, score in zip(*(x.tolist() for x in index.search(words, row, threshold))):
                    q, a, whole = index.overlaps(words[at : min(at + index.window, ends[own])], item)
                    if q >= overlap and a >= overlap or whole >= max(WHOLE, overlap):
                        key = own, int(index.items[item])
                        best[key] = max(best.get(key, (0.0,)), (score, q, a))
                keys = list(best)
                yield pa.RecordBatch.from_arrays([
                    part["id"].take(pa.array([k for k, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int64()),
                    *[pa.array([best[k][j] for k in keys], pa.float64()) for j in range(3)],
                ], ["id", "item", "score", "question", "answer"])

    return run


def build_shards(items: DataFrame, id: str = "item_id", text: str = "text"):
    """The indexes of all texts of all items, one after another; each is of bounded size, an item's texts in one."""
    rows = items.select(F.col(id).cast("long").alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL")
    rows = rows.distinct().withColumn("entry", F.monotonically_increasing_id())
    # A text without an id is an item of its own, by a number that no id has.
    rows = stored(rows.withColumn("item", F.coalesce("item", F.lit(NAMELESS) - F.col("entry"))), "items")
    own = impacts(rows.select(F.col("entry").alias("item"), "text")).withColumnRenamed("item", "entry")
    postings = stored(own.join(rows.select("entry", "item"), "entry"), "index")
    n, size = postings.count(), rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-n // SHARD_POSTINGS), -(-size // SHARD_BYTES))
    for k in range(shards):
        own = F.expr(f"pmod(xxhash64(item), {shards}) = {k}")
        part = postings.filter(own).toArrow()
        if part.num_rows:
            yield Index.build(part, rows.filter(own).toArrow())


def find_contaminated(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """`id`, `item`, `score`, `question` and `answer` (shares): the items that documents hold, a row each.

    Null and empty texts hold nothing. Items without a word are no items; one without an id is an item of its
    own, and its `item` is null; of items that share an id
    each text counts, with the best one's shares. Repeated documents give repeated rows. No rows, or no items, give no rows.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = None
    for index in build_shards(items, item_id, item_text):
        part = rows.mapInArrow(giving_back(_search(index, threshold, overlap)), _MATCH)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _MATCH)
    named = F.when(F.col("item") > NAMELESS, F.col("item")).alias("item")
    return found.select(F.col("id").alias(id), named, "score", "question", "answer")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with the columns they have; each row is judged by its own text."""
    indexes = list(build_shards(items))

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in batch_slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE):
            clean = np.ones(part.num_rows, bool)
            ids = pa.array(np.arange(part.num_rows))
            for index in indexes:
                for hit in _search(index, THRESHOLD, OVERLAP)([pa.RecordBatch.from_arrays([ids, part["text"]], ["id", "text"])]):
                    clean[hit["id"].to_numpy()] = False
            out += clean.tolist()
        give_back()
        return pa.array(out, pa.bool_())

    if not indexes:
        return docs
    return docs.filter(F.arrow_udf(run, T.BooleanType()).asNondeterministic()(F.col(text)))
