"""Ranked lexical search: an inverted index in shards, searched by terms first for short lists, by documents for long ones.

Index (`build_index`). A task gathers documents of about `SHARD` bytes of text, a shard. Each term of the shard is a row:
the documents that hold it (numbers within the shard) and how often. Rows are written where they are made, so nothing
is shuffled; a row of term 0 holds the shard's document ids and lengths. Every word of every whole text is indexed.

Search (`search`). Corpus sizes and document frequencies are sums over index rows. Queries are taken in blocks of a
bounded number of terms; their terms and weights go to the tasks, where the lists of a shard that the block asks for
meet (they are shuffled by shard). For each query, in each shard:

1. Term at a time: the short lists are added up into accumulators, materialised as one sorted list of documents
   and sums; its greatest sum is its bound.
2. Document at a time: that list is one iterator beside the long lists, which have bounds as well. In runs of
   documents, only iterators whose bounds together reach the k-th best score so far put up candidates (the rest
   cannot make a hit by themselves); the others are looked up for candidates alone, in order of their bounds,
   and a candidate is dropped as soon as what is left cannot bring it there. Scores that tie with the k-th stay.
3. The k best of the shard are its result; ranks come from the shards' results, pruned in the map tasks.

Terms are compared by 64-bit hashes of their bytes. A lost executor costs the shards it had; a retried task makes the
same shard numbers, and only one attempt is kept.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martflow.llm.common import batch_slices, find_words, folder, give_back, stored, string_bytes, word_hashes

#: Bytes of text in a shard (one document at least), terms of a block of queries, results of a query.
SHARD, TERMS, TOP = 16 << 20, 1 << 18, 20
#: A list is short if it holds at most this share of the shard's documents; documents of a run.
SHORT, RUN = 1 / 16, 1024
#: The row of a shard that holds its documents.
DOCUMENTS = 0

_INDEX = "shard long, term long, df int, at array<int>, tf array<int>, ids array<long>"
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("df", pa.int32()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term: runs of ASCII letters and digits and of all else beyond ASCII, A-Z in lower case."""
    raw, at = string_bytes(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    starts, _, row = find_words(raw, at, _PARTS)
    hashes = word_hashes(raw, starts, 7, blank=_PARTS).view(np.int64)
    hashes[hashes == DOCUMENTS] = 1
    return hashes, row


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def _shard(number: int, ids: list, hashes: np.ndarray, docs: np.ndarray):
    """The index rows of a shard: that of its documents (lengths as `tf`), then one for each term."""
    n = len(ids)
    lengths = np.bincount(docs, minlength=n)
    one = {"shard": [number], "term": [DOCUMENTS], "df": [n], "at": [None], "tf": [lengths.tolist()], "ids": [ids]}
    yield pa.RecordBatch.from_pydict(one, _SCHEMA)
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.flatnonzero((np.diff(hashes, prepend=0) != 0) | (np.diff(docs, prepend=-1) != 0) | (np.arange(len(docs)) == 0))
    tf = np.diff(np.append(new, len(docs)))
    hashes, docs = hashes[new], docs[new]
    first = np.flatnonzero((np.diff(hashes, prepend=0) != 0) | (np.arange(len(hashes)) == 0))
    sizes = np.diff(np.append(first, len(hashes)))
    ends = np.append(first, len(hashes))
    for i in range(0, len(first), 20_000):
        j = min(i + 20_000, len(first))
        a, b = ends[i], ends[j]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(j - i, number)), pa.array(hashes[first[i:j]]), pa.array(sizes[i:j], pa.int32()),
            _lists(docs[a:b], sizes[i:j], pa.int32()), _lists(tf[a:b], sizes[i:j], pa.int32()), pa.nulls(j - i, pa.list_(pa.int64())),
        ], schema=_SCHEMA)


def index_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHARD) -> DataFrame:
    """`shard`, `term` (hash), `df`, `at` (documents), `tf`, and in the row of term 0 `ids` and, as `tf`, lengths."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, hashes, rows, held = [], [], [], 0

        def flush():
            yield from _shard(number, ids, np.concatenate(hashes), np.concatenate(rows))

        for batch in batches:
            for part in batch_slices(batch, "text", size):
                own, row = _terms(part["text"])
                hashes.append(own)
                rows.append(row + len(ids))
                ids += part["id"].to_pylist()
                held += part["text"].nbytes
                if held >= size:
                    yield from flush()
                    number, ids, hashes, rows, held = number + 1, [], [], [], 0
        if ids:
            yield from flush()
        give_back()

    # Documents without a term are in no list and in no sum; they are kept for their place only.
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _INDEX)


def build_index(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SHARD) -> DataFrame:
    """Write the index of all documents to a folder, and return its rows."""
    index_rows(docs, id, text, size).write.parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


class Postings:
    """The lists of one shard: documents, and what each is worth before the term's weight."""

    def __init__(self, table: pa.Table, documents: int, length: int) -> None:
        rows = table.column("term").to_numpy()
        head = int(np.flatnonzero(rows == DOCUMENTS)[0])
        self.ids, sizes = (table.column(c)[head].values for c in ("ids", "tf"))
        # A document's m, and a posting's worth: 64-bit whole numbers, rounded down.
        m = 75 + 25 * sizes.to_numpy().astype(np.int64) * documents // length
        self.n, self.lists = len(m), {}
        for k in np.flatnonzero(rows != DOCUMENTS):
            at = table.column("at")[int(k)].values.to_numpy()
            tf = table.column("tf")[int(k)].values.to_numpy().astype(np.int64)
            worth = 1_000_000_000 * tf // (1000 * tf + 12 * m[at])
            self.lists[int(rows[k])] = (at, worth, int(worth.max()))


def _keep_best(at: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All that reach the top-th best score, and that score (1 where there are fewer: a score above 0 is asked for)."""
    if len(score) < top:
        return at, score, 1
    least = max(1, int(np.partition(score, len(score) - top)[len(score) - top]))
    fine = score >= least
    return at[fine], score[fine], least


def _added(at: np.ndarray, score: np.ndarray, lists, rest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Look candidates up in further lists, the best bound first; those that cannot reach `least` any more go."""
    for docs, worth, bound in lists:
        fine = score + rest >= least
        if not fine.all():
            at, score = at[fine], score[fine]
        if not len(at):
            return at, score
        place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
        score = score + np.where(docs[place] == at, worth[place], 0)
        rest -= bound
    fine = score >= least
    return at[fine], score[fine]


def best_of(postings: Postings, terms: list[tuple[int, int]], top: int = TOP, short: float = SHORT, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The shard's documents with the `top` best scores (all that tie with the last), and these scores.

    `terms`: hash and weight (that of the term, times its occurrences in the query).
    """
    found = [(postings.lists[t], w) for t, w in terms if w > 0 and t in postings.lists]
    brief = [(at, worth * w) for (at, worth, _), w in found if len(at) <= max(1, short * postings.n)]
    longs = sorted(((at, worth * w, most * w) for (at, worth, most), w in found if len(at) > max(1, short * postings.n)), key=lambda x: -x[2])
    if brief:  # term at a time: one sum for each document, then the documents that have one
        at = np.concatenate([a for a, _ in brief])
        held, place = np.unique(at, return_inverse=True)
        sums = np.zeros(len(held), np.int64)
        np.add.at(sums, place, np.concatenate([w for _, w in brief]))
        longs.append((held, sums, int(sums.max())))
        longs.sort(key=lambda x: -x[2])
    if not longs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    # rest[k]: what iterators k and later can bring together.
    rest = [sum(b for _, _, b in longs[k:]) for k in range(len(longs) + 1)]
    best, score, least = np.zeros(0, np.int32), np.zeros(0, np.int64), 1
    for start in range(0, postings.n, run):
        # Iterators k and later together stay below the least score: a hit needs one of the first k.
        first = next((k for k in range(len(longs) + 1) if rest[k] < least), len(longs))
        spans = [np.searchsorted(at, (start, start + run)) for at, _, _ in longs[:first]]
        picked = [(at[a:b], worth[a:b]) for (at, worth, _), (a, b) in zip(longs, spans) if a < b]
        if not picked:
            continue
        sums, held = np.zeros(run, np.int64), np.zeros(run, bool)
        for at, worth in picked:
            sums[at - start] += worth
            held[at - start] = True
        some = np.flatnonzero(held & (sums + rest[first] >= least))
        at, own = _added((some + start).astype(np.int32), sums[some], longs[first:], rest[first], least)
        if len(at):
            best, score, least = _keep_best(np.concatenate([best, at]), np.concatenate([score, own]), top)
    return best, score


def _weighted(index: DataFrame, queries: DataFrame, documents: int) -> DataFrame:
    """`query`, `term`, `weight` of the queries' terms that some document holds."""
    df = index.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = (2.0 * documents + 2) / (2 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(ratio)).cast("long") * F.col("times")
    return queries.join(df, "term").select("query", "term", weight.alias("weight"))


def _query_terms(queries: DataFrame, text: str) -> DataFrame:
    """`query` (its row's number), `term`, `times`."""

    def run(batches):
        for batch in batches:
            hashes, row = _terms(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(row)), pa.array(hashes, pa.int64())], ["query", "term"])

    found = queries.select("query", F.col(text).alias("text")).mapInArrow(run, "query long, term long")
    return found.groupBy("query", "term").agg(F.count("*").alias("times"))


def _search_block(index: DataFrame, block: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """`query`, `doc_id`, `score`: each shard's best for a block of queries."""
    queries: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row in block.collect():  # as many as the terms of a block
        queries[row.query].append((row.term, row.weight))

    def run(table: pa.Table) -> pa.Table:
        postings, out = Postings(table, documents, length), tuple([np.zeros(0, np.int64)] for _ in range(3))
        for query, terms in queries.items():
            at, score = best_of(postings, terms, top)
            if len(at) > top:  # ties: the smaller ids
                ids = postings.ids.take(pa.array(at))
                order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), -score))[:top]
                at, score = at[order], score[order]
            out[0].append(np.full(len(at), query))
            out[1].append(at)
            out[2].append(score)
        query, at, score = (np.concatenate(x).astype(np.int64) for x in out)
        give_back()
        return pa.table([pa.array(query), postings.ids.take(pa.array(at)), pa.array(score)], names=["query", "doc_id", "score"])

    wanted = block.select("term").union(index.sparkSession.range(1).select(F.lit(DOCUMENTS).cast("long"))).distinct()
    asked = index.join(wanted, "term", "left_semi")
    return asked.groupBy("shard").applyInArrow(run, "query long, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, text: str = "text", top: int = TOP, terms: int = TERMS) -> DataFrame:
    """`of` (the query's whole row), `rank`, `doc_id`, `score` of the `top` best documents of each query.

    Ties go to the smaller id; documents without an id come last among equals. Every row of `queries` is a query of
    its own, whatever its id; one whose text is null, empty or without a known term has no result.
    """
    rows = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.struct("*").alias("of")), "queries")
    asked = stored(_query_terms(rows.select("query", F.col("of")[text].alias("text")), "text"), "query-terms")
    heads = index.filter(F.col("term") == DOCUMENTS)
    count = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + (x > 0).cast("long"))
    length = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    documents, words = heads.agg(F.sum(count), F.sum(length)).first()
    weighted = stored(_weighted(index, asked, documents or 0), "query-weights")
    blocks = max(1, math.ceil(asked.count() / terms))
    own = F.pmod(F.xxhash64("query"), F.lit(blocks))
    path = folder(index.sparkSession, "hits")
    for k in range(blocks):
        part = weighted.filter(own == k) if blocks > 1 else weighted
        _search_block(index, part, documents or 0, words or 1, top).write.mode("append").parquet(path)
    hits = index.sparkSession.read.schema("query long, doc_id long, score long").parquet(path)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = hits.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(rows, "query").select("of", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """`item`, `rank`, `doc_id`, `score`: the `top` documents of each item.

    A null, empty or term-less text has no terms and is never a result, and counts for no size. Repeated rows are
    documents (and items) of their own. Ids are whole numbers. Only the named columns are looked at. No documents or no
    items give no rows. Very long texts are read whole; one is a shard of its own.
    """
    index = build_index(docs, folder(docs.sparkSession, "index"), id, text)
    found = search(index, items.select(F.col(item).alias("item"), F.col(item_text).alias("text")), "text", top)
    return found.select(F.col("of.item").alias(item), "rank", "doc_id", "score")
