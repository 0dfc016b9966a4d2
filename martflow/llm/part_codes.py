"""Vectors as short codes: each vector is cut into parts, each part is replaced by its nearest codebook entry.

Codebooks come from Lloyd's rounds in whole numbers, with the parts resident at their owners:

1. The first codebook of each position are the parts of the vectors of the smallest ids.
2. Every part is dealt once to the owner of its nearest entry: rows are keyed by (position, entry, salt) and hold
   a block of members (their numbers and values). Salts divide an entry into owners of bounded size, so an entry
   with a third of all parts is many owners. Blocks are dealt out by that key and written.
3. An owner sums its resident members; the sums of an entry's owners are added up, and their floored means are the
   next codebook. Nothing but sums moves.
4. Under the new codebook an owner finds which members another entry is nearer to. Those migrate: only they are
   shuffled, to a new layer of members of their new owners. The rest stays where it is written; whoever left a
   layer is found again from the codebooks since the layer was made, so no layer is ever rewritten.

The codebooks (positions x entries) are the only thing collected and handed to tasks: as many numbers as
`entries` vectors have, whatever the input. Layers are written to the shared folder, so a lost executor costs
the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.llm.common import give_back, stored

POSITIONS, ENTRIES, ROUNDS = 16, 64, 2
#: A component becomes floor(SCALE * x), held within +-BOUND, so that no sum of squares leaves 64 bits.
SCALE, BOUND = 256, 1 << 28
#: Vectors that a task gathers before it deals out their parts, and members of an owner.
GATHER, OWNER = 1 << 15, 1 << 18
_MEMBERS = "position int, entry int, salt int, n long, sums array<long>, ids array<long>, vals binary"


def usable(vectors: DataFrame, id: str, embedding: str, positions: int = POSITIONS) -> DataFrame:
    """`row` (own number), `id`, `vector` (whole numbers) of the rows whose vector has finite components only.

    Vectors whose length is not that of the smallest id's vector, or no multiple of `positions`, are dropped too.
    """
    whole = F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))
    fine = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine & (F.size(embedding) > 0) & (F.size(embedding) % positions == 0)).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), whole.alias("vector")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry's index (ties: the lower one) and its squared distance, for each part."""
    best, least = np.zeros(len(parts), np.int64), None
    for k, entry in enumerate(entries):
        gap = parts - entry
        distance = np.einsum("ij,ij->i", gap, gap)
        if least is None:
            least = distance
        else:
            closer = distance < least
            best[closer], least[closer] = k, distance[closer]
    return best, least


@dataclass(frozen=True)
class Codebooks:
    """Entries of each position: an array (positions, entries, width) of whole numbers."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _first(rows: DataFrame, positions: int, entries: int) -> Codebooks:
    """The parts of the vectors of the smallest ids (nulls last, then by value); at most `entries` of them."""
    smallest = rows.orderBy(F.col("id").asc_nulls_last(), "vector")
    least = smallest.limit(1).collect()
    if not least:
        return Codebooks(np.zeros((positions, 0, 0), np.int64))
    width = len(least[0].vector)
    chosen = [r.vector for r in smallest.filter(F.size("vector") == width).limit(entries).collect()]
    return Codebooks(np.array(chosen, np.int64).reshape(len(chosen), positions, width // positions).transpose(1, 0, 2))


def _blocks(position: int, entry: np.ndarray, salt: int, ids: np.ndarray, parts: np.ndarray, members: bool = True) -> list[dict]:
    """A row for each entry: its count and sums, and its members unless only sums are asked for."""
    order = np.argsort(entry, kind="stable")
    entry, ids, parts = entry[order], ids[order], parts[order]
    edges = np.flatnonzero(np.diff(entry, prepend=-1, append=-1)) if len(entry) else []
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = {"position": position, "entry": int(entry[a]), "salt": salt, "n": int(b - a), "sums": parts[a:b].sum(axis=0).tolist()}
        out.append(own | {"ids": ids[a:b].tolist(), "vals": parts[a:b].astype(np.int32).tobytes()} if members else own | {"ids": None, "vals": None})
    return out


_ARROW = pa.schema([
    ("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
    ("ids", pa.list_(pa.int64())), ("vals", pa.binary()),
])


def _batches(rows: list[dict], size: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[i : i + size], _ARROW)


def _deal(rows: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """Every part, keyed by its nearest entry."""
    entries = books.entries
    positions, _, width = entries.shape

    def run(batches):
        ids, parts, n, turn = [], [], 0, 0

        def flush():
            own, all_parts = np.concatenate(ids), np.concatenate(parts)
            for position in range(positions):
                some = all_parts[:, position]
                # A gathering goes to one salt of each entry; the next one, anywhere, most likely to another.
                yield from _batches(_blocks(position, nearest(some, entries[position])[0], int((own[0] * 2654435761 + turn) % salts), own, some))

        for batch in batches:
            matrix = _matrix(batch["vector"], positions * width).reshape(-1, positions, width)
            ids.append(batch["row"].to_numpy())
            parts.append(matrix)
            n += len(matrix)
            if n >= GATHER:
                yield from flush()
                ids, parts, n, turn = [], [], 0, turn + 1
        if n:
            yield from flush()
        give_back()

    return rows.select("row", "vector").mapInArrow(run, _MEMBERS)


def _review(layer: DataFrame, since: list[Codebooks]) -> DataFrame:
    """Of each block, by the codebooks made since: the sums of the members that stay, and as members those that leave now.

    A member left earlier if any codebook but the last already sent it elsewhere; it is in a later layer.
    """
    books = [b.entries for b in since]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                position, entry = row["position"], row["entry"]
                ids = np.array(row["ids"], np.int64)
                parts = np.frombuffer(row["vals"], np.int32).reshape(len(ids), -1).astype(np.int64)
                for k, entries in enumerate(books):
                    to = nearest(parts, entries[position])[0]
                    stays = to == entry
                    if k == len(books) - 1:
                        out += _blocks(position, to[~stays], row["salt"], ids[~stays], parts[~stays])
                    ids, parts = ids[stays], parts[stays]
                out += _blocks(position, np.full(len(ids), entry), row["salt"], ids, parts, members=False)
            yield from _batches(out)
        give_back()

    return layer.mapInArrow(run, _MEMBERS)


def _owned(members: DataFrame, name: str) -> DataFrame:
    """Blocks of members, at their owners."""
    return stored(members.repartition("position", "entry", "salt"), name)


def _updated(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry replaced by the floored mean of its members; entries without members stay."""
    width = books.entries.shape[2]
    added = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
    out = books.entries.copy()
    # One row for each position and entry at most.
    for row in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *added).collect():
        out[row.position, row.entry] = [row[f"s{k}"] // row.n for k in range(width)]
    return Codebooks(out)


def train(rows: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after so many rounds over rows of `row`, `id` and `vector` (see `usable`)."""
    books = _first(rows, positions, entries)
    if not books.entries.size:
        return books
    rows = rows.filter(F.size("vector") == positions * books.entries.shape[2])
    # Parts are spread over positions x entries owners; salts keep the fullest ones, up to all parts, near OWNER.
    salts = max(1, -(-rows.count() // OWNER))
    layers: list[tuple[DataFrame, int]] = []
    history = [books]
    for k in range(rounds):
        if k == 0:
            layers.append((_owned(_deal(rows, books, salts), "parts"), 0))
            sums = layers[0][0]
        else:
            found = [stored(_review(layer, history[born + 1 :]), "review") for layer, born in layers]
            sums = reduce(DataFrame.unionByName, found)  # of those that stay, and of those that come
            layers.append((_owned(sums.filter("ids IS NOT NULL"), "moved"), k))
        history.append(_updated(history[-1], sums.select("position", "entry", "n", "sums")))
    return history[-1]


def encode(rows: DataFrame, books: Codebooks, key: str = "row") -> DataFrame:
    """`key`, `codes` (an entry's index for each position) and `error` (squared distances, summed) of the rows' vectors."""
    entries = books.entries
    positions, _, width = entries.shape

    def run(batches):
        for batch in batches:
            parts = _matrix(batch["vector"], positions * width).reshape(-1, positions, width)
            found = [nearest(parts[:, p], entries[p]) for p in range(positions)]
            codes, error = np.stack([c for c, _ in found], 1), sum(e for _, e in found)
            flat = pa.array(codes.reshape(-1).astype(np.int32))
            at = pa.array(np.arange(0, len(flat) + 1, positions, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(at, flat), pa.array(error, pa.int64())], [key, "codes", "error"])

    kept = rows.filter(F.size("vector") == positions * width).select(key, "vector")
    kind = T.StructType([kept.schema[key], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return kept.mapInArrow(run, kind)


def compress(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """`id`, `label`, `codes`, `error`, `label_error` and `codebooks_sha256` of every usable row.

    Rows are dropped whose vector is null, empty, or holds null or non-finite components, and those of a length that is
    no multiple of `positions` or not that of the smallest id's vector. Components beyond 2^20 count as 2^20.
    Rows of one id are separate rows; a null id comes last where first vectors are chosen, rows that tie there
    are ordered by their vector. Rows with a null label share one `label_error`. Only the three named columns are
    looked at. No usable rows give no rows.
    """
    named = vectors.select(F.struct(F.col(id).alias("id"), F.col(label).alias("label")).alias("of"), F.col(embedding).alias("embedding"))
    kept = stored(usable(named, "of", "embedding", positions).select("row", F.col("id").alias("of"), "id.id", "vector"), "vectors")
    books = train(kept, positions, entries, rounds)
    if books.entries.size:
        codes = encode(kept, books, "of")
    else:  # no usable row
        codes = kept.select("of", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    codes = stored(codes.select("of.id", "of.label", "codes", "error"), "codes")
    total = stored(codes.groupBy(F.col("label").alias("other")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = codes.join(total, F.col("label").eqNullSafe(F.col("other")))
    return found.select(F.col("id").alias(id), F.col("label").alias(label), "codes", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
