"""Removal of repeated word sequences: a count-min prefilter, then exact grouping of what is left.

A window is `size` consecutive words of one document. Every word that is covered by a window whose
word sequence also starts earlier (smaller id, or same id and earlier start) goes; windows are judged
on the input.

1. Documents are dealt by hash into pieces of about `piece_bytes`. Each piece makes its own count-min
   sketch: `ROWS` rows of counters (0, 1, "2 or more"), of which it sends the touched cells only,
   cut into blocks of cells.
2. One group per row and block adds the pieces' counters. Sums are never too small, so a window seen
   twice has a count of two or more in every row. The group answers each piece with one bit per cell.
3. Each piece sends, of the windows estimated repeated, the 96-bit digest and first place of each
   different one. One group per digest range finds the first place in the corpus, exactly, and answers
   with one bit per digest: whether the piece holds it.
4. Each piece removes the words of its repeated windows that are not the first.

A common window is one cell and one digest of a piece, however often it occurs, so no group grows with
a hot window. The texts are shuffled once: the three steps on pieces share that exchange. The width of
the sketch follows the input, so the share of false alarms stays the same at any size; they cost time
only, as the second pass decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import find_words, string_bytes, text_bytes, window_hashes, word_hashes

ROWS = 2
#: Sketch cells per window and row: of unrepeated windows about 5 % look repeated in both rows.
CELLS_PER_WINDOW = 4
#: Bytes of text in a piece, and windows in a block of cells: both are held in one task's memory.
PIECE_BYTES, BLOCK_WINDOWS = 8 << 20, 2 << 20
LEAST = 64  # pieces and blocks, so that a small input still uses many tasks

_ANSWER = "piece long, part long, mask binary"
_LAST = np.iinfo(np.int64).max


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _bits(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)


class _Piece:
    """The windows of a piece's documents, in order of id and start."""

    def __init__(self, rows: pa.Table, size: int, cell_bits: int, block_bits: int):
        ids = rows["id"].fill_null(_LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.rows = rows.take(pa.array(order))
        self.ids, self.block_bits, self.size = ids[order], block_bits, size
        raw, at = string_bytes(self.rows["text"])
        starts, lengths, self.row = find_words(raw, at)
        self.n_words = np.bincount(self.row, minlength=len(ids))
        first = np.cumsum(self.n_words) - self.n_words
        self.place = np.arange(len(starts)) - first[self.row]
        self.start = np.flatnonzero(self.place + size <= self.n_words[self.row])
        self.hashes = [window_hashes(word_hashes(raw, starts, seed), size, seed)[self.start] for seed in range(ROWS)]
        self.shift = np.uint64(64 - cell_bits)
        self.cell_bits = cell_bits

    def cells(self, row: int):
        """Touched cells, sorted; the cell of each window; windows in each cell."""
        return np.unique(self.hashes[row] >> self.shift, return_inverse=True, return_counts=True)

    def blocks(self, values: np.ndarray, bits: int):
        """Slices of sorted values of `bits` bits, by their leading bits."""
        head = (values >> np.uint64(bits - self.block_bits)).astype(np.int64)
        at = np.searchsorted(head, np.arange((1 << self.block_bits) + 1))
        for block in np.flatnonzero(at[1:] > at[:-1]).tolist():
            yield block, slice(at[block], at[block + 1])

    def repeated(self, masks: dict[int, bytes]) -> None:
        """Keep the windows that every row estimates repeated, sorted by digest; find each digest's first."""
        seen = np.ones(len(self.start), bool)
        for row in range(ROWS):
            cells, own, _ = self.cells(row)
            flags = np.zeros(len(cells), bool)
            for block, part in self.blocks(cells, self.cell_bits):
                flags[part] = _bits(masks[(row << self.block_bits) + block], part.stop - part.start)
            seen &= flags[own]
        self.start = self.start[seen]
        self.hashes = [h[seen] for h in self.hashes]
        self.tail = (self.hashes[1] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.tail, self.hashes[0]))  # stable: id and start stay in order
        self.start, self.head, self.tail = self.start[order], self.hashes[0][order], self.tail[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.head[1:] != self.head[:-1]) | (self.tail[1:] != self.tail[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1


def _sketch(size: int, cell_bits: int, block_bits: int):
    """The counters of a piece: part, cells as offsets within the block (as differences), flags for two or more."""

    def run(key, rows):
        piece, out = _Piece(rows, size, cell_bits, block_bits), []
        width = np.uint64((1 << (cell_bits - block_bits)) - 1)
        for row in range(ROWS):
            cells, _, counts = piece.cells(row)
            for block, part in piece.blocks(cells, cell_bits):
                offsets = (cells[part] & width).astype(np.uint32)
                out.append((key[0].as_py(), (row << block_bits) + block, _pack(np.diff(offsets, prepend=np.uint32(0))), np.packbits(counts[part] > 1).tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["piece", "part", "cells", "twice"])

    return run


def _merge(width_bits: int):
    """Add up the counters of one block; answer each piece which of its cells reach two."""

    def run(rows):
        counts = np.zeros(1 << width_bits, np.uint8)  # 0, 1, and 2 for more
        pieces = []
        for cells, twice in zip(rows["cells"].to_pylist(), rows["twice"].to_pylist()):
            own = np.cumsum(_unpack(cells, np.uint32), dtype=np.uint32)
            counts[own] = np.minimum(counts[own] + 1 + _bits(twice, len(own)), 2)
            pieces.append(own)
        masks = [np.packbits(counts[own] > 1).tobytes() for own in pieces]
        return pa.table({"piece": rows["piece"], "part": rows["part"], "mask": pa.array(masks, pa.binary())})

    return run


def _masks(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers["part"].to_pylist(), answers["mask"].to_pylist()))


def _candidates(size: int, cell_bits: int, block_bits: int):
    """Of a piece's windows estimated repeated: each different one, with its first place."""

    def run(key, rows, answers):
        piece, out = _Piece(rows, size, cell_bits, block_bits), []
        piece.repeated(_masks(answers))
        at = piece.start[piece.first]
        head, tail, ids, place = piece.head[piece.first], piece.tail[piece.first], piece.ids[piece.row[at]], piece.place[at]
        for block, part in piece.blocks(head, 64):
            out.append((key[0].as_py(), block, head[part].tobytes(), tail[part].tobytes(), _pack(ids[part]), _pack(place[part].astype(np.uint32))))
        names = ["piece", "part", "head", "tail", "ids", "place"]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, [pa.int64()] * 2 + [pa.binary()] * 4)], names)

    return run


def _winners(offset: int):
    """Find the first place of each digest of one range; answer each piece which of its digests hold it."""

    def run(rows):
        column = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name].to_pylist()]
        packed = lambda name, kind: [_unpack(x, kind) for x in rows[name].to_pylist()]
        heads = column("head", np.uint64)
        head, tail = np.concatenate(heads), np.concatenate(column("tail", np.uint32))
        ids, place = np.concatenate(packed("ids", np.int64)), np.concatenate(packed("place", np.uint32))
        order = np.lexsort((place, ids, tail, head))
        h, t, i, p = head[order], tail[order], ids[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        best = np.flatnonzero(new)[np.cumsum(new) - 1]
        wins = np.empty(len(order), bool)
        wins[order] = (i == i[best]) & (p == p[best])
        cuts = np.cumsum([len(x) for x in heads])[:-1]
        masks = [np.packbits(x).tobytes() for x in np.split(wins, cuts)]
        return pa.table({"piece": rows["piece"], "part": pa.array([x + offset for x in rows["part"].to_pylist()], pa.int64()), "mask": pa.array(masks, pa.binary())})

    return run


def _removal(size: int, cell_bits: int, block_bits: int, offset: int):
    """The documents of a piece without the words of windows that start earlier elsewhere."""

    def run(rows, answers):
        masks = _masks(answers)
        piece = _Piece(rows, size, cell_bits, block_bits)
        piece.repeated(masks)
        holds = np.zeros(len(piece.first), bool)
        for block, part in piece.blocks(piece.head[piece.first], 64):
            holds[part] = _bits(masks[offset + block], part.stop - part.start)
        lead = piece.start[piece.first][piece.group]
        same = (piece.ids[piece.row[lead]] == piece.ids[piece.row[piece.start]]) & (piece.place[lead] == piece.place[piece.start])
        later = piece.start[~(holds[piece.group] & same)]
        cover = np.zeros(len(piece.row) + 1, np.int64)
        np.add.at(cover, later, 1)
        np.add.at(cover, later + size, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.bincount(piece.row[gone], minlength=len(piece.ids))
        kept, at = [], np.concatenate([[0], np.cumsum(piece.n_words)])
        for k, text in enumerate(piece.rows["text"].to_pylist()):
            words = (text or "").encode().split()
            if removed[k]:
                words = [w for w, x in zip(words, gone[at[k] : at[k + 1]].tolist()) if not x]
            kept.append(b" ".join(words).decode())
        return pa.table({"id": piece.rows["id"], "n_words": pa.array(piece.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 20,
    piece_bytes: int = PIECE_BYTES, block_windows: int = BLOCK_WINDOWS, cells_per_window: int = CELLS_PER_WINDOW,
) -> DataFrame:
    """`id`, `n_words`, `n_removed` and `kept` (the words left, joined by one space), a row per input row.

    A null or empty text has no words and stays empty. A null id counts as the largest. Rows that share
    an id are one document as to order: of windows at the same start of such rows neither is earlier.
    Only the two named columns are used, so other columns may have any name. No rows give no rows.
    """
    total = text_bytes(docs, text)
    # Windows are at most bytes / 2; about bytes / 6 in prose. Only the share of false alarms depends on it.
    windows = max(total // 6, 1)
    block_bits = max(LEAST, -(-windows // block_windows)).bit_length() - 1
    cell_bits = max(block_bits + 10, (cells_per_window * windows).bit_length())
    pieces = max(LEAST, -(-total // piece_bytes))
    offset = ROWS << block_bits
    shape = (size, cell_bits, block_bits)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("piece", F.expr(f"pmod(xxhash64(id, text), {pieces}L)"))
    by_piece = rows.groupBy("piece")
    sketches = by_piece.applyInArrow(_sketch(*shape), "piece long, part long, cells binary, twice binary")
    repeated = sketches.groupBy("part").applyInArrow(_merge(cell_bits - block_bits), _ANSWER)
    found = by_piece.cogroup(repeated.groupBy("piece")).applyInArrow(
        _candidates(*shape), "piece long, part long, head binary, tail binary, ids binary, place binary"
    )
    first = found.groupBy("part").applyInArrow(_winners(offset), _ANSWER)
    kept = by_piece.cogroup(repeated.unionByName(first).groupBy("piece")).applyInArrow(
        _removal(*shape, offset), "id long, n_words long, n_removed long, kept string"
    )
    return kept.withColumnRenamed("id", id)
