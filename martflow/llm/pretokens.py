"""The split of texts that byte-level vocabularies apply before their merges, on arrays of code points.

The rule is public_tokenizers.PATTERN: contractions, letters, digits and other signs each with one
blank before them, and white space.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

SPACE, LETTER, DIGIT, OTHER, EDGE = range(5)
#: Unicode's property White_Space, as inclusive ranges. Fixed values.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    signs = range(sys.maxunicode + 1)
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in signs), np.uint8, len(signs))
    for a, b in WHITE_SPACE:
        out[a : b + 1] = SPACE
    return out


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and where each text's pieces begin (one more entry than texts)."""
    joined = "\0".join([*texts, ""])  # an edge after each text
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _classes()[codes]
    edges = np.cumsum([len(t) + 1 for t in texts]) - 1 if texts else np.zeros(0, np.int64)
    kind[edges] = EDGE
    n = len(codes)
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[edges] = True
    start = first.copy()
    # White space before other signs: its last character stands alone, or joins them if it is a blank.
    ink = np.flatnonzero(first & (kind != SPACE) & (kind != EDGE))
    ink = ink[ink > 0]
    ink = ink[kind[ink - 1] == SPACE]
    start[ink - 1] = True
    start[ink[codes[ink - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll where an apostrophe begins a piece; there is an edge after any text.
    mark = np.flatnonzero(first & start & (codes == 39) & (kind == OTHER))
    after = codes[mark + 1] if n else mark
    one = mark[np.isin(after, [ord(c) for c in "stmd"])]
    two = mark[np.isin(after, [ord(c) for c in "rvl"])]
    second = np.where(codes[two + 1] == ord("l"), ord("l"), ord("e")) if len(two) else two
    two = two[codes[two + 2] == second]
    for begin, length in ((one, 2), (two, 3)):
        start[begin + 1] = False
        rest = begin + length
        start[rest[kind[rest] == LETTER]] = True
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    own = kind[begins] != EDGE
    begins, ends = begins[own], ends[own]
    found = [joined[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
    return found, np.searchsorted(begins, np.concatenate([[0], edges + 1]))


def chunks(texts: list[str], size: int = 1 << 20):
    """Runs of texts of about `size` characters."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part
