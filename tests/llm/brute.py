"""The operators' results by plain loops, to compare with."""

from __future__ import annotations

import re
from hashlib import sha256


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(text: str | bytes) -> str:
    return sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def op1(docs: list[tuple], size: int = 20) -> list[tuple]:
    """docs: (doc_id, text); the rows of op1."""
    last, first = float("inf"), {}
    key = lambda i: last if i is None else i
    split = [(i, words(t)) for i, t in docs]
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            window = tuple(ws[k : k + size])
            first[window] = min(first.get(window, (last, last)), (key(i), k))
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - size + 1):
            if first[tuple(ws[k : k + size])] < (key(i), k):
                gone.update(range(k, k + size))
        out.append((i, len(ws), len(gone), digest(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return out


def op4(docs: list[tuple]) -> list[tuple]:
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    return [(i, len((t or "").encode()), n := count(t or ""), n > 1024) for i, t in docs]


def op7(docs: list[tuple]) -> list[tuple]:
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [own.encode_ordinary(t or "") for _, t in docs]
    return [(i, len(x), digest(" ".join(map(str, x))), digest(t or "")) for (i, t), x in zip(docs, ids)]


def op2_base(docs: list[tuple]) -> list[tuple]:
    out = []
    for i, t in docs:
        ws, t = words(t), t or ""
        places: dict[tuple, list[int]] = {}
        for k in range(len(ws) - 2):
            places.setdefault(tuple(ws[k : k + 3]), []).append(k)
        again = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(3)}
        lines = [line for line in t.split("\n") if words(line)]
        n = len(ws)
        out.append((i, n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n))
    return out


def op5_base(docs: list[tuple]) -> list[tuple]:
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for i, t in docs:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        found = sorted((k, label) for p, label in phrases.items() for k in range(len(ws)) if tuple(ws[k : k + len(p)]) == p)
        first, last = (found[0][0], found[-1][0]) if found else (None, None)
        out.append((i, len(ws), len(found), first, last, ",".join(sorted({x for _, x in found}))))
    return out


def op10_base(docs: list[tuple]) -> list[tuple]:
    kinds = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    out = []
    for i, t in docs:
        spans = sorted((m.start(), k, m.end()) for k, (_, pattern, fits) in enumerate(kinds) for m in re.finditer(pattern, t or "") if fits(m))
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        out.append((i, *counts, digest(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans))))
    return out


def op8_base(docs: list[tuple]) -> list[tuple]:
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            d = int(c) * (1 + k % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    out = []
    for i, t in docs:
        spans = [(name, m.start(), m.end()) for name, pattern, fits in kinds for m in re.finditer(pattern, t or "") if fits(m[0])]
        counts = [sum(s[0] == name for s in spans) for name, *_ in kinds]
        out.append((i, *counts, digest(",".join(f"{n}:{a}:{b}" for n, a, b in spans))))
    return out


def op9(pages: list[tuple]) -> list[tuple]:
    """For the given pages only, whose article element holds the main text in h1 and p elements."""
    import html

    out = []
    for i, page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
        blocks = re.split(r"</?(?:h1|p)>", article[1]) if article else []
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        out.append((i, "\n".join(line for line in lines if line)))
    return out


def sets(docs: list[tuple], size: int) -> dict:
    out = {}
    for k, (i, t) in enumerate(docs):
        ws = words(lower(t))
        out[k] = frozenset(zip(*(ws[j:] for j in range(size)))) if len(ws) >= size else frozenset([tuple(ws)] if ws else [])
    return out


def op3(docs: list[tuple], size: int = 2, percent: int = 80) -> list[tuple]:
    """All pairs of rows; components by repeated passes."""
    own = sets(docs, size)
    label = {k: docs[k][0] for k in own}
    links = [
        (a, b) for a in own for b in range(a)
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            known = [x for x in (label[a], label[b]) if x is not None]
            least = min(known) if known else None
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return [(docs[k][0], len(own[k]), label[k], docs[k][0] == label[k]) for k in own]


def holds_item(text: str | None, items: list[tuple]) -> set:
    """Items whose words stand in the text one after another."""
    flat = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))) + " "
    return {i for i, t in items if t and flat(t) in flat(text)}
