"""The main text of web pages: boosted trees on DOM nodes, decoded from the root down.

1. A page becomes a tree of its block elements; inline elements count into the block they are in.
2. Every node gets features: tag, words of class, id and role, the same of what it is in, text and link
   density of its subtree, punctuation, depth, and its place among its siblings.
3. Gradient-boosted regression trees, trained here, give each node the odds of being main text. Their
   teacher is markup that says what it is (article, main, nav, footer, comment and advert classes) on at most
   `TRAIN_PAGES` pages, the lowest by a hash of the id.
4. Decoding goes over the tree: a node is kept whole, dropped whole, or open, and only below an open node do
   its children decide. So no dropped node has a kept descendant. The best choice follows from one pass
   upwards (sums of odds, weighted by text) and one downwards.

Pages are read twice and never shuffled; trees and features are made and used in the task that reads the page.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martflow.llm.common import row_slices

TRAIN_PAGES, TRAIN_NODES = 400, 60_000
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 24
#: Log odds that leaving a node open costs.
OPEN_COST = 0.05

# Elements by what they do to text. Fixed values.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg title".split())
UNSEEN = RAW | set("head select option button object canvas audio video".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
ENDS_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
GROUPS = [
    {"p"}, set("h1 h2 h3 h4 h5 h6".split()), set("ul ol li dl dt dd".split()), set("table tr td th tbody thead".split()), {"div", "section"},
    {"article"}, {"main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"pre", "blockquote", "figure"}, UNSEEN, {"html", "body"},
]
WORDS = [
    set("ad ads advert advertisement advertising banner promo promoted sponsor sponsored".split()),
    set("nav navigation navbar menu breadcrumb breadcrumbs pager pagination toc".split()),
    set("comment comments commentlist reply replies discussion disqus respond".split()),
    set("cookie cookies consent notice popup modal overlay alert gdpr newsletter subscribe".split()),
    set("sidebar side widget related recommended share social teaser".split()),
    set("footer header masthead copyright legal".split()),
    set("article content entry main post story text body".split()),
]
OTHER_TAGS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, UNSEEN]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>|</?[A-Za-z][^<]*\Z", re.S)
#: The same behind the page's last `>`, where no tag can close: looked for there, each would be read to the end.
_TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*|</?[A-Za-z][^<]*\Z", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_LETTERS = re.compile("[a-z]+")
_SENTENCE = re.compile("[.,;:!?]")
_CLOSING = {name: re.compile(rf"</{name}[\s>/]|\Z", re.I) for name in RAW}


class Page:
    """A page's block elements in page order, and its blocks of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.words = ["html"], [-1], [0], [set()]
        #: Of each node: inline elements, characters in links, links.
        self.inline, self.linked, self.links = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._parse(html)

    def _open(self, name: str, parent: int, attributes: str) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append({w for m in _MARKS.finditer(attributes) for w in _LETTERS.findall(m[1].lower())})
        for column in (self.inline, self.linked, self.links):
            column.append(0)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        at, here, within, buffer = 0, 0, 0, []
        stack = [0]  # open block elements
        count: dict[str, int] = {}  # of open blocks by name, so that a stray end tag costs no search

        def flush() -> None:
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        def shut(upto: int) -> None:
            flush()
            while len(stack) > upto:
                count[self.tag[stack.pop()]] -= 1

        def text(raw: str) -> None:
            nonlocal within
            if raw:
                decoded = references.unescape(raw) if "&" in raw else raw
                buffer.append(decoded)
                if within:
                    self.linked[stack[-1]] += len(decoded)

        last, look = html.rfind(">"), 0
        while (look := html.find("<", max(look, at))) >= 0:
            m = (_TOKEN if look < last else _TAIL).match(html, look)
            if not m:
                look += 1
                continue
            text(html[at:look])
            at = m.end()
            name = _NAME.match(m[0])
            if not name:
                continue
            name, closing = name[1].lower(), m[0][1] == "/"
            if name in ("br", "hr"):
                buffer.append(" ") if name == "br" else flush()
                continue
            if name in INLINE or name in VOID:
                if name == "a":
                    within = 0 if closing else 1
                    self.links[stack[-1]] += not closing
                self.inline[stack[-1]] += not closing
                continue
            if closing:
                if count.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    shut(k)
                else:
                    flush()
                within = 0
                continue
            if name == "html":
                continue
            ended = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            while len(stack) > 1 and self.tag[stack[-1]] in ended:
                shut(len(stack) - 1)
            flush()
            within = 0
            here = self._open(name, stack[-1], m[0][len(name) + 1 : -1])
            if name in RAW:  # up to its end tag nothing is markup
                at = _CLOSING[name].search(html, at).start()
                continue
            if not m[0].endswith("/>"):
                stack.append(here)
                count[name] = count.get(name, 0) + 1
        text(html[at:])
        shut(1)
        flush()

    def sums(self, own: np.ndarray) -> np.ndarray:
        """Over each node's subtree; children come after their parents."""
        out = own.astype(float)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, words, marks, blocks = (np.zeros(n) for _ in range(4))
        for node, text in self.blocks:
            chars[node] += len(text)
            words[node] += text.count(" ") + 1
            marks[node] += len(_SENTENCE.findall(text))
            blocks[node] += 1
        self.own_chars = chars
        parent = np.array(self.parent)
        chars, words, marks, blocks, inline, linked, links = map(self.sums, (chars, words, marks, blocks, np.array(self.inline), np.array(self.linked), np.array(self.links)))
        nodes = self.sums(np.ones(n))
        group = np.array([[tag in g for g in GROUPS] for tag in self.tag], float)
        named = np.array([[bool(own & w) for w in WORDS] for own in self.words], float).reshape(n, len(WORDS))
        own = np.concatenate([group, named], 1)
        inherited = np.zeros_like(own)  # of all ancestors
        for k in range(1, n):
            p = self.parent[k]
            inherited[k] = np.maximum(inherited[p], own[p])
        siblings, index = np.zeros(n), np.zeros(n)
        seen: dict[int, int] = {}
        alike: dict[tuple[int, str], int] = {}
        for k in range(1, n):
            index[k] = seen[self.parent[k]] = seen.get(self.parent[k], -1) + 1
            alike[self.parent[k], self.tag[k]] = alike.get((self.parent[k], self.tag[k]), 0) + 1
        for k in range(1, n):
            siblings[k] = seen[self.parent[k]] + 1
        same = np.array([1] + [alike[self.parent[k], self.tag[k]] for k in range(1, n)])
        up = np.maximum(parent, 0)
        numbers = np.stack([
            np.log1p(chars), np.log1p(words), linked / (chars + 1), chars / (nodes + inline), marks / (words + 1), words / (blocks + 1e-9) * (blocks > 0),
            np.log1p(nodes), np.array(self.depth, float), index / np.maximum(siblings, 1), np.log1p(siblings), same / np.maximum(siblings, 1),
            chars / (chars[up] + 1), np.log1p(links), np.arange(n) / n,
        ], 1)
        return np.concatenate([own, inherited, numbers], 1).astype(np.float32)

    def teacher(self) -> np.ndarray:
        """Of each node the share of its text that markup says is the main text."""
        n = len(self.tag)
        # Known for the page as a whole: does anything call itself the article?
        names = {"article", "main"}
        marked = any(tag in names for tag in self.tag)
        wanted = np.zeros(n)
        inside = np.zeros(n, bool)
        out = np.zeros(n, bool)
        for k in range(n):
            p = self.parent[k]
            inside[k] = self.tag[k] in names or (p >= 0 and inside[p])
            out[k] = (p >= 0 and out[p]) or any(self.tag[k] in g for g in OTHER_TAGS) or any(self.words[k] & w for w in WORDS[:6])
        whole, kept = np.zeros(n), np.zeros(n)
        for node, text in self.blocks:
            whole[node] += len(text)
            link = self.linked[node] > 0.5 * len(text)
            if not out[node] and (inside[node] if marked else not link and text.count(" ") >= 7):
                kept[node] += len(text)
        whole, kept = self.sums(whole), self.sums(kept)
        wanted[whole > 0] = kept[whole > 0] / whole[whole > 0]
        return wanted

    def decode(self, odds: np.ndarray) -> str:
        """The text of the nodes that the best consistent choice keeps, one line a block."""
        n = len(self.tag)
        gain = odds * np.log1p(self.own_chars)
        keep = self.sums(gain)
        best = np.zeros(n)  # of whole, dropped and open
        below = np.zeros(n)
        for k in range(n - 1, -1, -1):
            best[k] = max(keep[k], -keep[k], below[k] - OPEN_COST + abs(gain[k]))
            if k:
                below[self.parent[k]] += best[k]
        state = np.zeros(n, np.int8)  # 1 keeps its own text; 2 keeps all below, -2 drops all below
        for k in range(n):
            p = self.parent[k]
            if p >= 0 and abs(state[p]) == 2:
                state[k] = state[p]
            elif best[k] == keep[k]:
                state[k] = 2
            elif best[k] == -keep[k]:
                state[k] = -2
            else:
                state[k] = 1 if gain[k] > 0 else -1
        return "\n".join(text for node, text in self.blocks if state[node] > 0)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of equal depth: of each inner node a feature and a bound, of each leaf a value."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    start: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins; y is a probability."""
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], 1)  # bin k: at most bound k
    mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), start)
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        feature, bound, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            top = 1e-6
            if len(rows) > 1:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for f in range(n_features):
                    if not len(bounds[f]):
                        continue
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(bounds[f]) + 1))
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(bounds[f]) + 1))
                    gain = (gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1))[:-1] - whole
                    k = int(np.argmax(gain))
                    if gain[k] > top:
                        top, feature[node], bound[node] = gain[k], f, bounds[f][k]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
        leaf = np.zeros(2**DEPTH)
        own = at - inner
        np.add.at(leaf, own, g)
        leaf = RATE * leaf / (np.bincount(own, h, 2**DEPTH) + 1)
        score += leaf[own]
        trees.append((feature, bound, leaf))
    feature, bound, leaf = map(np.array, zip(*trees))
    return Trees(feature, bound, leaf, start)


_ROW = T.StructType([T.StructField("features", T.ArrayType(T.FloatType())), T.StructField("target", T.DoubleType()), T.StructField("weight", T.DoubleType())])


def train(pages: DataFrame, id: str = "page_id", html: str = "html", train_pages: int = TRAIN_PAGES) -> Trees | None:
    """Trees from the markup of at most `train_pages` pages; None without any."""

    def run(batches):
        for batch in batches:
            for html in batch["html"].to_pylist():
                page = Page(html)
                x, y = page.features(), page.teacher()
                weight = np.log1p(page.sums(page.own_chars))
                some = np.flatnonzero(weight > 0)
                if len(some):
                    yield pa.RecordBatch.from_pylist(
                        [{"features": x[k].tolist(), "target": float(y[k]), "weight": float(weight[k])} for k in some],
                        pa.schema([("features", pa.list_(pa.float32())), ("target", pa.float64()), ("weight", pa.float64())]),
                    )

    rows = pages.select(F.xxhash64(id, html).alias("rank"), F.col(html).alias("html")).filter("html <> ''")
    sample = rows.orderBy("rank").limit(train_pages).mapInArrow(lambda batches: run(batches), _ROW).limit(TRAIN_NODES).collect()
    if not sample:
        return None
    x = np.array([r["features"] for r in sample], np.float32)
    return boost(x, np.array([r["target"] for r in sample]), np.array([r["weight"] for r in sample]))


def main_text(html: Column, trees: Trees | None) -> Column:
    """The main text of a page; empty where there is none. Evaluated once for each row."""

    def run(pages: pa.Array) -> pa.Array:
        out = []
        for part in row_slices(pages):
            parsed = [Page(h or "") for h in part.to_pylist()]
            features = [p.features() for p in parsed]
            odds = trees.odds(np.concatenate(features)) if trees else np.zeros(sum(map(len, features)))
            cuts = np.cumsum([len(f) for f in features])[:-1]
            out += [p.decode(o) for p, o in zip(parsed, np.split(odds, cuts))]
        return pa.array(out, pa.string())

    return F.arrow_udf(run, T.StringType()).asNondeterministic()(html)


def extract(pages: DataFrame, id: str = "page_id", html: str = "html", trees: Trees | None = None) -> DataFrame:
    """The pages, with `text` (main text) in place of the html column; other columns stay as they are.

    A null or empty page, and one without main text, has an empty text. A page column named text is replaced.
    No rows give no rows.
    """
    trees = trees or train(pages, id, html)
    others = [F.col(c) for c in pages.columns if c not in (html, "text")]
    return pages.select(*others, main_text(F.col(html), trees).alias("text"))
