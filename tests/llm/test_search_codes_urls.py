"""Ranked search, vector codes and url rules against plain loops, and their edges."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from martflow.llm import part_codes, ranked_search, url_rules
from martflow.llm.common import folder
from martflow.llm.queries import QUERIES
from tests.llm import brute

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FAR = float("inf")


def ranked(docs, items, top=20):
    """(item, rank, doc, score) by a loop over all documents."""
    split = [(i, Counter(re.findall(TERM, brute.lower(t)))) for i, t in docs]
    split = [(i, tf) for i, tf in split if tf]
    n, length = len(split), sum(tf.total() for _, tf in split)
    df = Counter(t for _, tf in split for t in tf)
    out = []
    for item, text in items:
        terms, scores = Counter(re.findall(TERM, brute.lower(text))), []
        for i, tf in split:
            m = 75 + 25 * tf.total() * n // length
            score = 0
            for t, times in terms.items():
                if t in tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, FAR if i is None else i))
        out += [(item, k + 1, None if i == FAR else i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return out


@pytest.fixture(scope="module")
def corpus():
    """A few words are everywhere, most are rare; copies tie."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(700)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[5]) for k in range(60)]
    docs += [(3000, None), (3001, ""), (3002, "!!"), (None, texts[5]), (5, texts[5]), (3003, "É É straße W1 w1_w2 " + "w7 " * 20_000)]
    items = [(k, " ".join(rng.choices(words, weights, k=12))) for k in range(30)] + [(40, texts[5]), (41, None), (42, ""), (43, "nowhere"), (44, "É straße"), (None, "w3 w3 w50"), (1, "w2")]
    return docs, items


@pytest.mark.parametrize("size, terms", [(1 << 20, 1 << 18), (2000, 1 << 18), (5000, 40)])
def test_ranks(spark, same, corpus, size, terms):
    """One shard, many shards, and several blocks of queries."""
    docs, items = corpus
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = ranked_search.build_index(frame, folder(spark, "index"), size=size)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search.search(index, asked, "text", terms=terms).select("of.item_id", "rank", "doc_id", "score")
    same(found, ["item_id", "rank", "doc_id", "score"], ranked(docs, items))


def test_skipping_loses_nothing():
    """Short and long lists, short runs, few results: the k best are those of plain sums."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, shard = 300, ranked_search.Postings.__new__(ranked_search.Postings)
        shard.n, shard.lists, sums = n, {}, np.zeros(n, np.int64)
        terms = [(t, int(rng.integers(0, 5))) for t in range(int(rng.integers(1, 12)))]
        for t, w in terms:
            at = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.05, 0.4, 0.9])).astype(np.int32)
            if len(at):
                worth = rng.integers(1, 50, len(at))
                shard.lists[t] = (at, worth, int(worth.max()))
                sums[at] += worth * w
        at, score = ranked_search.best_of(shard, terms, top=5, run=32)
        assert Counter(score.tolist()) >= Counter(sorted(sums[sums > 0].tolist())[-5:])
        assert all(sums[a] == s for a, s in zip(at, score)) and len(set(at.tolist())) == len(at)


def test_skipping_skips(monkeypatch):
    """Where accumulators decide, long lists put up no candidates."""
    shard = ranked_search.Postings.__new__(ranked_search.Postings)
    everywhere = np.arange(5000, dtype=np.int32)
    rare = np.arange(0, 100, dtype=np.int32)
    shard.n, shard.lists = 5000, {1: (everywhere, np.ones(5000, np.int64), 1), 2: (rare, np.full(100, 50), 50)}
    seen = []
    added = ranked_search._added
    monkeypatch.setattr(ranked_search, "_added", lambda at, *rest: seen.append(len(at)) or added(at, *rest))
    at, score = ranked_search.best_of(shard, [(1, 1), (2, 1)], top=20, run=500)
    assert set(score.tolist()) == {51} and sum(seen) <= 500


def test_search_edges(spark, corpus):
    docs, items = (spark.createDataFrame(rows, kind) for rows, kind in zip(corpus, ("doc_id long, text string", "item_id long, text string")))
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "term", "shard", "query", "rank", "score", "of")])
    wide = items.select("*", *[F.lit(1).alias(c) for c in ("query", "rank", "doc_id", "score", "of", "item")])
    assert ranked_search.rank_documents(clash, wide).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.rank_documents(clash, wide, top=1).count() == len(ranked(*corpus, top=1))
    assert not ranked_search.rank_documents(docs.limit(0), items).count()
    assert not ranked_search.rank_documents(docs, items.limit(0)).count()


def coded(rows, positions, entries, rounds):
    """rows: (id, label, vector); (id, codes, error, label_error) and the codebooks, by loops."""
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (FAR if r[0] is None else r[0], r[2]))
    width = len(kept[0][2]) // positions
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(positions)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(positions)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda e: (gap(part, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], book)].append(c[p])
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e])) if e in own else entry for e, entry in enumerate(book)]
    codes = [[near(c[p], books[p]) for p in range(positions)] for c in cut]
    errors = [sum(gap(c[p], books[p][k[p]]) for p in range(positions)) for c, k in zip(cut, codes)]
    by = Counter()
    for (_, y, _), e in zip(kept, errors):
        by[y] += e
    return [(i, k, e, by[y]) for (i, y, _), k, e in zip(kept, codes, errors)], books


@pytest.mark.parametrize("positions, entries, rounds, owner, gather", [(4, 8, 2, 1 << 18, 1 << 15), (2, 5, 4, 40, 50), (8, 3, 1, 10, 7), (4, 300, 2, 1 << 18, 1 << 15), (4, 8, 0, 100, 100)])
def test_codes(spark, same, monkeypatch, positions, entries, rounds, owner, gather):
    """Also with several migrations, salted owners, and more entries than vectors."""
    monkeypatch.setattr(part_codes, "OWNER", owner)
    monkeypatch.setattr(part_codes, "GATHER", gather)
    rng = random.Random(9)
    rows = [(k, rng.choice([None, 1, 2]), [rng.gauss(k % 5, 1.5) for _ in range(16)]) for k in range(200)]
    rows += [(500 + k, 3, rows[7][2]) for k in range(60)]  # copies
    rows += [(None, 1, [0.5] * 16), (7, 2, rows[9][2]), (600, 1, None), (601, 1, [math.nan] * 16), (602, None, [math.inf] + [0.0] * 15), (603, 1, [None] + [0.0] * 15), (604, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "row", "of", "error", "codes", "vector", "position", "other")])
    want, books = coded(rows, positions, entries, rounds)
    found = part_codes.compress(df, positions=positions, entries=entries, rounds=rounds)
    got = Counter((r.vec_id, tuple(r.codes), r.error, r.label_error) for r in found.collect())
    assert got == Counter((i, tuple(k), e, y) for i, k, e, y in want)
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in found.collect()} == {brute.digest(text)}


def test_code_edges(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert not part_codes.compress(spark.createDataFrame([], kind)).count()
    assert not part_codes.compress(spark.createDataFrame([(1, 1, None), (2, 2, [1.0] * 15)], kind)).count()
    # Huge components are held; other lengths than the first vector's are dropped.
    odd = spark.createDataFrame([(1, None, [3e38] * 16), (2, None, [-3e38] * 16), (3, 1, [0.0] * 32)], kind)
    assert sorted((r.vec_id, r.error) for r in part_codes.compress(odd).collect()) == [(1, 0), (2, 0)]


def test_only_movers_are_dealt_anew(spark):
    """The second layer holds the parts whose nearest entry changed, and nothing else."""
    rng = random.Random(2)
    df = spark.createDataFrame([(k, 1, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)], "vec_id long, label int, embedding array<double>")
    rows = part_codes.stored(part_codes.usable(df, "vec_id", "embedding", 4), "vectors")
    first = part_codes._first(rows, 4, 6)
    layer = part_codes._owned(part_codes._deal(rows, first, 2), "parts")
    second = part_codes._updated(first, layer)
    review = part_codes._review(layer, [second])
    before, after = ({(r.row, p): c for r in part_codes.encode(rows, b).collect() for p, c in enumerate(r.codes)} for b in (first, second))
    moved = {(i, r.position): r.entry for r in review.filter("ids IS NOT NULL").collect() for i in r.ids}
    assert moved == {k: e for k, e in after.items() if before[k] != e} and 0 < len(moved) < len(after)
    assert review.agg(F.sum("n")).first()[0] == 1200


URLS = [None, "", "example.net/en/x", "://", "http://", "http://NET/", "http://a.net", "http://a.net?x=/", "https://Example.NET/en/1", "http://www.example.net/en", "http://xexample.net/en/1",
        "https://m.example.com/de/9.html?x=1#y", "http://example.com/de", "http://a.ORG/fr/é", "http://org/fr/", "http://a.org:80/fr/", "ftp://u@a.net/fr/://b.org/fr/", "http://a.net\n/x", "http://É.net/" + "long/" * 20_000]


def listed(url):
    """host, path and entry of the list."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host, best = brute.lower(host), None
    for h, p, _ in url_rules.LIST:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best or ""):
            best = h + p
    return host, path, best, rest[len(host) + len(path) :]


def test_listed_urls(spark, same, small, rows_of):
    pages = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[5]), (3, URLS[5])]
    df = spark.createDataFrame(pages, "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in ("row", "id", "host", "path", "rule", "verdict", "tokens", "n")])
    found = url_rules.judge_urls(df)
    same(found, ["page_id", "host", "path", "rule"], [(i, *listed(u)[:3]) for i, u in pages])
    verdicts = {f"{h}{p}": v for h, p, v in url_rules.LIST}
    assert all(r.verdict == verdicts[r.rule] for r in found.collect() if r.rule)
    assert not url_rules.judge_urls(df.limit(0)).count()
    nothing = url_rules.judge_urls(df.filter("url IS NULL OR url = ''")).collect()
    assert [(r.host, r.path, r.rule, r.verdict, r.matched) for r in nothing] == [("", "", None, "allow", None)] * 2
    assert url_rules.judge_urls(df, rules=[]).filter("verdict <> 'allow'").count() == 0


def tokens(url):
    host, path, _, rest = listed(url)
    found = [(mark, w) for mark, part in (("h:", host), ("p:", brute.lower(path)), ("q:", brute.lower(rest))) for w in re.findall(url_rules.TOKEN, part)]
    return frozenset(mark + re.sub("^[0-9]+$", "#", w) for mark, w in found)


def test_mined_rules(spark, small, rows_of):
    """All combinations by loops; the surest rule decides."""
    pages = rows_of("pages", "page_id", "url")
    verdicts = {f"{h}{p}": v for h, p, v in url_rules.LIST}
    seen = [(tokens(u), verdicts[listed(u)[2]]) for _, u in pages if listed(u)[2]]
    sides = Counter(v for _, v in seen)
    enough = max(url_rules.LEAST, math.ceil(len(seen) * url_rules.SUPPORT))
    count = {v: Counter(t for ts, w in seen for t in ts if w == v) for v in sides}
    known = {t: abs(count["allow"][t] * sides["block"] - count["block"][t] * sides["allow"]) for t in count["allow"] | count["block"] if count["allow"][t] + count["block"][t] >= enough}
    sets = defaultdict(Counter)
    for ts, v in seen:
        best = sorted((t for t in ts if t in known), key=lambda t: (-known[t], t))[: url_rules.WIDTH]
        for k in range(1, len(best) + 1):
            for some in combinations(sorted(best), k):
                sets[some][v] += 1
    sure = {(s, v): n / c.total() for s, c in sets.items() for v, n in c.items() if n >= enough and n / c.total() >= url_rules.CONFIDENCE}
    idle = {(s, v) for (s, v), c in sure.items() if any(sure.get((tuple(x for x in s if x != t), v), 0) >= c for t in s if len(s) > 1)}
    rules = {k: (c, sets[k[0]][k[1]] / len(seen)) for k, c in sure.items() if k not in idle}
    want = {}
    for i, u in pages:
        hits = [(*x, v, " ".join(s)) for (s, v), x in rules.items() if set(s) <= tokens(u)]
        if not listed(u)[2]:
            want[i] = max(hits)[2:] if hits else ("allow", None)
    found = {r.page_id: (r.verdict, r.matched) for r in QUERIES["op13_url_rules"](spark, small).collect() if not r.rule}
    assert found == want and any(m for _, m in want.values())


def test_rules_generalise(spark):
    """Held-out urls: a word of the path decides, hosts say nothing."""
    rng = random.Random(4)
    rows = []
    for k in range(600):
        bad = rng.random() < 0.4
        words = [rng.choice(["casino", "pills", "bets"] if bad else ["news", "wiki", "docs"]), rng.choice("abcdef")]
        rows.append((k, f"https://h{rng.randint(0, 30)}.example/{'/'.join(words)}/{k}?page={k}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "row long, url string, verdict string").withColumns(url_rules.parts(F.col("url"))).withColumn("tokens", url_rules.tokens())
    rules = url_rules.mine_rules(df.filter("row < 300"))
    best = {r.row: r.verdict for r in url_rules.match(df.filter("row >= 300"), rules).collect()}
    assert sum(best.get(k, "allow") == v for k, _, v in rows[300:]) >= 0.98 * 300


def test_rules_of_tokens_that_part_nothing_alone(spark):
    """Two tokens decide together and neither alone; eight others of the url part the labels a little, each by itself."""
    rows = []
    for k in range(400):
        x, y = k % 2, k // 2 % 2
        verdict = "block" if x != y else "allow"
        noise = [f"w{n}" for n in range(8) if verdict == "block" or k % 16 != 4 * (n % 4)]
        rows.append((k, f"https://h.example/x{x}/y{y}/{'/'.join(noise)}", verdict))
    df = spark.createDataFrame(rows, "row long, url string, verdict string").withColumns(url_rules.parts(F.col("url"))).withColumn("tokens", url_rules.tokens())
    rules = url_rules.mine_rules(df)
    found = {r.text: (r.verdict, r.confidence) for r in rules.collect()}
    assert found["p:x0 p:y1"] == found["p:x1 p:y0"] == ("block", 1.0) and found["p:x0 p:y0"] == found["p:x1 p:y1"] == ("allow", 1.0)
    best = {r.row: r.verdict for r in url_rules.match(df, rules).collect()}
    assert all(best.get(k) == v for k, _, v in rows)
