"""The queries that SQL can express, for a database that reads the same tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS ws FROM documents),
words AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
windows AS MATERIALIZED (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') AS k FROM words WHERE p + 19 <= len(ws)),
repeated AS (SELECT k, min({{'d': doc_id, 'p': p}}) AS f FROM windows GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, p FROM windows JOIN repeated USING (k) WHERE doc_id <> f.d OR p <> f.p),
marked AS (
  SELECT w.doc_id, w.w, w.p,
    max(CASE WHEN v.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words w LEFT JOIN later v ON w.doc_id = v.doc_id AND w.p = v.p
),
kept AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP2 = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
grams AS (SELECT doc_id, p, w, lead(w) OVER d AS w1, lead(w, 2) OVER d AS w2 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
counted AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM grams WHERE w2 IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, p + k AS p FROM counted, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
m AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id
),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(10 * n_symbols > n_words AS INT) + CAST(2 * n_dup_lines > n_lines AS INT)
    + CAST(100 * n_repeat_words > 30 * n_words AS INT) + CAST(word_chars < 2 * n_words OR word_chars > 12 * n_words AS INT) AS n_soft_failed
  FROM m
),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_soft_failed > 0) AS failed FROM f GROUP BY source),
fit AS (SELECT sum(failed) / sum(n) AS mean, var_pop(failed / n) AS spread FROM hosts),
prior AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM fit),
verdicts AS (
  SELECT source, CASE WHEN (failed + strength * mean) / (n + strength) > mean + sqrt(mean * (1 - mean) / (strength + 1)) THEN 'watched' ELSE 'trusted' END AS host_verdict
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_soft_failed <= CASE host_verdict WHEN 'trusted' THEN 1 ELSE 0 END AS kept,
  n_soft_failed, host_verdict
FROM f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""

OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM docs),
shingles AS (
  SELECT DISTINCT doc_id, w || coalesce(' ' || w1, '') AS s
  FROM (SELECT doc_id, n, w, lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS w1 FROM words) WHERE w1 IS NOT NULL OR n = 1
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id AS d, doc_id AS m FROM docs UNION SELECT l.b, r.m FROM reach r JOIN links l ON l.a = r.d)
SELECT d AS doc_id, coalesce(n, 0) AS n_shingles, min(m) AS component_id, d = min(m) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = d GROUP BY d, n
"""

_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), {_SMALL}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS ts FROM documents),
sizes AS (SELECT count(*) AS total, CAST(sum(len(ts)) AS BIGINT) AS words FROM docs WHERE len(ts) > 0),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark),
asked AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM items) GROUP BY ALL),
postings AS MATERIALIZED (
  SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, len(ts) AS n, unnest(ts) AS t FROM docs) SEMI JOIN asked USING (t) GROUP BY ALL
),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY t
),
worth AS (SELECT d, doc_id, t, w, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // words)) AS v FROM postings JOIN weights USING (t), sizes),
scores AS (SELECT i, item_id, d, doc_id, CAST(sum(times * w * v) AS BIGINT) AS score FROM worth JOIN asked USING (t) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""


def _tokens(column: str, mark: str) -> str:
    found = rf"regexp_extract_all(translate({column}, {_SMALL}), '[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+')"
    return f"list_transform({found}, lambda w: '{mark}' || regexp_replace(w, '^[0-9]+$', '#'))"


OP13 = rf"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages
),
hosts AS (SELECT page_id, r, translate(regexp_extract(u, '^[^/?#]*'), {_SMALL}) AS host, substr(u, length(regexp_extract(u, '^[^/?#]*')) + 1) AS tail FROM cut),
paths AS (SELECT page_id, r, host, regexp_extract(tail, '^[^?#]*') AS path, substr(tail, length(regexp_extract(tail, '^[^?#]*')) + 1) AS rest FROM hosts),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_distinct(list_concat({_tokens('host', 'h:')}, {_tokens('path', 'p:')}, {_tokens('rest', 'q:')})) AS ts
  FROM paths
),
judged AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM fits),
labelled AS (SELECT r, ts, said FROM judged WHERE said IS NOT NULL AND len(ts) > 0),
sides AS (SELECT count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b,
  greatest(3, -((-count(*) * 100) // 10000)) AS enough FROM labelled),
each AS (SELECT r, said, unnest(ts) AS t FROM labelled),
known AS (
  SELECT t, count(*) AS n, CASE WHEN any_value(a) = 0 OR any_value(b) = 0 THEN 0
    ELSE abs(count(*) FILTER (WHERE said = 'allow') * any_value(b) - count(*) FILTER (WHERE said = 'block') * any_value(a)) END AS gain
  FROM each, sides GROUP BY t HAVING count(*) >= any_value(enough)
),
best AS (SELECT r, said, list(t ORDER BY gain DESC, t)[1:8] AS ts FROM each JOIN known USING (t) GROUP BY r, said),
masks AS (SELECT said, ts, unnest(range(1, CAST(pow(2, len(ts)) AS BIGINT))) AS m FROM best),
sets AS (SELECT said, list_sort(list_filter(ts, lambda t, i: (m >> (i - 1)) & 1 = 1)) AS items FROM masks),
counted AS (
  SELECT items, array_to_string(items, ' ') AS text, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS na, count(*) FILTER (WHERE said = 'block') AS nb
  FROM sets GROUP BY items
),
sure AS (
  SELECT items, text, v AS verdict, k / n AS confidence, k / total AS support
  FROM (SELECT items, text, CAST(c.n AS DOUBLE) AS n, CAST(s.n AS DOUBLE) AS total, enough, unnest(['allow', 'block']) AS v, unnest([na, nb]) AS k FROM counted c, sides s)
  WHERE k >= enough AND k / n >= 0.8
),
less AS (SELECT text, verdict, confidence, array_to_string(list_filter(items, lambda y: y <> x), ' ') AS part FROM (SELECT *, unnest(items) AS x FROM sure) WHERE len(items) > 1),
idle AS (SELECT DISTINCT l.text, l.verdict FROM less l JOIN sure s ON l.part = s.text AND l.verdict = s.verdict AND s.confidence >= l.confidence),
rules AS (SELECT * FROM sure ANTI JOIN idle USING (text, verdict)),
matched AS (
  SELECT r, max({{'confidence': confidence, 'support': support, 'verdict': verdict, 'text': text}}) AS best
  FROM judged j JOIN rules ON said IS NULL AND list_has_all(j.ts, items) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(said, best.verdict, 'allow') AS verdict, best.text AS matched, best.confidence AS confidence
FROM judged LEFT JOIN matched USING (r)
"""


def _assigned(books: str) -> str:
    """Of each part of each row: its position, its values, its nearest entry and the distance."""
    return f"""
  SELECT vec_id, label, pos, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS near
  FROM parts JOIN {books} USING (pos) GROUP BY r, vec_id, label, pos, v"""


def _moved(assigned: str, books: str) -> str:
    """The entries after an update."""
    means = ", ".join(f"CAST(floor(sum(v[{k}])::DOUBLE / count(*)) AS BIGINT)" for k in range(1, 5))
    return f"SELECT pos, e, coalesce(m, c) AS c FROM {books} LEFT JOIN (SELECT pos, near.e AS e, [{means}] AS m FROM {assigned} GROUP BY ALL) USING (pos, e)"


OP12 = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT r, vec_id, label, p AS pos, v[4 * p + 1 : 4 * p + 4] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
books0 AS MATERIALIZED (SELECT pos, r - 1 AS e, v AS c FROM parts WHERE r <= 64),
near0 AS MATERIALIZED ({_assigned('books0')}),
books1 AS MATERIALIZED ({_moved('near0', 'books0')}),
near1 AS MATERIALIZED ({_assigned('books1')}),
books2 AS MATERIALIZED ({_moved('near1', 'books1')}),
near2 AS MATERIALIZED ({_assigned('books2')}),
codes AS (
  SELECT vec_id, label, string_agg(lpad(lower(hex(near.e)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(near.d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) FROM books2) AS codebooks_sha256
FROM codes
"""

ORACLES = {"op1_substring_dedup": OP1, "op2_host_rules": OP2, "op3_chosen_path": OP3, "op11_ranked_search": OP11, "op12_part_codes": OP12, "op13_url_rules": OP13}
