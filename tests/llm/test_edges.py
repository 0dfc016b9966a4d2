"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns whose names clash."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from martflow.llm import chosen_path, decontaminate, host_rules, html_extract, license_scan, merge_replay, pii, secret_scan, substring_dedup, token_counts
from martflow.llm.common import folder
from martflow.llm.queries import QUERIES
from tests.llm import brute

_random = random.Random(5)
LONG = " ".join(_random.choice(["alpha", "beta", "gamma", "delta", "é", "x1"]) for _ in range(40_000))
PLAIN = " ".join(f"word{k}" for k in range(120))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t \x0b"), (4, "single"), (5, "SINGLE"), (6, PLAIN), (7, PLAIN), (7, PLAIN), (8, PLAIN + " more"),
    (9, LONG), (10, "x" * 100_000), (11, "same word " * 300), (12, "a\nb c d\nb c d\n\nb c d e"), (None, PLAIN), (None, "of no id"),
    (13, "é ß 日本語 \U0001f600 \x00 end line  two   three\r\n"), (14, "key password='hunter2222' AKIA" + "Q7" * 10 + " " + "0af9" * 8),
    (15, "mail a.b+c@x-y.example.com, 10.0.0.255 256.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999 " + "9" * 60_000),
    (16, "Released under the MIT License and the Apache License; the general PUBLIC license. Mit license"), (17, "<|endoftext|> a <|endoftext|>"),
]
CLASH = ["id", "key", "n_words", "kept", "doc", "m", "row", "ids", "spans", "digest", "component", "piece", "host", "score", "Item", "text_a"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") > 5, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    return df.select("*", *[F.lit(name).alias(name) for name in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_repeats(docs, none, same):
    found = substring_dedup.remove_repeats(docs).withColumn("sha", F.sha2(F.encode("kept", "utf-8"), 256))
    same(found, ["doc_id", "n_words", "n_removed", "sha"], brute.op1(TEXTS))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeats_with_many_small_blocks(docs, same):
    """A sketch far too narrow raises false alarms only."""
    found = substring_dedup.remove_repeats(docs, size=3, piece_bytes=1000, block_windows=64, cells_per_window=0)
    same(found.withColumn("sha", F.sha2(F.encode("kept", "utf-8"), 256)), ["doc_id", "n_words", "n_removed", "sha"], brute.op1(TEXTS, 3))


def test_hosts(docs, none, same):
    found = host_rules.judge(docs)
    columns = ["doc.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "hard"]
    same(found, columns, brute.op2_base(TEXTS))
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and host_rules.keep_good(none).count() == 0
    assert {r.doc_id for r in kept.collect()} <= {6, 7, 8, 9, None}


def test_near_duplicates(docs, none, same):
    found = chosen_path.near_duplicates(docs, size=2).withColumn("own", F.col("doc_id").eqNullSafe(F.col("component")))
    same(found, ["doc_id", "n_shingles", "component", "own"], brute.op3(TEXTS))
    assert chosen_path.near_duplicates(none).count() == 0
    left = chosen_path.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    want = brute.op3(TEXTS, 5)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _, _, kept in want if kept)


def test_token_counts(docs, none, spark, same):
    where = folder(spark, "cache")
    same(token_counts.count_tokens(docs, where), ["doc_id", "n_bytes", "n_tokens"], [r[:3] for r in brute.op4(TEXTS)])
    assert token_counts.count_tokens(none, folder(spark, "cache")).count() == 0


def test_licenses(docs, none, same):
    same(license_scan.scan_licenses(docs), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], brute.op5_base(TEXTS))
    assert license_scan.scan_licenses(none).count() == 0


def test_contamination(docs, none, spark):
    items = spark.createDataFrame([(1, PLAIN), (1, PLAIN), (2, None), (3, ""), (None, "of no id"), (4, "is not there at all. Not here")], "item_id long, text string")
    found = decontaminate.find_contaminated(docs, items)
    assert sorted(str(r.doc_id) for r in found.collect() if r.item == 1) == sorted(["6", "7", "7", "8", "None"])
    assert [r.doc_id for r in found.collect() if r.item is None] == [None] and {r.item for r in found.collect()} == {1, None}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 6
    assert decontaminate.find_contaminated(none, items).count() == 0
    assert decontaminate.find_contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(TEXTS)


def test_encoding(docs, none, same):
    found = merge_replay.decode(merge_replay.encode(docs))
    line = F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "utf-8"), 256)
    found = found.select("doc_id", F.size("ids").alias("n"), line.alias("sha"), F.sha2("decoded", 256).alias("back"))
    same(found, ["doc_id", "n", "sha", "back"], brute.op7(TEXTS))
    assert merge_replay.decode(merge_replay.encode(none)).count() == 0
    assert merge_replay.decode(merge_replay.encode(docs).withColumn("ids", F.lit(None).cast("array<int>"))).filter("length(decoded) > 0").count() == 0


def test_personal_data(spark, docs, none, same, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op8_pii"](spark, str(tmp_path)), ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], brute.op8_base(TEXTS))
    assert pii.find_personal_data(none).count() == 0
    hidden = pii.redact(docs)
    assert hidden.columns == docs.columns and hidden.filter("text IS NULL").count() == 1
    assert not hidden.filter("text LIKE '%example.com%' OR text LIKE '%4111 1111%'").count()


def test_secrets(spark, docs, none, same, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op10_secret_scan"](spark, str(tmp_path)), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], brute.op10_base(TEXTS))
    assert secret_scan.find_secrets(none).count() == 0


def test_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "plain words"), (5, "u", "<p>" * 3000 + "deep"), (5, "u", "<article><p>a&amp;b</article>"), (None, "u", "<!-- open")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("features"))
    found = html_extract.extract(df)
    assert found.columns == ["page_id", "url", "features", "text"] and found.count() == len(pages)
    assert found.filter("text IS NULL").count() == 0
    assert html_extract.extract(df.limit(0)).count() == 0


def test_secrets_in_a_very_long_text(spark):
    rng = random.Random(3)
    signs = secret_scan.ALPHABET
    parts = ["token: abc123 ", "word ", "AKIA" + "A1B2" * 5 + " ", "0af9" * 8 + " "]
    text = "".join(rng.choice([*parts, "".join(rng.choice(signs) for _ in range(30)) + " "]) for _ in range(100_000))
    begin = time.monotonic()
    found = secret_scan.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.monotonic() - begin < 90
    for kind, pattern, group, least in secret_scan.KINDS:
        want = [m.span() for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
        assert [(s.start, s.end) for s in found[kind]] == want
    assert found["entropy"] and all(text[s.start : s.end] == s.word for s in found["entropy"])


def test_one_document_of_a_group_stays(spark):
    """Also of rows that share the least id, and of a group without ids; other columns do not part rows."""
    rows = [(1, PLAIN, "a"), (1, PLAIN, "b"), (1, PLAIN + " more", "c"), (2, PLAIN, "d"), (None, LONG, "e"), (None, LONG, "f"), (3, "", "g"), (3, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group string")
    left = chosen_path.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "3", "None"]


def test_cached_texts_are_not_moved(docs, none, spark, same, monkeypatch):
    where = folder(spark, "cache")
    want = sorted(map(str, token_counts.count_tokens(docs, where).collect()))
    monkeypatch.setattr(token_counts, "named", None)  # no text is looked for again
    assert sorted(map(str, token_counts.count_tokens(docs, where).collect())) == want
