"""The registered queries against plain loops, the libraries' own results, and SQL."""

import pytest

import __spark_entry__ as entry
from martflow.llm.queries import ORACLES, QUERIES
from tests.compare import database, differences
from tests.llm import brute

KEY = ["doc_id"]
CASES = {
    "op1_substring_dedup": (brute.op1, KEY + ["n_words", "n_removed", "kept_sha256"]),
    "op2_host_rules": (brute.op2_base, KEY + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    "op3_chosen_path": (brute.op3, KEY + ["n_shingles", "component_id", "kept"]),
    "op4_token_counts": (brute.op4, KEY + ["n_bytes", "n_tokens", "over_limit"]),
    "op5_license_scan": (brute.op5_base, KEY + ["n_words", "n_base", "first_word", "last_word", "base_labels"]),
    "op7_merge_replay": (brute.op7, KEY + ["n_tokens", "ids_sha256", "decoded_sha256"]),
    "op8_pii": (brute.op8_base, KEY + ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
    "op10_secret_scan": (brute.op10_base, KEY + ["n_assign", "n_access", "n_hex", "base_sha256"]),
}


def test_the_operators_and_the_pipeline_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(CASES))
def test_against_loops(spark, small, rows_of, same, name):
    loops, columns = CASES[name]
    same(QUERIES[name](spark, small), columns, loops(rows_of("documents", "doc_id", "text")))


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, small, name):
    assert differences(QUERIES[name](spark, small), database(small), name) is None


def test_items_in_documents(spark, small, rows_of):
    items = rows_of("benchmark", "item_id", "text")
    want = {(i, k) for i, t in rows_of("documents", "doc_id", "text") for k in brute.holds_item(t, items)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, small).collect()} == want


def test_main_text_of_pages(spark, small, rows_of, same):
    df = QUERIES["op9_html_extract"](spark, small)
    want = brute.op9(rows_of("pages", "page_id", "html"))
    same(df, ["page_id", "text", "n_chars"], [(i, t, len(t)) for i, t in want])


@pytest.mark.parametrize("name", ["op5_license_scan", "op10_secret_scan"])
def test_no_python_in_native_queries(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
