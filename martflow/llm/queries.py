"""The registered queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.chosen_path import near_duplicates
from martflow.llm.common import folder, table
from martflow.llm.decontaminate import find_contaminated
from martflow.llm.host_rules import judge
from martflow.llm.html_extract import extract
from martflow.llm.license_scan import scan_licenses
from martflow.llm.merge_replay import round_trip
from martflow.llm.oracles import ORACLES
from martflow.llm.part_codes import compress
from martflow.llm.pii import KINDS as PERSONAL
from martflow.llm.pii import find_personal_data
from martflow.llm.ranked_search import rank_documents
from martflow.llm.secret_scan import KINDS, find_secrets, span_list
from martflow.llm.substring_dedup import remove_repeats
from martflow.llm.token_counts import count_tokens
from martflow.llm.url_rules import judge_urls


def op1_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = remove_repeats(table(spark, root, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op2_host_rules(spark: SparkSession, root: str) -> DataFrame:
    found = judge(table(spark, root, "documents"))
    return found.select(
        "doc.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        F.col("hard").alias("base_failed"), "kept", F.col("soft").alias("n_soft_failed"), F.col("verdict").alias("host_verdict"),
    )


def op3_chosen_path(spark: SparkSession, root: str) -> DataFrame:
    found = near_duplicates(table(spark, root, "documents"), size=2)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op4_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """With a cache of its own that begins empty, so every call encodes every distinct text."""
    found = count_tokens(table(spark, root, "documents"), folder(spark, "token-cache"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan_licenses(table(spark, root, "documents")).drop("spans")


def op6_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    found = find_contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "score", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"))


def op7_merge_replay(spark: SparkSession, root: str) -> DataFrame:
    found = round_trip(table(spark, root, "documents"))
    line = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(line, "utf-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_pii(spark: SparkSession, root: str) -> DataFrame:
    found, names = find_personal_data(table(spark, root, "documents")), F.array(*map(F.lit, PERSONAL))

    def line(spans):
        parts = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
        return F.concat_ws(",", parts)

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{PERSONAL[k]}") for k in range(4)],
        F.sha2(F.encode(line(F.filter("spans", lambda x: x["base"])), "utf-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


def op9_html_extract(spark: SparkSession, root: str) -> DataFrame:
    return extract(table(spark, root, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    found, base = find_secrets(table(spark, root, "documents")), [kind for kind, *_ in KINDS]
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(F.encode(span_list(base), "utf-8"), 256).alias("base_sha256"), span_list([*base, "entropy"]).alias("spans"),
    )


def op11_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return rank_documents(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op12_part_codes(spark: SparkSession, root: str) -> DataFrame:
    found = compress(table(spark, root, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_url_rules(spark: SparkSession, root: str) -> DataFrame:
    return judge_urls(table(spark, root, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_host_rules, op3_chosen_path, op4_token_counts, op5_license_scan, op6_decontaminate, op7_merge_replay, op8_pii, op9_html_extract, op10_secret_scan, op11_ranked_search, op12_part_codes, op13_url_rules)
}
__all__ = ["ORACLES", "QUERIES"]
