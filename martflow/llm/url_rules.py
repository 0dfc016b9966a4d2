"""Verdicts on urls: a list of hosts and paths, and association rules mined from what the list decides.

1. A url becomes host, path and distinct tokens: words of the host (`h:`), of the path (`p:`) and of what
   follows (`q:`), ASCII letters in lower case, numbers as `#`.
2. Labelled urls are those that the list (or the caller) decides. Tokens are counted by label; a labelled url
   keeps all its frequent tokens, so no combination that reaches the support is left out. The work grows with the number
   of such combinations; a caller may bound it by `width`, the frequent tokens of a url that part the labels best.
3. Spark's FP-growth mines the combinations of these with the labels. Rules "tokens -> label" stand from the
   least support and confidence on, unless a rule of one token less is as sure.
4. Each rule is indexed under its rarest token. The tokens of the other urls meet that index, rules whose
   tokens the url holds match, and the surest decides (then support, then `block`, then the rule's text).
   No match: allow.

Built-in expressions and Spark's FP-growth only. Whole urls are read. Token and rule tables are bounded by the
support (a token of 1 % of the labelled urls: at most a hundred times the mean number of tokens of a url); they
are written, so Spark knows their size when it chooses the join, and splits hot tokens where it shuffles.
Matches of a url are summed in the map task before they are shuffled, by row and not by host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import stored

#: Host, path, verdict. Fixed values.
LIST = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Share and number of labelled urls that a combination must have; confidence of a rule; tokens of a url that are combined (all).
SUPPORT, LEAST, CONFIDENCE, WIDTH = 0.01, 3, 0.8, None
#: A token: ASCII letters, digits and underscores, and all signs beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="


def parts(url: Column) -> dict[str, Column]:
    """`host`, `path` and `rest` of a url; all empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    tail = F.substr(after, F.char_length(host) + F.lit(1))
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    return {"host": F.translate(host, _UPPER, _LOWER), "path": path, "rest": F.substr(tail, F.char_length(path) + F.lit(1))}


def tokens(host: str = "host", path: str = "path", rest: str = "rest") -> Column:
    """The distinct tokens of a url's parts."""

    def words(column: str, mark: str) -> Column:
        found = F.regexp_extract_all(F.translate(column, _UPPER, _LOWER), F.lit(TOKEN), F.lit(0))
        return F.transform(found, lambda w: F.concat(F.lit(mark), F.regexp_replace(w, "^[0-9]+$", "#")))

    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), words(rest, "q:")))


def listed(rules: Sequence[tuple[str, str, str]] = LIST) -> tuple[Column, Column]:
    """The longest fitting entry of the list for columns `host` and `path`, and its verdict; null where none fits.

    The list is the caller's, part of the plan; it is meant for tens of entries.
    """
    entry, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        entry, verdict = F.when(fits, host + path).otherwise(entry), F.when(fits, says).otherwise(verdict)
    return entry, verdict


def mine_rules(
    labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, width: int | None = WIDTH
) -> DataFrame:
    """`anchor`, `items`, `text`, `verdict`, `confidence`, `support` of the rules of rows with `row`, `tokens`, `verdict`.

    Rows without tokens or verdict count for nothing; without labelled rows there are no rules.
    """
    labelled = labelled.filter("verdict IS NOT NULL AND size(tokens) > 0")
    sides = {r.verdict: r.n for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # block and allow
    n = sum(sides.values())
    enough = max(least, -(-n * round(support * 10_000) // 10_000))
    each = labelled.select("row", "verdict", F.explode("tokens").alias("token"))
    counts = [F.count_if(F.col("verdict") == v) * F.lit(n - k) for v, k in sorted(sides.items())] or [F.lit(0)]
    gain = counts[0] - (counts[1] if len(counts) > 1 else F.lit(0))
    known = stored(each.groupBy("token").agg(F.count("*").alias("n"), F.abs(gain).alias("gain")).filter(F.col("n") >= enough), "url-tokens")
    best = F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("gain"), "token")))
    chosen = best if width is None else F.slice(best, 1, width)
    rows = each.join(known.select("token", "gain"), "token").groupBy("row", "verdict").agg(chosen["token"].alias("items"))
    # A url all of whose tokens are rare still counts for the number of urls, by its label.
    rows = labelled.select("row", "verdict").join(rows.drop("verdict"), "row", "left")
    rows = rows.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    # Half a url less than the least count, so that no rounding of the share moves it.
    model = FPGrowth(minSupport=(enough - 0.5) / max(n, enough), minConfidence=confidence).fit(rows)
    says = F.get("consequent", F.lit(0))
    rules = model.associationRules.filter(F.startswith(says, F.lit(_LABEL))).select(
        F.array_sort("antecedent").alias("items"), F.substr(says, F.lit(len(_LABEL) + 1)).alias("verdict"), "confidence", "support"
    )
    rules = stored(rules.withColumn("text", F.array_join("items", " ")), "url-rules")
    smaller = rules.filter("size(items) > 1").select("text", "verdict", "confidence", F.explode("items").alias("less"), "items")
    smaller = smaller.withColumn("less", F.array_join(F.array_remove("items", F.col("less")), " "))
    sure = rules.select(F.col("text").alias("less"), "verdict", F.col("confidence").alias("sure"))
    idle = smaller.join(sure, ["less", "verdict"]).filter("sure >= confidence").select("text", "verdict").distinct()
    rules = rules.join(idle, ["text", "verdict"], "left_anti")
    rare = rules.select("text", "verdict", F.explode("items").alias("token")).join(known.select("token", "n"), "token")
    rare = rare.groupBy("text", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    return stored(rules.join(rare, ["text", "verdict"]), "url-index")


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """`row` and its surest rule (`confidence`, `support`, `verdict`, `text`), for rows that some rule matches."""
    found = rows.select("row", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    found = found.filter(F.forall("items", lambda x: F.array_contains("tokens", x)))
    return found.groupBy("row").agg(F.max(F.struct("confidence", "support", "verdict", "text")).alias("best")).select("row", "best.*")


def judge_urls(
    pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = LIST, confidence: float = CONFIDENCE
) -> DataFrame:
    """`id`, `host`, `path`, `rule`, `verdict`, `matched`, `confidence`, a row per input row.

    `rule` is the entry of the list that fits, else null; then `matched` is the mined rule that decides (null if
    none does) and `confidence` its share of right labels. A null or empty url, or one without `://`, has empty
    parts, fits nothing and is allowed. Only the two named columns are looked at, so others may have any name; repeated
    rows, and rows with a null id, are judged each for itself. No rows give no rows; where the list decides no
    row, no rule is mined. Very long urls are read whole, and matched with all their tokens.
    """
    entry, says = listed(rules)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).alias("url"))
    rows = rows.withColumns(parts(F.col("url"))).withColumns({"rule": entry, "verdict": says, "tokens": tokens()})
    rows = stored(rows.select("row", "id", "host", "path", "rule", "verdict", "tokens"), "urls")
    best = match(rows.filter("verdict IS NULL").select("row", "tokens"), mine_rules(rows.select("row", "tokens", "verdict"), confidence=confidence))
    best = best.select("row", F.col("verdict").alias("mined"), F.col("text").alias("matched"), "confidence")
    return rows.join(best, "row", "left").select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"), "matched", "confidence"
    )
