"""Word splitting with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def word_set(text: Column) -> Column:
    """Distinct lower-case words of a whole text."""
    return F.array_distinct(
        F.filter(F.split(F.lower(text), NOT_A_WORD), lambda w: w != "")
    )


def words(df: DataFrame, text: str, out: str = "word") -> DataFrame:
    """One row per distinct word of each row; rows without words vanish."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(word_set(F.col(text))).alias(out))


#: Letters by which a word of a lexicon is looked up.
ANCHOR = 3


def lexicon_words(df: DataFrame, text: str, lexicon: DataFrame, out: str = "word") -> DataFrame:
    """Words of a lexicon (column `word`) found inside the words of each row, once per row.

    For scripts without spaces. A run of letters is searched once, in however many rows it is: its short
    pieces meet the words that begin with them, the whole word is then looked for in the run, and what is found is
    joined back to the rows. The pieces are as many as the run has letters, three times at most, however long
    the lexicon's words are. Rows must be distinguishable by their other columns.
    """
    run, word = F.col("_run"), F.col(out)

    def pieces(size: int) -> Column:
        last = F.length(run) - size + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(run, i, F.lit(size)))

    runs = words(df, text, "_run")
    known = lexicon.select(F.col("word").alias(out)).where(F.length(out) > 0).distinct()
    known = known.withColumn("_anchor", F.substr(word, F.lit(1), F.lit(ANCHOR)))
    # A word shorter than an anchor is its own.
    anchors = F.array_distinct(F.concat(*[pieces(k) for k in range(1, ANCHOR + 1)]))
    found = runs.select("_run").distinct().select("_run", F.explode(anchors).alias("_anchor")).join(known, "_anchor")
    return runs.join(found.where(F.contains(run, word)).select("_run", out), "_run").drop("_run").distinct()
