"""License texts and phrases in documents, by voting of word k-grams on diagonals. Built-in expressions only.

1. A document's words become rolling hashes of k consecutive words. Those that occur in a template are
   joined to the template's positions, and a hit stands only if its words are the template's words.
2. Hits of one template are summed by diagonal (word in the document less word in the template): a copy of
   the template puts all its hits on one diagonal, in however many pieces.
3. Neighbouring diagonals whose hits follow each other are merged: inserted and lost words shift a copy.
4. A span is verified by the share of the template's positions that it holds.

Phrases are templates that must be whole on one diagonal. The template table is fixed and small (a few
hundred rows), so its join is a broadcast of known size; before it, the same fixed set of hashes thins the
document's grams. A hot document's hits are summed before the shuffle; texts are never shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martflow.llm.common import stored

#: What separates words: ASCII signs other than letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Label of each phrase. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and opening words of licence texts and notices. Fixed values, from the licences.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution"),
]
PHRASE_GRAM, TEXT_GRAM = 2, 4
#: Diagonals, and words between hits, that one copy may span; share of a text's grams that make a label.
SHIFT, GAP, SHARE = 8, 24, 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


def templates(spark) -> DataFrame:
    """`template`, `label`, `phrase` (whole or nothing), `place`, `grams` (of the template), `gram`."""
    rows = []
    for k, (label, text, phrase) in enumerate([(x, t, True) for t, x in PHRASES.items()] + [(x, t, False) for x, t in TEXTS]):
        words, size = _split(text), PHRASE_GRAM if phrase else TEXT_GRAM
        grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        rows += [(k, label, phrase, i, len(grams), size, gram) for i, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, place int, grams int, size int, gram string")


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _hits(words: str, low: str, size: int, wanted: list[int]) -> Column:
    """Places where a k-gram's hash is one of the templates', with the gram's own words in lower case."""
    n = F.size(low) - size
    places = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: _hash([F.get(low, i + k) for k in range(size)]).isin(wanted))
    gram = lambda i: F.translate(F.concat_ws(" ", F.slice(words, i + 1, size)), _UPPER, _LOWER)
    return F.transform(found, lambda i: F.struct(i.alias("place"), F.lit(size).alias("size"), gram(i).alias("gram")))


def _grams(docs: DataFrame, id: str, text: str, known: DataFrame) -> DataFrame:
    """A row per input row: `row` (its number), `id`, `n_words`, `hits`; written, as it is read twice."""
    # The templates' own hashes: a fixed number of values, whatever the input.
    split = F.split("gram", " ")
    wanted = {
        size: [r[0] for r in known.filter(F.col("size") == size).select(_hash([F.get(split, F.lit(k)) for k in range(size)])).distinct().collect()]
        for size in (PHRASE_GRAM, TEXT_GRAM)
    }
    content = F.coalesce(F.col(text), F.lit(""))
    words = lambda x: F.filter(F.split(x, SEPARATOR), lambda w: w != "")
    rows = docs.select(F.col(id).alias("id"), words(content).alias("words"))
    rows = rows.withColumn("low", F.transform("words", F.lower))
    hits = F.concat(*[_hits("words", "low", size, values) for size, values in wanted.items()])
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "license-hits")


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """`id`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`, a row per input row.

    `spans` holds the verified spans (label, phrase, first word, end, share), by first word. A null or empty
    text has no words, no spans, empty labels and score 0. Only the two named columns are looked at; repeated
    rows are scanned each for itself. No rows give no rows.
    """
    known = templates(docs.sparkSession)
    rows = _grams(docs, id, text, known)
    hits = rows.select("row", F.inline("hits"))
    votes = hits.withColumn("h", F.xxhash64("gram")).join(
        known.select("template", "label", "phrase", F.col("place").alias("at"), "grams", F.col("size").alias("k"), F.xxhash64("gram").alias("h"), F.col("gram").alias("words")), "h"
    ).filter("gram = words")
    diagonal = ["row", "template", "label", "phrase", "grams", "k", (F.col("place") - F.col("at")).alias("diagonal")]
    lines = votes.groupBy(*diagonal).agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("at"))
    whole = lines.filter("phrase AND votes = grams")
    copy = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    new = (F.col("first") > F.lag("last").over(copy) + GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(copy)) > SHIFT)
    merged = lines.filter("NOT phrase").withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    merged = merged.withColumn("run", F.sum("new").over(copy.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("row", "template", "label", "phrase", "grams", "k", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.flatten(F.collect_list("at")).alias("at")
    )
    part = F.size(F.array_distinct("at")) / F.col("grams")
    spans = whole.select("row", "label", "phrase", "first", (F.col("last") + F.col("k")).alias("end"), F.lit(1.0).alias("part")).unionByName(
        merged.select("row", "label", "phrase", "first", (F.col("last") + F.col("k")).alias("end"), part.alias("part")).filter(F.col("part") >= share)
    )
    base = F.when(F.col("phrase"), F.col("first")).cast("long")
    found = spans.groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"), F.sort_array(F.collect_set("label")).alias("all"),
        F.max("part").alias("score"), F.sort_array(F.collect_list(F.struct("first", "end", "label", "phrase", "part"))).alias("spans"),
    )
    return rows.drop("hits").join(found, "row", "left").select(
        F.col("id").alias(id), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", "all").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
