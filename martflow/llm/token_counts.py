"""Token counts with a cache: contents counted before, by digest and tokenizer version, are not encoded again.

1. Every text gets the digest of its content and of the tokenizer's files and settings. The content is
   normalised to the form that the count depends on: null becomes the empty text; nothing else is
   changed, as every other change could change the count.
2. Digests are made distinct, without their texts, and those that the cache has are ruled out.
3. Texts of the others are found by a summary of fixed size, made distinct before the shuffle and in it, so
   copies of one text are one row of a task, encoded and appended to the cache; a repeated append is harmless,
   as reading takes one count for each digest. Texts that the cache knows are not shuffled.
4. Documents get their counts by a join on the digest, without their texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.common import batch_slices, named, stored, summary
from martflow.llm.pretokens import pretokens

TOKENIZER = "byte_bpe_50k.json"
KEPT_WORDS = 300_000
_CACHE = "digest binary, n_tokens long"


def version(path: str) -> str:
    """The digest of a tokenizer: its file and what this module does with it."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"|{os.path.splitext(path)[1]}|no added special tokens".encode()).hexdigest()


def _by_words(path: str) -> list[str] | None:
    """The special strings of a byte-level tokenizer whose count is the sum of its words' counts, else None."""
    with open(path) as file:
        own = json.load(file)
    split, added = own.get("pre_tokenizer") or {}, own.get("added_tokens") or []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or own.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        return None
    return sorted((t["content"] for t in added), key=len, reverse=True)


@cache
def _counter(path: str):
    """A function from texts to the library's token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    count = lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    special = _by_words(path)
    if special is None:
        return count
    cut = re.compile("|".join(map(re.escape, special))) if special else None
    kept: dict[str, int] = {}

    def run(texts: list[str]) -> list[int]:
        """The words of a byte-level vocabulary are encoded apart from each other: a word is encoded once."""
        parts = [cut.split(t) for t in texts] if cut else [[t] for t in texts]
        words, at = pretokens([p for own in parts for p in own])
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = list(set(words) - kept.keys())
        kept.update(zip(new, count(new)))
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(kept.__getitem__, words), np.int64, len(words)))])
        ends = np.cumsum([len(own) for own in parts]) if parts else np.zeros(0, int)
        upto = np.concatenate([[0], total[at[ends]]])
        return (np.diff(upto) + [len(own) - 1 for own in parts]).tolist()

    return run


def _count(path: str):
    def run(batches):
        counter = _counter(path)
        for batch in batches:
            for part in batch_slices(batch, "text", 2 << 20):
                n = counter(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["digest"], pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, where: str) -> DataFrame:
    """`digest`, `n_tokens`, a row for each time a digest was counted; empty where nothing has been written yet."""
    try:
        return spark.read.schema(_CACHE).parquet(where)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _CACHE)


def count_tokens(docs: DataFrame, cache_path: str, path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `n_bytes` and `n_tokens`, a row per input row. Encodes what the cache lacks when called.

    Null and empty texts have no bytes and no tokens. Special strings in a text are handled as the library
    does by default. `path` names the tokenizer (.json or .model), which every executor can read. Only the
    two named columns are looked at. Texts of any length are encoded whole, repeated rows stay, no rows give no rows.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.lit(version(path) + "|"), content), "utf-8"), 256))
    rows = docs.select(F.col(id).alias("id"), content.alias("text"), digest.alias("digest"))
    # Tables without texts are written, so that texts are digested once for them and a hot digest can be split.
    slim = stored(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    digests = slim.select("digest").distinct()
    misses = stored(digests.join(read_cache(spark, cache_path), "digest", "left_anti"), "misses")
    if not misses.isEmpty():
        texts = rows.filter(named(summary(misses, "digest"), "digest")).groupBy("digest").agg(F.any_value("text").alias("text"))
        texts.join(misses, "digest", "left_semi").mapInArrow(_count(path), _CACHE).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return slim.join(stored(counts, "token-counts"), "digest").select(F.col("id").alias(id), "n_bytes", "n_tokens")
