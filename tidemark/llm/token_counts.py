"""Token counts with a cache of digests.

The cache is a Parquet table of content digests and counts, one folder for each tokenizer version. A
version is the digest of the tokenizer's file, its library and the library's version, so a changed file or
library never meets old counts. A content digest is taken of the text as a tokenizer gets it: null as an
empty text, in UTF-8; nothing else is folded, as the counts must be those of the text itself.

Documents are joined to the cache by digest. Only texts that it lacks reach Python, each distinct one
once, and their counts are appended before the result is read from the cache. A run that fails leaves
what it has appended, and the next one goes on from there; digests appended twice count once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import checkpointed, join_hot, keep_rows, map_batches, text_or_empty

CACHED = "digest binary, n_tokens long"


def version_of(tokenizer: str = bpe.DEFAULT_TOKENIZER) -> str:
    """Digest of a tokenizer's file, its library and the library's version."""
    if tokenizer.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    found = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    found.update(Path(bpe.tokenizer_path(tokenizer)).read_bytes())
    return found.hexdigest()


@lru_cache(maxsize=2)
def counter(tokenizer: str) -> Callable[[str], int]:
    """The number of tokens of a text: the library's ids without begin, end or added special tokens.

    Byte-level merges go by the encoder of ``bpe``, whose ids are those of the library; special strings
    inside a text are special tokens there as well.
    """
    path = bpe.tokenizer_path(tokenizer)
    if tokenizer.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, add_bos=False, add_eos=False))
    said = json.loads(Path(path).read_text())
    if said["model"].get("type") == "BPE" and said["normalizer"] is None and (said["pre_tokenizer"] or {}).get("type") == "ByteLevel":
        encoder = bpe.encoder(tokenizer, "library")
        return lambda text: len(encoder.encode(text)) // 4
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda text: len(whole.encode(text, add_special_tokens=False))


def stored(spark, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version; a cache without it is begun."""
    folder = f"{cache}/version={version}"
    spark.createDataFrame([], CACHED).write.mode("ignore").parquet(folder)
    return spark.read.schema(CACHED).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` of the distinct texts of ``digest, text``."""

    def run(digests, texts, tokenizer):
        count, known = counter(tokenizer), {}
        for digest, text in zip(digests, texts):
            if digest not in known:
                known[digest] = count(text)
        return {"digest": list(known), "n_tokens": list(known.values())}

    return map_batches(texts.select("digest", "text"), run, "digest binary,n_tokens long", tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, limit: int = 1024, tokenizer: str = bpe.DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per row of ``docs``; ``cache`` is a folder that all machines share.

    A null text counts as empty, with no bytes and no tokens. Rows repeat as they do in ``docs``; texts
    are whole, however long; a null doc_id is kept; other columns are not read; an empty table gives no
    rows and appends nothing.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = checkpointed(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest))
    keys = checkpointed(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")))
    missing = checkpointed(keys.join(stored(spark, cache, version), "digest", "left_anti"))
    if not missing.isEmpty():
        # One row for each missing digest is found by its doc_id, so that texts stay where they are.
        texts = docs.select("doc_id", digest, text_or_empty())
        named = keep_rows(texts.where("doc_id IS NOT NULL"), missing.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi").select("digest", "text")
        nameless = texts.where("doc_id IS NULL").groupBy("digest").agg(F.first("text").alias("text")).join(missing.where("doc_id IS NULL").select("digest"), "digest", "left_semi")
        fresh = _encoded(named.unionByName(nameless), tokenizer).join(missing.select("digest"), "digest", "left_semi")
        fresh.write.mode("append").parquet(f"{cache}/version={version}")
    counted = checkpointed(keys.select("digest", "n").join(stored(spark, cache, version), "digest"))
    return join_hot(rows, counted, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
