import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_counts

SCHEMA = "doc_id long, text string, digest string, n_tokens string"


def documents():
    texts = [None, "", " ", "One two  three\n\n", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "é日本́ K" * 30, "word " * 40_000, "\x00\t", "same text"]
    rows = list(enumerate(texts)) + [(k, "same text") for k in range(50, 90)] + [(3, "another text of one number"), (3, "One two  three\n\n"), (None, "nameless"), (None, "nameless"), (None, None), (None, "same text")]
    return [(d, t, "x", None) for d, t in rows]


def wanted(rows, tokenizer=bpe.DEFAULT_TOKENIZER):
    lib = Tokenizer.from_file(bpe.tokenizer_path(tokenizer))
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    return sorted(((d, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for d, t, *_ in rows), key=str)


def counted(docs, cache, **more):
    got = token_counts.count_tokens(docs, cache, **more)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted(map(tuple, got.collect()), key=str)


def test_counts_and_what_is_encoded(spark, tmp_path, monkeypatch):
    rows, cache = documents(), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert counted(docs.limit(0), cache) == []
    assert counted(docs, cache) == wanted(rows)
    folder = f"{cache}/version={token_counts.version_of()}"
    kept = spark.read.parquet(folder)
    assert kept.count() == kept.select("digest").distinct().count() == len({t or "" for _, t, *_ in rows})
    encoded = []
    inner = token_counts._encoded
    monkeypatch.setattr(token_counts, "_encoded", lambda texts, name: encoded.append(texts.count()) or inner(texts, name))
    assert counted(docs, cache) == wanted(rows) and not encoded  # all found
    more = rows + [(900, "a new one", "", ""), (901, "a new one", "", ""), (None, "newer", "", "")]
    assert counted(spark.createDataFrame(more, SCHEMA), cache) == wanted(more) and encoded.pop() == 2
    assert spark.read.parquet(folder).count() == len({t or "" for _, t, *_ in more})
    # What was appended twice counts once, and a count of the cache is what is returned.
    spark.read.parquet(folder).write.mode("append").parquet(folder)
    assert counted(docs, cache) == wanted(rows)


def test_stored_counts_are_used(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    stored = spark.createDataFrame([(1, "kept")], "doc_id long, text string").select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.lit(4321).cast("long").alias("n_tokens"))
    stored.write.parquet(f"{cache}/version={token_counts.version_of()}")
    assert counted(spark.createDataFrame([(1, "kept"), (2, "kept")], "doc_id long, text string"), cache) == [(1, 4, 4321, True), (2, 4, 4321, True)]


def test_versions_are_apart(spark, tmp_path):
    rows, cache = documents()[:7], f"file://{tmp_path}/cache"
    docs = spark.createDataFrame(rows, SCHEMA)
    assert counted(docs, cache) == wanted(rows)
    assert counted(docs, cache, tokenizer="word_bpe_49k.json") == wanted(rows, "word_bpe_49k.json")
    pieces = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    got = {(d, n) for d, _, n, _ in counted(docs, cache, tokenizer="piece_bpe_32k.model")}
    assert got == {(d, len(pieces.encode(t or ""))) for d, t, *_ in rows}
    assert len({token_counts.version_of(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")}) == 3


def test_given_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert counted(docs, f"file://{tmp_path}/cache") == wanted([(r.doc_id, r.text) for r in docs.collect()])
