import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

WORDS = [" ", "\n", "\t", "\r", " ", "\x1c", "\x1f", "\x85", "a", "the", "'s", "'", "ll", "é", "日本", "١", "0", "12", "!", "<|endoftext|>", "ſ", "K", "́", "😀", "_", "  ", "　", "\x00", "ß"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path(bpe.DEFAULT_TOKENIZER))


@pytest.mark.parametrize("merger", ["backtracking", "library"])
def test_ids_equal_the_library(library, merger):
    enc, rng = bpe.encoder(bpe.DEFAULT_TOKENIZER, merger), random.Random(0)
    texts = ["".join(rng.choices(WORDS, k=rng.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(rng.choices("abethinongrsdlé", k=rng.randint(1, 60))) for _ in range(2000)] + ["a" * 3000, "\n" * 500, " " * 501 + "x"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(enc.encode(text), "<u4")
        assert got.tolist() == want, repr(text)
        assert enc.bpe.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_digests_and_edges(spark, library):
    rows = [(1, "The heron\nand the owl", "x"), (1, "The heron\nand the owl", "y"), (2, None, "z"), (3, "", "z"), (None, "word " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digest_round_trip(docs).collect()
    assert len(got) == 5
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert want in [tuple(r) for r in got]
    assert bpe.digest_round_trip(docs.limit(0)).collect() == []


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "é 日本 <|endoftext|> x"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {1: "é 日本 <|endoftext|> x", 2: ""}


def test_a_long_word_takes_linear_time(library):
    bpe_table, rng, seconds = bpe.encoder(bpe.DEFAULT_TOKENIZER).bpe, random.Random(5), []
    for size in (20_000, 500_000, 1_000_000):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
        began = time.process_time()
        ids = bpe_table.encode_piece(word.encode())
        seconds.append(time.process_time() - began)
        if size == 20_000:
            assert ids == library.encode(word, add_special_tokens=False).ids
        assert bpe_table.decode(np.array(ids)).decode() == word
    assert seconds[2] < 20 and seconds[2] < 3 * seconds[1] + 1


@pytest.mark.parametrize("text", [" " * 3000 + "x", " \n" * 2000 + "x", "x" + "\t" * 5000, "ab" * 5000, "=" * 4000, "7" * 4000])
def test_long_runs_by_either_merger(text):
    assert bpe.encoder(bpe.DEFAULT_TOKENIZER, "library").encode(text) == bpe.encoder(bpe.DEFAULT_TOKENIZER).encode(text)
