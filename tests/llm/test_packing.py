import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_uses_every_piece_once(lengths):
    patterns = packing.plan(Counter(lengths), 40)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 40
        used.update({x: n * times for x, n in Counter(pattern).items()})
    assert used == Counter(lengths)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=21, max_size=21), st.integers(1, 20))
def test_exact_sums_against_all_combinations(counts, gap):
    have = [n for n in range(1, 21) for _ in range(counts[n])]
    from itertools import combinations

    possible = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(have, k))
    counts[0] = 0
    found = packing.Sums(np.array(counts)).exact(gap)
    assert bool(found) == possible
    if found:
        assert sum(found) == gap and all(Counter(found)[x] <= counts[x] for x in found)


def check(spark, docs, texts, capacity):
    got = packing.pack_documents(docs, capacity).toPandas()
    lib = Tokenizer.from_file(bpe.tokenizer_path(bpe.DEFAULT_TOKENIZER))
    want = Counter()
    for doc_id, text in texts:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == doc_id].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids) and (own.start.to_numpy() == own.length.cumsum().to_numpy() - own.length.to_numpy()).all()
        assert (own.length.iloc[1:] == capacity).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        want[doc_id] += len(own)
    assert Counter(got.doc_id) == want
    seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (seq.cumsum() - ordered.length == ordered.offset).all() and seq.sum().max() <= capacity
    return got


def test_every_piece_has_one_place(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(spark, docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 1024)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.02 + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "heron " * 900), (4, "owl"), (4, "owl"), (5, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS sequence_id")
    check(spark, docs, rows, 16)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_hot_length_full_pieces_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 3)
    rows = [(7, "a b c")] * 40 + [(8, "heron " * 15)] * 9 + [(9, "heron " * 40)] + [(10, "x y z w")] * 13
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string").repartition(5)
    got = check(spark, docs, list(enumerate(t for _, t in rows)), 16)
    assert got.sequence_id.nunique() == -(-got.length.sum() // 16)
    full = got[got.length == 16]
    assert len(full) >= 9 and not got.merge(full[["sequence_id"]]).duplicated("sequence_id").any()


def test_large_ids_beside_a_null_one(spark):
    ids = [2**53 + 1, None, 2**62 + 1]
    docs = spark.createDataFrame([(d, "a few words") for d in ids], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack_documents(docs, 16).collect()} == set(ids)
