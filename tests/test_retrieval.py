import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import retrieval as rt


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(1, "alpha beta gamma", "alpha beta gamma menu bar"), (2, "beta alpha", "beta alpha"), (3, "gamma rays only", "gamma rays only"), (4, "", "menu bar")]
    frames = [(k, 100 * k, f"frames/{k}.jpg", None) for k in range(1, 5)]
    unit = lambda d: [1.0 if k == d else 0.0 for k in range(8)]
    vectors = [(1, 0, unit(0)), (1, 1, unit(2)), (2, 0, unit(1)), (3, 0, unit(0))]
    return rt.Corpus(spark.createDataFrame(frames, "frame_id long, captured_at long, image_path string, app_hint string"), spark.createDataFrame(texts, "frame_id long, content_text string, raw_text string"), spark.createDataFrame(vectors, "frame_id long, chunk_index int, embedding array<float>"))


def unit(d):
    return [1.0 if k == d else 0.0 for k in range(8)]


def arm(corpus, text, column="content_text", **window):
    return [r.frame_id for r in rt.text_arm(rt.build_index(corpus.texts, column), corpus.frames, text, 50, **window).orderBy("rank").collect()]


def test_terms_are_joined_by_and_and_phrases_are_adjacent(corpus):
    assert set(arm(corpus, "alpha beta")) == {1, 2} and arm(corpus, "alpha-beta") == [1] and arm(corpus, "beta-alpha") == [2]
    assert arm(corpus, "alpha !!") == arm(corpus, "alpha") and arm(corpus, "!!") == arm(corpus, " ") == [] and arm(corpus, "ALPHÁ gamma") == [1]
    assert arm(corpus, "alpha", start=150, end=250) == [2]


def test_raw_layer_only_if_asked(corpus):
    assert arm(corpus, "menu") == [] and set(arm(corpus, "menu", "raw_text")) == {1, 4}
    assert rt.hybrid_search(corpus, "menu").count() == 0
    hits = {r.frame_id: r.snippet for r in rt.hybrid_search(corpus, "menu", include_chrome=True).collect()}
    assert hits[4] == "[menu] bar" and "[menu]" in hits[1]


def test_nearest_vectors(corpus):
    near = lambda q, **o: [r.frame_id for r in rt.knn(corpus.vectors, corpus.frames, q, 50, **o).orderBy("rank").collect()]
    assert near(unit(0)) == [1, 3, 2] and near(unit(1))[0] == 2
    first = rt.knn_chunks(corpus.vectors, unit(0), 1).first()
    assert (first.frame_id, first.distance) == (1, 0.0)
    narrow = lambda pre: [r.frame_id for r in rt.knn(corpus.vectors, corpus.frames, unit(0), 1, 150, 350, pre).collect()]
    assert narrow(False) == [] and narrow(True) == [3]
    with pytest.raises(Exception, match="dimensions"):
        rt.knn_chunks(corpus.vectors, [1.0, 0.0], 1).collect()


def test_batch_of_queries(spark, corpus):
    queries = spark.createDataFrame([(10, unit(0)), (11, unit(1))], "query_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.frame_id for r in rt.knn_batch(corpus.vectors, queries, 2).collect()}
    assert got == {(10, 1): 1, (10, 2): 3, (11, 1): 2, (11, 2): 1}


def test_hybrid_puts_what_both_arms_found_first(corpus):
    hits = rt.hybrid_search(corpus, "alpha", 10, unit(1)).collect()
    assert hits[0].frame_id == 2 and [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert rt.hybrid_search(corpus, "  ", 10, unit(1)).count() == 0 and rt.hybrid_search(corpus, "alpha", 0).count() == 1
    context = rt.rag_context(corpus, "alpha", 8, unit(1), drop_blank=True).collect()
    assert context[0].text == "beta alpha"


def test_fusion_ties_go_to_the_larger_id(spark):
    arms = [spark.createDataFrame([(1, 1)], "frame_id long, rank int"), spark.createDataFrame([(2, 1)], "frame_id long, rank int")]
    assert [r.frame_id for r in rt.rrf(arms, 5).collect()] == [2, 1]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("is", "is"), ("générale", "générale")])
def test_stems(word, stem):
    assert tx.stem(word) == stem


def test_stemmed_search(spark, corpus):
    texts = spark.createDataFrame([(1, "ray of light", "")], "frame_id long, content_text string, raw_text string")
    found = rt.text_arm(rt.build_index(texts, "content_text", True), corpus.frames, "rays lights", 5, stemmed=True)
    assert found.count() == 1


def test_snippets_and_estimates(spark):
    words = " ".join(f"w{k}" for k in range(40))
    assert tx.snippet_python(words, [["w20"], ["w25"]]) == "…[w20] w21 w22 w23 w24 [w25] w26 w27 w28 w29 w30 w31…"
    assert tx.snippet_python("Ä b, c", [["a", "b"]]) == "[Ä] [b], c" and tx.snippet_python("a", [["b"]]) is None
    df = spark.createDataFrame([("é" * 200,), ("short",)], "t string")
    got = df.select(tx.fallback_snippet(df.t), tx.token_estimate(df.t), tx.truncate_bytes(df.t, 5)).collect()
    assert [tuple(r) for r in got] == [("é" * 160 + "…", 201, "éé"), ("short", 3, "short")]
    assert spark.createDataFrame([("  A b\n",)], "t string").select(tx.normalize_text(F.col("t"))).first()[0] == "a b"


def test_batched_searches_equal_single_ones(spark, corpus):
    asked = [(0, "alpha", unit(1), None, None), (1, "alpha-beta gamma", unit(0), None, None), (2, "gamma", unit(2), 150, 350), (3, "missing", unit(0), None, None), (4, "!!", unit(1), None, None)]
    queries = spark.createDataFrame(asked, "query long, text string, embedding array<float>, start long, end long")
    got = {}
    for r in rt.hybrid_batch(corpus, queries, 5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.frame_id, round(r.score, 9)))
    for n, text, vector, start, end in asked:
        window = {"start": start, "end": end} if start is not None else {}
        want = [(r.frame_id, round(r.score, 9)) for r in rt.hybrid_ids(corpus, text, 5, vector, **window).collect()]
        assert got.get(n, []) == want


@pytest.mark.parametrize("chrome,pool", [(False, 50), (True, 50), (False, 1)])
def test_interactive_search_equals_the_plan(corpus, chrome, pool, monkeypatch):
    monkeypatch.setattr(rt, "candidate_pool", lambda limit: pool)
    monkeypatch.setattr(rt, "OVER_FETCH", 4 if pool > 1 else 1)  # at 1, windows ask the arm again
    for text, vector, window in (("alpha", unit(1), {}), ("alpha-beta gamma", None, {}), ("menu", unit(2), {"start": 150, "end": 450}), ("!!", unit(0), {}), ("missing", None, {}), (" ", unit(0), {})):
        want = [tuple(r) for r in rt.hybrid_search(corpus, text, 3, vector, include_chrome=chrome, **window).collect()]
        got = rt.search_hits(corpus, text, 3, vector, include_chrome=chrome, **window)
        assert [(*r[:3], *r[4:]) for r in got] == [(*r[:3], *r[4:]) for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def plain_search(rows, text, limit, stemmed):
    """BM25 over whole texts in order of rank, without Spark."""
    docs = {i: [tx.stem(t) if stemmed else t for t in tx.tokens_python(content)] for i, content in rows}
    phrases, mean = tx.query_phrases(text, stemmed), sum(map(len, docs.values())) / len(docs)
    tf = lambda words, p: sum(words[k : k + len(p)] == p for k in range(len(words)))
    holding = {tuple(p): sum(tf(w, p) > 0 for w in docs.values()) for p in phrases}
    score = {}
    for i, words in docs.items():
        if all(tf(words, p) for p in phrases):
            score[i] = -sum(max(math.log((len(docs) - holding[tuple(p)] + 0.5) / (holding[tuple(p)] + 0.5)), 1e-6) * (n := tf(words, p)) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean)) for p in phrases)
    return sorted((round(s, 9), i) for i, s in score.items())[:limit]


@pytest.mark.parametrize("stemmed", [False, True])
def test_stored_index_against_brute_force(spark, tmp_path, stemmed):
    rng = random.Random(2)
    words = "hope hopes hoping hoped relational relate motor motoring Ünder under ab ab-cd cat cats".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for k in range(300)]
    texts = spark.createDataFrame(rows, "frame_id long, content_text string")
    frames = spark.createDataFrame([(k, k) for k, _ in rows], "frame_id long, captured_at long")
    for segment in range(2):
        rt.write_index(texts.where(f"frame_id % 2 = {segment}"), "content_text", f"{tmp_path}/i", stemmed, 8, f"s{segment}")
    index = rt.read_index(spark, f"{tmp_path}/i")
    assert rt.segments(spark, f"{tmp_path}/i") == ["s0", "s1"] and index.buckets == 8
    for text in ("hope cats", "hoping-motor", "relational under", "ab-cd hopes", "cat cat", "nothing"):
        got = [(r.score, r.frame_id) for r in rt.text_arm(index, frames, text, 40, stemmed=stemmed).orderBy("rank").collect()]
        want = {i: s for s, i in plain_search(rows, text, 1000, stemmed)}
        assert got == sorted(got) and [s for s, _ in got] == pytest.approx(sorted(want.values())[:40], abs=2e-9) and [s for s, _ in got] == pytest.approx([want[i] for _, i in got], abs=2e-9)
    plan = rt.score_phrases(index, [[["hope"], ["cat"]]])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term, [" in plan.split("PushedFilters: [")[1]


def test_neighbours_of_many_batches_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (600, 5)).astype(float)  # many ties
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    vectors = spark.createDataFrame([(k // 2, k % 2, [float(x) for x in row]) for k, row in enumerate(v)], "frame_id long, chunk_index int, embedding array<float>").repartition(3)
    queries = [(n, [float(x) for x in v[7 * n]]) for n in range(20) if np.abs(v[7 * n]).sum()]
    got = {}
    for r in rt.knn_batch(vectors, queries, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 9), r.frame_id, r.chunk_index))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit_of = lambda x: x / max(np.linalg.norm(x), 1e-300)
    for n, q in queries:
        near = sorted((round(1 - float(unit_of(np.array(q)) @ unit_of(row)), 9), k // 2, k % 2) for k, row in enumerate(v))
        assert [d for d, *_ in got[n]] == pytest.approx([d for d, *_ in near[:7]])
    with pytest.raises(ValueError):
        rt.knn_batch(vectors, queries, rt.MOST_RESULTS)


def test_segments_with_other_numbers_of_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [(k, f"heron number{k} {'mill' if k % 3 else 'lake'}") for k in range(40)]
    parts = [spark.createDataFrame(rows[k::3], "frame_id long, content_text string") for k in range(3)]
    for k, (part, buckets) in enumerate(zip(parts, (32, 7, 1))):
        rt.write_index(part, "content_text", path, buckets=buckets, segment=f"s{k}")
    index, whole = rt.read_index(spark, path), rt.build_index(spark.createDataFrame(rows, "frame_id long, content_text string"), "content_text")
    assert index.parts == (1, 7, 32)
    for query in ([["heron"]], [["number7"]], [["mill"], ["heron"]], [["heron", "number5"]]):
        got, want = (sorted((r.frame_id, round(r.score, 9)) for r in rt.score_phrases(x, [query]).collect()) for x in (index, whole))
        assert got == want and got
    rt.write_index(parts[0], "content_text", path, buckets=5, segment="s0")  # written again with another number
    assert rt.read_index(spark, path).parts == (1, 5, 7) and rt.score_phrases(rt.read_index(spark, path), [[["heron"]]]).count() == 40


def test_marks_are_folded_within_tokens(spark):
    texts = {"\u1ebf": "e", "e\u0302\u0301": "e", "Z\u0307a\u0323b": "zab", "\u0391\u0301\u03c9": "\u03b1\u03c9", "\u1f84x": "\u03b1x", "\u0439": "\u0438", "\ud55c": "\ud55c", "\u0130x": "ix", "na\u00efve": "naive"}
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", tx.tokens(F.col("t")).alias("w")).orderBy("k").collect()
    assert [r.w for r in got] == [[x] for x in texts.values()]
    assert [tx.tokens_python(t) for t in texts] == [[x] for x in texts.values()]
    assert tx.snippet_python("the u\u0308ber heron", [["uber"]]) == "the [u\u0308ber] heron"


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_are_made_where_the_texts_are_read(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(rt, "TOKENS_AT_ONCE", 7)  # a text may be longer
    monkeypatch.setattr(rt, "FILE_BYTES", 50)  # parts of the terms are shared
    monkeypatch.setattr(rt, "TASK_BYTES", 50)
    rows = [(k, " ".join(["herons", "mills", f"w{k % 5}", "heron"][: k % 5] * (1 + k % 3))) for k in range(60)] + [(60, None), (61, "!")]
    texts = spark.createDataFrame(rows, "frame_id long, content_text string")
    index = rt.build_index(texts, "content_text", stemmed)
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    rt.write_index(texts, "content_text", f"{tmp_path}/i", stemmed, 4)
    words = {i: [tx.stem(t) if stemmed else t for t in tx.tokens_python(t or "")] for i, t in rows}
    want = sorted((t, i, len(w), [k for k, x in enumerate(w) if x == t]) for i, w in words.items() for t in set(w))
    for x in (index, rt.read_index(spark, f"{tmp_path}/i")):
        assert sorted(tuple(r) for r in x.postings.select("term", "frame_id", "size", "positions").collect()) == want
        assert tuple(x.totals().first()) == (62, sum(map(len, words.values())) / 62)
    parts = spark.read.parquet(f"{tmp_path}/i/postings").where("term = 'heron'").select(F.input_file_name()).distinct()
    assert parts.count() > 1


def test_batched_terms_shuffle_no_results(spark, monkeypatch):
    monkeypatch.setattr(rt, "CELLS", 20)  # blocks of few frames and queries
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices("heron mill lake weir".split(), k=rng.randint(0, 9)))) for k in range(80)]
    index = rt.build_index(spark.createDataFrame(rows, "frame_id long, content_text string"), "content_text")
    asked = {q: " ".join(rng.choices("heron mill lake weir heron-mill lake-lake missing".split(), k=q % 4)) for q in range(40)}
    terms = [(q, n, k, t) for q, text in asked.items() for n, p in enumerate(tx.query_phrases(text)) for k, t in enumerate(p)]
    found = rt.bm25_batch(index, terms, spark)
    got = {(r.query, r.frame_id): r.score for r in found.collect()}
    assert got == pytest.approx({(q, i): s for q, text in asked.items() if text for s, i in plain_search(rows, text, 100, False)}, abs=2e-9) and got
    # What follows the match of queries and frames is narrow.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_batched_terms_of_any_number_are_matched_in_passes(spark, monkeypatch):
    """61,500 searches, as a 50th of the rows of 6 GB are, have more tokens than a batch took."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choices([f"w{x}" for x in range(40)], k=12))) for k in range(30)]
    index = rt.build_index(spark.createDataFrame(rows, "frame_id long, content_text string"), "content_text")
    terms = [(q, n, 0, t) for q in range(61_500) for n, t in enumerate((f"w{q % 40}", f"w{q % 37}", "w0")[: 2 + q % 2])]
    found = rt.bm25_batch(index, terms, spark)
    own = {i: set(t.split()) for i, t in rows}
    want = {q: sum({f"w{q % 40}", f"w{q % 37}", *["w0"] * (q % 2)} <= s for s in own.values()) for q in range(61_500)}
    got = {r.query: r["count"] for r in found.groupBy("query").count().collect()}
    assert got == {q: n for q, n in want.items() if n}
    # Passes, of which a query may exceed one, find the same.
    asked = {q: [f"w{q % 40}", f"w{q % 7}", f"w{q % 3}"][: 1 + q % 3] for q in range(50)}
    few = [(q, n, 0, t) for q, words in asked.items() for n, t in enumerate(words)]
    whole = {(r.query, r.frame_id): r.score for r in rt.bm25_batch(index, few, spark).collect()}
    for most in (1, 7, 40):
        monkeypatch.setattr(rt, "PASS_TOKENS", most)
        assert [t for p in rt.passes(few) for t in p] == few and all(len(p) <= max(most, 3) for p in rt.passes(few))
    assert {(r.query, r.frame_id): r.score for r in rt.bm25_batch(index, few, spark).collect()} == whole and whole
    assert rt.bm25_batch(index, [], spark).count() == 0
