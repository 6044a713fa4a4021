import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import resampling
from tidemark.llm.resampling import Draw

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, weight string, bucket string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=40))
def test_crcs_of_columns(found):
    assert resampling.crcs(found).tolist() == [zlib.crc32(x) for x in found]


def test_crcs_of_one_long_feature():
    long = [random.Random(1).randbytes(n) for n in (63, 64, 65, 127, 128, 129, 300_001)]
    assert resampling.crcs(long).tolist() == [zlib.crc32(x) for x in long]
    assert resampling.crcs([]).tolist() == []


def plain_features(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[k : k + n]).encode() for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_cross_blocks(monkeypatch, longest):
    monkeypatch.setattr(resampling, "BLOCK", 7)
    for text in ("", "one", "One two-three four's FIVE é日本 " * 9, " .. ", "x" * 50):
        found = list(resampling.features(text.encode(), longest))
        n, want = plain_features(text, longest)
        assert sum(k for k, _ in found) == n and Counter(x for _, some in found for x in some) == Counter(want)


def plain(docs, target, draw):
    """Rows by the definition, without Spark or matrices."""
    counts = lambda texts: Counter(zlib.crc32(x) % draw.buckets for t in texts for x in plain_features(t, draw.longest)[1])
    s, t = counts(r[1] for r in docs), counts(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + draw.buckets) / ((s[b] + 1) * (sum(t.values()) + draw.buckets))))
    rows = []
    for doc_id, text, *_ in docs:
        n, found = plain_features(text, draw.longest)
        weight = sum(gain(zlib.crc32(x) % draw.buckets) for x in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{draw.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, n])
    able = sorted((r for r in rows if r[3] is not None and r[5] >= draw.least_words), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(able[: draw.percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def documents():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "K9", "x" * 90]
    rows = [(0, None), (1, ""), (2, " .,\n"), (3, "few words"), (4, "y" * 5000), (5, "long " * 30_000)]
    rows += [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(words[: rng.randint(3, 64)], k=rng.randint(1, 60))).title()) for k in range(10, 210)]
    rows += [rows[20]] * 40 + [(11, "another text of a repeated number " * 4), (None, rows[30][1]), (None, None)]
    return [(d, t, "x", None) for d, t in rows]


@pytest.mark.parametrize("draw", [Draw(), Draw(longest=2, buckets=97, percent=35, least_words=5, seed="z"), Draw(percent=100, least_words=0), Draw(percent=0)])
def test_against_the_definition(spark, draw):
    docs, goal = documents(), ["W1 w2 w3 w3", None, "", "日本 日本"]
    df, target = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(k, t) for k, t in enumerate(goal)], "item_id long, text string")
    got = resampling.resample(df, target, draw)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, goal, draw)


def test_empty_sides(spark):
    docs = documents()
    df, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, resampling.resample(df, none).collect()), key=str) == plain(docs, [], Draw())
    assert resampling.resample(df.limit(0), none).count() == 0


def test_scores_of_one_block_and_ties(spark):
    rows = [(k, 30, 5, 700 + k % 3 - 300 * (k % 7 == 0)) for k in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, weight long, score long").selectExpr("*", "n_words AS n_features")
    got = {r.doc_id: r["rank"] for r in resampling.ranked(scored, Draw(percent=50)).collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert got == {r[0]: k + 1 if k < 500 else None for k, r in enumerate(order)}
