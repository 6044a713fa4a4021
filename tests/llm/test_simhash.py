import random
import re
from math import comb

import numpy as np
import pytest
import xxhash

from tidemark.llm import components as components_of
from tidemark.llm import simhash
from tidemark.llm.components import components


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, threshold=4):
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= threshold and group[j] > group[i]:
                    group[j], changed = group[i], True
    low = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return sorted(((d, f"{p:016x}", low.get(g)) for (d, _), p, g in zip(rows, prints, group)), key=str)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == plain_components(rows)


def test_edges(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    long = rng.choices(words, k=300)
    rows = [(9, None), (4, ""), (5, " \n "), (1, "One two"), (2, "ONE two"), (2, "ONE two"), (None, "one two"), (3, "é K İ x y"), (7, "word " * 9000)]
    for k in range(20):  # a chain of near copies
        long = long[:]
        long[rng.randrange(300)] = rng.choice(words)
        rows.append((100 - k, " ".join(long)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fingerprint", "1 AS print")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == plain_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _, c in got if d is not None and d == c)


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(12)]
    prints = np.unique(np.array(near, np.uint64))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    want = {(int(a), int(b)) for a in prints.view(np.int64) for b in prints.view(np.int64) if a < b and int(a ^ b).bit_count() <= 4 and (int(a) ^ int(b)) & (2**64 - 1)}
    want = {(a, b) for a, b in want if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    full = {(int(a), int(b)) for a in prints.view(np.int64) for b in prints.view(np.int64) if a < b and ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 4}
    for bands in (None, 5, 6, 7, 9):  # any number of bands gives the same links
        assert {(r.a, r.b) for r in simhash.links(table, bands=bands).collect()} == full and want <= full


def test_more_fingerprints_get_more_bands():
    chosen = [simhash.bands_for(n) for n in (0, 1000, 250_000, 10**7, 10**9, 10**11)]
    assert chosen == sorted(chosen) and chosen[0] == 5 and chosen[2] == 6 and chosen[-1] > 8


@pytest.mark.parametrize("hot", [200, 3])  # at 3, nodes with a third of the links take the way of hubs
def test_components_of_paths_and_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(components_of, "HOT_NODES", hot)
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}}


@pytest.mark.parametrize("hot", [200, 3])
def test_components_of_more_links_than_are_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(components_of, "MOST_LINKS", 0)
    test_components_of_paths_and_stars(spark, monkeypatch, hot)


def classes_of(links):
    low = {x: x for link in links for x in link}
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize("part", [2048, 7])  # at 7, keys are cut into parts
def test_one_dense_group_makes_no_row_for_each_link(spark, monkeypatch, part):
    """All fingerprints at most 2 bits from one: each two of them are linked."""
    monkeypatch.setattr(simhash, "PART_PRINTS", part)
    base = 0x8123_4567_89AB_CDEF
    near = [base] + [base ^ 1 << a ^ (1 << b if b < a else 0) for a in range(24) for b in range(a + 1)]
    far = [int(x) for x in np.random.default_rng(2).integers(0, 2**64, 300, np.uint64)]
    prints = np.array(near + far, np.uint64).view(np.int64)
    table = spark.createDataFrame([(int(p),) for p in prints], "print long")
    every = [(int(a), int(b)) for k, a in enumerate(prints) for b in prints[:k][np.bitwise_count((prints[:k] ^ a).view(np.uint64)) <= 4]]
    for bands in (5, 6):
        rows = simhash.groups(table, bands=bands).collect()
        assert classes_of({(r.a, r.b) for r in rows}) == classes_of(every) and len(every) > 40_000
        assert part == 7 or len(rows) <= len(near) * comb(bands, 4)  # a row for each key of a fingerprint at most


def test_groups_connect_what_links_of_two_classes_do(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(10)]
    prints = np.unique(np.array(near, np.uint64)).view(np.int64)
    of = {int(p): int(p) % 3 for p in prints}
    table = spark.createDataFrame(list(of.items()), "print long, class long")
    want = {(r.a, r.b) for r in simhash.links(table).collect() if of[r.a] != of[r.b]}
    rows = simhash.groups(table).collect()
    assert classes_of({(r.a, r.b) for r in rows}) == classes_of(want)
    members = {}
    for r in rows:
        members.setdefault((r.key, r.a), set()).add(r.b)
    assert all(any({a, b} <= m for m in members.values()) for a, b in want)


def test_grouped_with_rows_of_many_batches(spark):
    prints = np.arange(3000, dtype=np.int64) << 40  # 12 bits that all differ in, so keys have thousands of rows
    table = spark.createDataFrame([(int(p),) for p in prints], "print long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        links = [(r.a, r.b) for r in simhash.groups(table).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(classes_of(links).values()) == {0} and len(classes_of(links)) == 3000
