import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import common, near_copies


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def smallest(rows):
    """doc_id: smallest doc_id that pairs of Jaccard 0.8 or more lead to, by brute force."""
    of, low = {d: sets(t) for d, t in rows}, {d: d for d, _ in rows}
    near = [(a, b) for a in of for b in of if a < b and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])]
    while any(low[a] != low[b] for a, b in near):
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_copies_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = [(0, ""), (1, None), (2, "One two"), (3, "one TWO")]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(5):
            text = base[:]
            for _ in range(rng.randint(0, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    base = rng.choices(words, k=200)
    for k in range(60):  # a group larger than the pairs compared of one band
        text = base[:]
        for at in rng.sample(range(200), 2):
            text[at] = f"x{k}"
        rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node")
    want = smallest(rows)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in want if want[d] == d}
    assert near_copies.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [(256, 1 << 20), (20, 1 << 20), (256, 2000)])
def test_one_dense_group_loses_no_link(spark, monkeypatch, parts):
    """Texts around the threshold: bands of hundreds in which most pairs aren't similar; with buckets whole and in parts."""
    monkeypatch.setattr(near_copies, "PART_TEXTS", parts[0])
    monkeypatch.setattr(near_copies, "PART_SHINGLES", parts[1])
    rng = random.Random(15)
    words = [f"w{k}" for k in range(900)]
    base, rows = rng.choices(words, k=120), []
    for k in range(350):
        text = base[:]
        for at in rng.sample(range(120), rng.randint(0, 7)):
            text[at] = rng.choice(words)
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_copies.signatures(docs)
    assert near_copies.buckets(nodes).groupBy("bucket").count().agg({"count": "max"}).first()[0] > 60
    got, want = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}, smallest(rows)
    assert len(set(want.values())) > 10  # some are like no other
    assert got == want


def test_spanning_links_connect_what_all_links_do():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.choice(10_000, 40, replace=False)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0, 0.05, 0.3]), rng.choice(10_000, 40), base)).astype(np.int64) for _ in range(rng.integers(2, 25))]
        names = list(range(len(sets)))

        def classes(links):
            of = dict(zip(names, names))
            for _ in names:
                for a, b in links:
                    of[a] = of[b] = min(of[a], of[b])
            return of

        every = [(a, b) for b in names for a in names[:b] if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        got = near_copies.spanning_links(names, sets)
        assert set(got) <= set(every) and len(got) < len(names) and classes(got) == classes(every)


def test_tables_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    bases = [rng.choices(words, k=100) for _ in range(6)]
    rows = [(k, " ".join([*bases[k % 6][: 100 - k % 4], *(f"x{k}" for _ in range(k % 4))])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == smallest(rows)


def test_tasks_and_files_of_the_shuffles_stay_few(spark):
    """Each task leaves files and log lines however few rows it has; with hundreds of partitions these were most of the disk."""
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(80)]
        rows += [(len(rows) + k, " ".join([*base[:-1], f"x{k}"])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("near copies", "tasks are counted")
    try:
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in tracker.getJobIdsForGroup("near copies") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert got == smallest(rows)
    assert tasks < 110 * 4, tasks  # shuffles of 4 partitions


def test_near_fingerprints_of_other_texts_make_no_row_for_each_pair(spark, monkeypatch):
    """A refrain sets all bits but a few, so fingerprints are near; most distinct shingles aren't shared."""
    rng = random.Random(25)
    words = [f"w{k}" for k in range(5000)]
    refrain = rng.choices(words, k=12) * 40
    rows = [(k, " ".join([*refrain, *rng.choices(words, k=40)])) for k in range(150)]
    rows += [(200 + d, f"{text} x{d}") for d, text in rows[:20]]  # these have near copies
    given, within = [], near_copies.links_within

    def seen(members, *args, **more):
        given.append(members.count())
        return within(members, *args, **more)

    monkeypatch.setattr(near_copies, "links_within", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == smallest(rows)
    prints = {near_copies.simhash.fingerprint(t) for _, t in rows}
    pairs = sum((a ^ b).bit_count() <= 4 for a in prints for b in prints if a < b)
    assert pairs > 4_000 and given[1] < pairs, (given, pairs)  # two rows for each pair before


def test_spanning_links_of_near_fingerprints_alone():
    sets, prints = [np.arange(20)] * 4, [0, 0b1111, 0b11111, -1]
    assert len(near_copies.spanning_links([1, 2, 3, 4], sets)) == 3
    assert near_copies.spanning_links([1, 2, 3, 4], sets, prints) == [(1, 2), (2, 3)]


def linked_prints(rows):
    """doc_id: smallest doc_id that SimHash links between texts of Jaccard 0.8 or more lead to, by brute force."""
    of, low = {d: sets(t) for d, t in rows}, {d: d for d, _ in rows}
    prints = {d: near_copies.simhash.fingerprint(t or "") for d, t in rows}
    near = [(a, b) for a in of for b in of if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])]
    while any(low[a] != low[b] for a, b in near):
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize("parts", [256, 8])
def test_all_texts_of_a_fingerprint_are_candidates(spark, monkeypatch, parts):
    """Without bands: texts of few fingerprints, most of which aren't like the first of theirs."""
    monkeypatch.setattr(near_copies, "PART_TEXTS", parts)
    monkeypatch.setattr(near_copies, "bands", lambda hashes: np.array([hashes.sum()]).view(np.int64))
    rng = random.Random(31)
    words = [f"w{k}" for k in range(5000)]
    refrain, rows = rng.choices(words, k=13) * 40, []
    for k in range(40):
        own = rng.choices(words, k=14)
        rows += [(4 * k + d, " ".join([*refrain, *own, *(f"x{d}" for _ in range(d))])) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [near_copies.simhash.fingerprint(t) for _, t in rows]
    want = linked_prints(rows)
    assert len(set(prints)) < len(set(want.values())) < len(rows) / 2, (len(set(prints)), len(set(want.values())))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want


def test_rows_without_a_doc_id_are_compared(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(90)] for _ in range(4)]
    like = lambda k, x: " ".join([*base[k][:-1], x])
    rows = [(5, like(0, "a")), (None, like(0, "b")), (7, like(0, "c")), (None, like(1, "a")), (None, like(1, "b")), (None, like(1, "b")), (9, like(2, "a")), (None, like(3, "a")), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_copies.near_copies(docs).collect())
    assert got == [(0, 0)] * 6 + [(0, 5), (5, 5), (7, 5), (9, 9)]
    kept = near_copies.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, (r.text or "").split()[:1]) for r in kept.collect()]
    assert sorted(left, key=str) == sorted([(5, base[0][:1]), (9, base[2][:1]), (None, base[1][:1]), (None, base[3][:1]), (None, [])], key=str)
