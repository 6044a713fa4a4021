import random
import re
from itertools import permutations

import duckdb

from tidemark.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask string"
LABELS = "doc_id long, quality int, toxic int, n int"


def plain_mask(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3


def plain(docs, labels):
    """Rows by walking every order over every document."""
    low = {}
    for d, t, *_ in docs:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    parts = {}
    for d, t, s, *_ in docs:
        mask = plain_mask(t or "") | (d is not None and d > low[t or ""]) << 4
        parts.setdefault(s or "", []).append((mask, d in good, d in toxic))
    rows, shapley = [], {}
    for part, held in parts.items():
        for order in permutations(range(5)):
            applied = 0
            for step, k in enumerate(order, 1):
                bit = 1 << k
                gone = [x for x in held if x[0] & bit and not x[0] & applied]
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
                rows.append([part, "".join("ABCDE"[x] for x in order), step, sum(not x[0] & (applied | bit) for x in held), len(gone), sum(bool(x[0] & bit and x[0] & applied) for x in held), sum(x[0] == bit for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)])
                applied |= bit
    return sorted((*r, shapley[r[0], "ABCDE".index(r[1][r[2] - 1])]) for r in rows)


def documents():
    rng = random.Random(8)
    texts = [None, "", " \n\x0b", "x " * 60_000, "É" * 30, "A" * 4 + "é" * 80, "A" * 5 + "é" * 95, "\x1c\x85"]
    for _ in range(90):
        words = [rng.choice(["a", "B", "c#", "Word", "more", f"w{k}"]) if rng.random() < 0.4 else f"w{k}" for k in range(rng.choice([49, 50, 80]))]
        texts.append(rng.choice([" ", "\t"]).join(words))
    rows = [(k, t, f"s{k % 3}" if k % 4 else None) for k, t in enumerate(texts)]
    rows += [(200 + k, texts[k % 6 + 8], "s1") for k in range(60)] + [(8, texts[8], "s1"), (8, texts[8], "s2"), (8, "x", "s2"), (None, texts[9], "s0"), (None, None, None)]
    return [(*r, "x", None) for r in rows]


def labels():
    return [(k, k % 2, (k % 5 == 0) + 0, 7) for k in range(0, 240, 2)] + [(8, 0, 1, 7), (10, None, None, 7), (None, 1, 1, 7), (9999, 1, 1, 7)]


def test_against_every_order(spark, tmp_path):
    docs, marks = spark.createDataFrame(documents(), SCHEMA).repartition(3), spark.createDataFrame(labels(), LABELS)
    got = filter_audit.audit(docs, marks)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    want = plain(documents(), labels())
    assert sorted(map(tuple, got.collect())) == want and len(want) == 4 * 600
    docs.write.parquet(f"{tmp_path}/documents")
    marks.write.parquet(f"{tmp_path}/labels")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({filter_audit.oracle()})").fetchall()) == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


def test_levels_of_the_walk(spark):
    levels = {r.step: r["count"] for r in filter_audit.walk(spark.createDataFrame([(0,), (3,)], "mask int")).groupBy("step").count().collect()}
    assert levels == {1: 10, 2: 40, 3: 120, 4: 240, 5: 240}
