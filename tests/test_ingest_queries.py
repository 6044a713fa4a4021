import random

import duckdb
import pytest

from tidemark.queries import ingest


def shuffled_bytes(spark):
    """Bytes that all stages so far gave to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    store, empty = sc.statusStore(), spark._jvm.java.util.ArrayList()
    stages = store.stageList(empty, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Documents with long lines of words, frequent short lines, titles, blank lines and no text; and the bytes of their texts."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("lines")
    words = [f"{a}{b}" for a in ("Ka", "lo", "ÉMI", "straße", "x") for b in ("ra", "to", "-n", "9", "VE")]
    common = ["Save  File", "a B c d É f g h I", " a b  c d e f g\xa0h i\tj", "", "   ", "1 2 3 4 5 6 7 8 9."]
    rows = []
    for d in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(30, 90))) if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randint(1, 60))]
        rows.append((d, None if d == 50 else "" if d == 51 else "  \n " if d == 52 else "\n".join(lines), None if d % 11 == 0 else f"app{d % 2}"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), sum(len((text or "").encode()) for _, text, _ in rows)


def agrees(spark, documents, name):
    """Holds a query against its SQL; what it shuffled, as a part of the texts' bytes."""
    path, n_bytes = documents
    before = shuffled_bytes(spark)
    df = ingest.QUERIES[name](spark, path)
    got = [tuple(r) for r in df.collect()]
    shuffled = shuffled_bytes(spark) - before
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(ingest.ORACLES[name]).fetchall()
    assert [c[0] for c in con.description] == df.columns
    assert len(got) > 10 and sorted(got, key=repr) == sorted(want, key=repr)
    return shuffled / n_bytes


def test_reconciling_shuffles_little(spark, documents):
    assert agrees(spark, documents, "reconcile_backfill") < 0.1


def test_texts_are_shuffled_once(spark, documents):
    assert agrees(spark, documents, "content_text_rebuild") < 0.6


def test_roles_shuffle_little(spark, documents):
    assert agrees(spark, documents, "classify_roles") < 0.1


def test_catalog_shuffles_little(spark, documents):
    assert agrees(spark, documents, "chrome_catalog") < 0.1


def test_boxes_shuffle_nothing(spark, documents):
    assert agrees(spark, documents, "line_bbox") == 0
