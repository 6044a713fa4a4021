import random
import re

import duckdb
import pytest

from tidemark.llm import license_scan

SCHEMA = "doc_id long, text string, labels string, words string"


def texts():
    rng = random.Random(6)
    parts = ["MIT", "mit", "license", "Apache", "general", "public", "licensed", "under", "the", "cc", "by", "nc", "4.0", "Released", ",", "\n", "é", "K", "x", "İ", "GNU"]
    out = [None, "", " .. ", "mit", "MIT License", "word " * 9000 + "apache license", "Licensed under CC BY-NC 4.0.", "Released plus under the MIT License", "released under the mit " * 400]
    out += ["one two " + re.sub(" of ", " of the ", license_scan.TEMPLATES[1][1]) + " three", license_scan.TEMPLATES[9][1].upper()]
    return out + [rng.choice([" ", "-"]).join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]


def test_against_sql(spark, tmp_path):
    rows = [(k, t, "x", None) for k, t in enumerate(texts())] + [(4, "MIT License", "y", "z"), (None, "MIT License", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({license_scan.oracle()})").fetchall()
    got = [tuple(r) for r in license_scan.scan(docs).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,labels", [("so: permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated files (the Software), to deal in the Software without restriction!", "mit"), ("plain words only", ""), ("see the mit license", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc")])
def test_labels(spark, text, labels):
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == labels and (row.score > 0) == bool(labels)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    assert row.n_words == len(words)


def test_phrases_of_other_words_and_templates_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the Sleepycat terms"), (2, "MIT license"), (3, "plain"), (4, license_scan.TEMPLATES[1][1]), (5, None)], "doc_id long, text string")
    want = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    monkeypatch.setattr(license_scan, "MOST_GRAMS", 0)
    assert {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()} == want
    monkeypatch.setattr(license_scan, "PHRASES", (("sleepycat terms", "sleepycat"), ("mit license", "mit")))
    got = {r.doc_id: (r.n_base, r.base_labels) for r in license_scan.scan(docs).collect()}
    assert got[1] == (1, "sleepycat") and got[2] == (1, "mit") and got[3] == (0, "")
