import corpus_pipeline
from tests.llm.test_near_copies import smallest
from tests.llm.test_quality import plain_counts
from tidemark.llm import quality, secret_scan


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        rows = {r.doc_id: r.text for r in before.collect()}
        got = {r.doc_id: r.text for r in kept.collect()}
        if name == "quality rules":
            said = {r.doc_id: r.kept for r in quality.judge(before).collect()}
            assert set(got) == {d for d in rows if said[d]} and all(plain_counts(rows[d])[0] >= 50 for d in got)
        elif name == "SimHash near-dedup":
            low = smallest(list(rows.items()))
            assert set(got) == {d for d in rows if low[d] == d}
        else:
            net = secret_scan.trained()
            assert set(got) == set(rows)
            for d, text in got.items():
                assert (text == rows[d]) == (not secret_scan.find(rows[d], net))
                assert not [x for x in secret_scan.find(text, net) if x[0] in ("access", "hex")]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
