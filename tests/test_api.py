import pytest
from pyspark.sql import functions as F

from tests.test_streaming import some_frames
from tidemark import schema
from tidemark.api import Engine
from tidemark.operators import queue, retrieval
from tidemark.providers import HashEmbedder, embed
from tidemark.schema import DAY_MS
from tidemark.sources.tables import Store
from tidemark.streaming import stateful


def test_commands_over_a_store(spark, tmp_path):
    store, embedder = Store(spark, f"file://{tmp_path}/s"), HashEmbedder(16)
    frames = [(k, 1000 * k, 0, 10, 10, f"frames/{k}.jpg", "h", "ed" if k % 2 else None, None, None, None) for k in range(30)]
    store.write("frames", spark.createDataFrame(frames, schema.FRAMES))
    texts = spark.createDataFrame([(k, f"note {k} heron menu", f"note {k} heron", "ocr", 2, 0, None, "ed") for k in range(30)], schema.FRAME_TEXT)
    store.write("frame_text", texts)
    vectors = texts.select("frame_id", F.lit(0).alias("chunk_index"), F.col("content_text").alias("chunk_text"), F.lit("ocr").alias("source"), F.lit("m").alias("model"), embed(embedder, F.col("content_text")).alias("embedding"))
    store.write("embeddings", vectors)
    engine = Engine(store, embedder)
    hits = engine.search("note 7 herons", 5).collect()
    assert hits[0].frame_id == 7 and "[heron]" in hits[0].snippet
    assert engine.search("menu").count() > 0 and Engine(store).search("menu").count() == 0
    assert Engine(store).search("menu", include_chrome=True).count() == 20
    assert engine.ask_context("note 7 heron", 3, 40).count() <= 3
    assert engine.get_timeline(0, 30_000, 1).count() <= 120 and engine.get_frames(0, 30_000, 9999).count() == 30
    assert engine.get_nearest_frame(6500).first().frame_id == 7
    assert engine.get_frame_context(5000, 3000, 2).count() == 4
    assert engine.get_insights(0, 30_000, 24)["totals"].first().total == 30
    assert engine.get_frame(3, spark.createDataFrame([(3, "b"), (3, "a")], "frame_id long, name string")).first().tags == ["a", "b"]
    engine.enqueue_vision(5, frame_id=3)
    engine.enqueue_vision(5, start=0, end=5000)
    assert engine.get_job_stats().first().pending == 5
    assert engine.get_text_filter_stats().count() == 0 and engine.get_storage_stats().first().n_bytes > 0
    assert engine.plan_report(0, 30_000).count() == 30
    assert engine.backfill() == 0
    engine.delete_frames(spark.createDataFrame([(3,)], "frame_id long"))
    assert store.read("frames").count() == 29 and store.read("frame_text").count() == 29 and engine.get_job_stats().first().pending == 4 - 0


class Model:
    context_tokens = 8192

    def __init__(self, pieces=("<think>hm</think>", "an ", "answer")):
        self.pieces, self.seen = pieces, []

    def answer(self, question, context):
        self.seen.append(context)
        yield from self.pieces
        if not self.pieces:
            raise RuntimeError("no model")

    def summarise(self, prompt, texts, reply_tokens):
        self.seen.append(texts)
        return "a summary", [i for i, _ in texts]


def test_stored_index_answers_and_reports(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frames, texts = some_frames(spark, range(30)), [(k, f"note {k} heron{' owl' if k % 3 else ''} menu") for k in range(30)]
    for part in ("a", "b"):
        mine = [(k, t) for k, t in texts if (k < 20) == (part == "a")]
        stateful.ingest_plain(store, frames[0].where(F.col("frame_id").isin([k for k, _ in mine])), spark.createDataFrame(mine, "frame_id long, raw_text string"), 5, part)
        if part == "a":
            Engine(store).index_texts()
            assert set(Engine(store).indexes()) == {"content_text", "raw_text"}
    engine = Engine(store)
    want = [tuple(r) for r in engine.search("herons owl", 30).collect()]
    assert engine.indexes() == {} and len(want) == 20  # the second batch isn't indexed yet
    engine.index_texts()
    corpus = engine.corpus()
    assert set(corpus.indexes) == {"content_text", "raw_text"} and [tuple(r) for r in engine.search("herons owl", 30).collect()] == want
    read = retrieval.score_phrases(corpus.indexes["content_text"], [[["heron"]]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in read or "bucket#" in read.split("PartitionFilters: [")[1].split("]")[0]

    model = Model()
    deltas = list(engine.ask("note 7 heron", model, 3))
    cited = [x for kind, x in deltas if kind == "citation"]
    assert deltas[:3] == [("thinking", "hm"), ("token", "an "), ("token", "answer")] and deltas[-1] == ("done", None) and 7 in cited and cited == [i for i, _ in model.seen[0]]
    assert list(engine.ask("heron", Model(), 3, cancelled=lambda: True)) == [("cancelled", None)]
    assert list(engine.ask("heron", Model(()), 3))[-1] == ("error", "no model")

    report = engine.generate_report(0, 40 * DAY_MS, Model(), weekly=200)
    assert report.mode == "map_reduce" and 20 < report.periods_covered <= 30
    assert report.frames_sampled == report.frames_summarized == 30 and not report.truncated and 0 in report.cited
    assert engine.generate_report(0, 10 * DAY_MS, Model(), daily=3, weekly=3).truncated is False
    assert engine.generate_report(50 * DAY_MS, 60 * DAY_MS, Model()).mode == "empty"
    about = engine.generate_report(0, 40 * DAY_MS, Model(), prompt="owl", weekly=10)
    assert about.mode == "single_pass" and about.truncated and about.frames_sampled == 10
    assert not engine.generate_report(0, 40 * DAY_MS, Model(), prompt="owl", weekly=50).truncated


def test_settings_jobs_images_and_sweeps(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    engine = Engine(store)
    assert engine.get_settings()["capture_interval_ms"] == 2000
    engine.set_settings({"capture_interval_ms": 1, "tagging_enabled": True, "excluded_apps": '["bank"]'})
    with pytest.raises(KeyError):
        engine.set_settings({"max_width": 640, "nothing": 1})
    with pytest.raises(TypeError):
        engine.set_settings({"max_width": 640, "tagging_enabled": "yes"})
    got = engine.get_settings()
    assert (got["capture_interval_ms"], got["tagging_enabled"], got["excluded_apps"], got["max_width"]) == (250, True, '["bank"]', 1920)

    stateful.ingest_plain(store, some_frames(spark, range(6))[0].withColumn("app_hint", F.when(F.col("frame_id") < 2, "Bank").otherwise("ed")), spark.createDataFrame([(k, "x") for k in range(6)], "frame_id long, raw_text string"), 5, "a")
    with pytest.raises(LookupError):
        engine.complete_jobs([1], 9)
    with pytest.raises(LookupError):
        engine.fail_jobs([99], "lost", 9)
    done = lambda jobs: jobs.select("job_id", "frame_id", "attempts", F.lit(True).alias("frame_exists"), F.lit("x").alias("text"), F.lit(False).alias("needs_image"), F.lit(None).cast("string").alias("image_state"), (F.col("frame_id") != 1).alias("provider_ok"))
    assert engine.work(["embed_text"], 10, done, 3) == 3 and engine.work(["nothing"], 10, done) == 0
    assert {r.frame_id: (r.state, r.attempts, r.not_before) for r in store.read("jobs").collect() if r.frame_id < 4} == {0: ("done", 0, 0), 1: ("pending", 1, 1010), 2: ("done", 0, 0), 3: ("pending", 0, 0)}
    store.write("jobs", queue.claim(store.read("jobs"), ["embed_text"], 1, 2000))
    running = [r.job_id for r in store.read("jobs").where("state = 'running'").collect()]
    engine.complete_jobs(running, 9)
    assert store.read("jobs").where(F.col("job_id").isin(running)).first().state == "done"

    store.write("image_embeddings", spark.createDataFrame([(k, "m", [1.0, float(k)]) for k in range(6)], schema.IMAGE_EMBEDDINGS))
    store.write("frame_tags", spark.createDataFrame([(k, "t") for k in range(6)], schema.FRAME_TAGS))
    assert [r.frame_id for r in engine.search_images([1.0, 0.0], 2).orderBy("rank").collect()] == [0, 1]
    assert engine.purge_app("BANK", 1) == 2 and engine.purge_app("bank") == 0
    assert engine.sweep_retention(10 * DAY_MS, 6, lambda paths: [not p.endswith("3.jpg") for p in paths]) == 1
    left = sorted(r.frame_id for r in store.read("frames").collect())
    assert left == [3, 4, 5] == sorted(r.frame_id for r in store.read("frame_tags").collect()) == sorted(r.frame_id for r in store.read("image_embeddings").collect())
    assert [queue.idle_wait_ms(x) for x in (0, 250, 1000, 2000)] == [250, 500, 2000, 2000] and queue.refill(True, 0, 20, 7) == (7, True) and queue.refill(True, 0, 20, 0) == (0, False)
    spark.range(1).write.parquet(f"{tmp_path}/s/_schema/v{schema.SCHEMA_VERSION + 1}")
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/s")
