import pathlib

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import some_frames
from tidemark import schema
from tidemark.api import Engine
from tidemark.operators import timeseries as ts
from tidemark.schema import DAY_MS
from tidemark.sources import images
from tidemark.sources.tables import Store, cover
from tidemark.streaming import stateful as st


def job(k, state="pending", **more):
    row = dict(job_id=k, kind="embed_text", frame_id=k, state=state, priority=0, attempts=0, max_attempts=3, not_before=0, last_error=None, updated_at=0) | more
    return tuple(row[n] for n in schema.JOBS.names)


def states(store):
    return {r.job_id: r.state for r in store.read("jobs").collect()}


def test_changes_write_the_changed_rows_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    put = lambda *jobs: store.change("jobs", spark.createDataFrame(jobs, schema.JOBS))
    put(job(1))  # before there is a version
    assert states(store) == {1: "pending"}
    store.write("jobs", spark.createDataFrame([job(k) for k in range(100)], schema.JOBS))
    assert store.changes("jobs") == [] and len(states(store)) == 100
    wanted = {k: "pending" for k in range(100)}
    for n in range(1, 12):
        put(job(n % 4, f"s{n}"), job(200 + n, "new"))
        wanted |= {n % 4: f"s{n}", 200 + n: "new"}
        assert len(store.changes("jobs")) == bin(n).count("1")
        if n in (1, 2, 7, 11):
            assert states(store) == wanted and store.read("jobs").count() == len(wanted)
    assert store.versions("jobs") == [1]
    store.append("jobs", spark.createDataFrame([job(300), job(1, "in a batch")], schema.JOBS), "b")
    assert states(store) == wanted | {300: "pending"}  # changes count over batches
    store.compact("jobs")
    assert states(store) == wanted | {300: "pending"} and store.changes("jobs") == [] and store.read("jobs").count() == len(wanted) + 1
    plan = store.read("jobs").where("state = 'pending'")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_lost_change_is_not_seen(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("jobs", spark.createDataFrame([job(1)], schema.JOBS))
    store.change("jobs", spark.createDataFrame([job(1, "running")], schema.JOBS))
    bad = spark.createDataFrame([job(1, "done")], schema.JOBS).withColumn("state", F.expr("raise_error('lost')").cast("string"))
    with pytest.raises(Exception):
        store.change("jobs", bad)
    assert states(store) == {1: "running"}
    store.change("jobs", spark.createDataFrame([job(1, "done")], schema.JOBS))
    assert states(store) == {1: "done"} and store.changes("jobs") == [(1, 2)]


def filled(spark, tmp_path, ids=range(12)):
    store = Store(spark, f"file://{tmp_path}/s")
    for part in (0, 1):
        mine = [k for k in ids if k % 2 == part]
        frames = some_frames(spark, mine)[0].withColumn("app_hint", F.when(F.col("frame_id") % 3 == 0, "Bank").otherwise("ed"))
        st.ingest_plain(store, frames, spark.createDataFrame([(k, f"note {k} heron{' owl' * (k % 4)}") for k in mine], "frame_id long, raw_text string"), 5, f"b{part}")
    store.write("embeddings", spark.createDataFrame([(k, 0, "x", "ocr", "m", [1.0]) for k in ids], schema.EMBEDDINGS))
    return store


def ids_of(df):
    return sorted(r.frame_id for r in df.select("frame_id").collect())


def files_of(path):
    return {p for p in pathlib.Path(path).rglob("*.parquet")}


def test_purge_appends_a_small_file_and_keeps_what_it_can_t_remove(spark, tmp_path):
    store, folder = filled(spark, tmp_path), images.Folder(f"file://{tmp_path}/data")
    for k in range(12):
        folder.write(f"frames/{k}.jpg", b"image")
    (tmp_path / "data/frames/6.jpg").unlink()
    (tmp_path / "data/frames/9.jpg").unlink()
    (tmp_path / "data/frames/9.jpg/locked").mkdir(parents=True)  # can't be removed as a file
    engine, remover = Engine(store), images.Remover(f"file://{tmp_path}/data")
    before = files_of(f"{tmp_path}/s")
    assert engine.purge_app("bank", 2, remover) == 3  # 0, 3, and 6, whose file was gone
    added = files_of(f"{tmp_path}/s") - before
    assert len(added) == 1 and before <= files_of(f"{tmp_path}/s") and "_deleted" in str(added)
    left = [k for k in range(12) if k not in (0, 3, 6)]
    for name in ("frames", "frame_text", "jobs", "embeddings"):
        assert ids_of(store.read(name)) == left, name
    assert {p.name for p in (tmp_path / "data/frames").iterdir()} == {f"{k}.jpg" for k in left}
    assert engine.purge_app("bank", 2, remover) == 0 and store.read("settings").count() == 0  # no progress, not done
    (tmp_path / "data/frames/9.jpg/locked").rmdir()
    (tmp_path / "data/frames/9.jpg").rmdir()
    assert engine.purge_app("bank", 2, remover) == 1 and store.read("settings").count() == 1 and engine.purge_app("bank") == 0

    # Frames that are deleted stay so when their batch comes again.
    frames = some_frames(spark, [0, 1, 100])[0]
    st.ingest_plain(store, frames, spark.createDataFrame([(0, "x"), (100, "y")], "frame_id long, raw_text string"), 5, "again")
    assert ids_of(store.read("frames")) == ids_of(store.read("frame_text")) == [1, 2, 4, 5, 7, 8, 10, 11, 100]

    window = ts.within(store.read("frames"), 4 * DAY_MS, 6 * DAY_MS)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert ids_of(window) == [4, 5] and plan.count("GreaterThanOrEqual(day,4)") >= 1  # the deletions of other days are skipped

    store.forget_deleted()
    assert store.deletions() == [] and "Join" not in store.read("frames")._jdf.queryExecution().executedPlan().toString()
    for name, want in (("frames", 9), ("frame_text", 9), ("embeddings", 8)):
        assert store.read(name).count() == want


def test_retention_with_files(spark, tmp_path):
    store = filled(spark, tmp_path)
    engine = Engine(store)
    assert engine.sweep_retention(10 * DAY_MS, 0, lambda p: [True] * len(p)) == 0 and store.deletions() == []
    assert engine.sweep_retention(10 * DAY_MS, 5, lambda p: [not x.endswith("/1.jpg") for x in p], 3) == 2
    assert ids_of(store.read("frames")) == [1, *range(3, 12)]
    engine.delete_frames(spark.createDataFrame([(4,), (4,), (99,)], "frame_id long"))
    assert ids_of(store.read("jobs")) == [1, 3, *range(5, 12)] and store.deleted().count() == 3


def test_index_after_deletions_scores_as_one_made_anew(spark, tmp_path):
    store = filled(spark, tmp_path, range(20))
    engine = Engine(store)
    engine.index_texts()
    engine.delete_frames(spark.createDataFrame([(k,) for k in (3, 7, 10)], "frame_id long"))
    assert engine.indexes() == {}
    want = [tuple(r) for r in engine.search("heron owl", 30).collect()]
    engine.index_texts()
    assert set(engine.indexes()) == {"content_text", "raw_text"}
    got = [tuple(r) for r in engine.search("heron owl", 30).collect()]
    assert got == want and len(got) == 12 and not {r[0] for r in got} & {3, 7, 10}


def test_queue_steps_over_a_store(spark, tmp_path):
    store = filled(spark, tmp_path)
    engine = Engine(store)
    before = files_of(f"{tmp_path}/s/jobs")
    taken = engine.claim_jobs(["embed_text"], 2, 10)
    assert sorted(r.job_id for r in taken.collect()) == [1, 2] and {r.state for r in taken.collect()} == {"running"}
    assert sorted(r.job_id for r in engine.claim_jobs(["embed_text"], 2, 10).collect()) == [3, 4]  # never the same job twice
    assert engine.claim_jobs([], 2, 10).count() == 0 and engine.sweep_stale(20, 15) == 0
    engine.complete_jobs([1], 12)
    engine.fail_jobs([2], "no", 12, 500)
    engine.fail_jobs([3], "no", 12)
    with pytest.raises(LookupError):
        engine.complete_jobs([1], 13)
    assert engine.sweep_stale(30, 20) == 1
    got = states(store)
    assert [got[k] for k in (1, 2, 3, 4)] == ["done", "pending", "dead", "pending"] and len(got) == 12
    assert store.versions("jobs") == [] and before <= files_of(f"{tmp_path}/s/jobs")
    engine.enqueue_vision(40, start=0, end=3 * DAY_MS)
    assert store.read("jobs").where("kind = 'vision_tag'").count() == 3 and len(states(store)) == 15

    def lost(jobs):
        raise OSError("the worker is gone")

    with pytest.raises(OSError):
        engine.work(["vision_tag"], 50, lost, 2)
    assert store.read("jobs").where("kind = 'vision_tag' AND state = 'running'").count() == 2  # for the sweep
    assert engine.sweep_stale(50, 0) == 2


def test_a_batch_run_again_keeps_the_jobs_that_were_taken(spark, tmp_path):
    store = filled(spark, tmp_path, range(4))
    Engine(store).claim_jobs(["embed_text"], 1, 10)
    Engine(store).complete_jobs([1], 11)
    frames = some_frames(spark, [0, 2])[0]
    st.ingest_plain(store, frames, spark.createDataFrame([(0, "x"), (2, "y")], "frame_id long, raw_text string"), 12, "b0")
    jobs = store.read("jobs").collect()
    assert sorted(j.frame_id for j in jobs) == [0, 1, 2, 3] and len({j.job_id for j in jobs}) == 4
    assert {j.frame_id: j.state for j in jobs} == {0: "done", 1: "pending", 2: "pending", 3: "pending"}


def old_store(spark, path, version):
    """A store as a build of an older schema left it."""
    frames = [(k, DAY_MS * k, 0, 1, 1, f"frames/{k}.jpg", "h", "ed", None, None, None) for k in range(3)]
    spark.createDataFrame(frames, schema.FRAMES).withColumn("day", F.col("frame_id").cast("int")).write.partitionBy("day").parquet(f"{path}/frames/v1")
    if version < 3:
        spark.createDataFrame([(0, "zero", 0.9, "e"), (1, None, 0.1, "e"), (2, "two", 0.9, "e")], "frame_id long, text string, mean_confidence double, engine string").write.parquet(f"{path}/ocr_text/v1")
    else:
        spark.createDataFrame([(0, "zero")], "frame_id long, raw_text string").write.parquet(f"{path}/frame_text/v1")
        spans = spark.createDataFrame([(0, 0, "zero", 0.5)], "frame_id long, span_index int, text string, x float")
        spans.withColumn("day", F.lit(0)).write.partitionBy("day").parquet(f"{path}/text_spans/v1")
    spark.range(1).write.parquet(f"{path}/_schema/v{version}")


def test_older_stores_are_brought_up(spark, tmp_path, monkeypatch):
    for version in (1, 2, 3):
        path = f"file://{tmp_path}/s{version}"
        old_store(spark, path, version)
        store = Store(spark, path)
        assert store.schema_version() == schema.SCHEMA_VERSION
        assert ts.within(store.read("frames"), DAY_MS, 2 * DAY_MS).count() == 1
        if version < 3:
            got = {r.frame_id: (r.raw_text, r.content_text, r.filter_version, r.primary_source) for r in store.read("frame_text").collect()}
            assert got == {0: ("zero", "zero", 0, "ocr"), 1: ("", "", 0, "ocr"), 2: ("two", "two", 0, "ocr")}
        else:
            assert [(r.line_index, r.text) for r in store.read("text_spans").collect()] == [(0, "zero")]
        versions = store.versions("frame_text"), store.versions("text_spans")
        assert (Store(spark, path).versions("frame_text"), store.versions("text_spans")) == versions  # nothing left to do

    # Lost between the table and the marker: the step runs again and doubles nothing.
    path = f"file://{tmp_path}/lost"
    old_store(spark, path, 2)
    with monkeypatch.context() as m:
        m.setattr(Store, "mark_schema", lambda self, version: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Store(spark, path)
    store = Store(spark, path)
    assert store.read("frame_text").count() == 3 and store.versions("frame_text") == [1, 2] and store.schema_version() == 4
    assert Store(spark, f"file://{tmp_path}/new").schema_version() == schema.SCHEMA_VERSION


def test_the_fewest_sums_cover_all_batches():
    n = 1000
    sums = {(a, a + w - 1) for w in (2, 4, 8, 16, 32, 64, 128, 256, 512) for a in range(1, n + 1, w) if a + w - 1 <= n}
    assert len(cover(n, sums)) == bin(n).count("1") == 6
    for without in (1, 2, 500, 512, 513, 999, 1000):
        got = cover(n, sums, without)
        assert [k for a, b in got for k in range(a, b + 1)] == [k for k in range(1, n + 1) if k != without] and len(got) <= 20
    assert cover(3, set()) == [(1, 1), (2, 2), (3, 3)] and cover(0, set()) == [] and cover(1, set(), 1) == []


def test_sightings_are_summed_by_twos(spark, tmp_path):
    store, name = Store(spark, f"file://{tmp_path}/s"), "chrome_text_catalog"
    seen = lambda rows: spark.createDataFrame([(s, "ed", "0,0", s, n, t, t + 1, False) for s, n, t in rows], schema.CATALOG)
    merge = lambda rows: st._added_up(rows, 4)
    whole = lambda without=None: {r.signature: (r.seen_count, r.first_seen_at, r.last_seen_at, r.suppressed) for r in st._added_up(store.read(name, without), 4).collect()}
    summed = lambda without=None: {r.signature: (r.seen_count, r.first_seen_at, r.last_seen_at, r.suppressed) for r in st.catalog(store, 4, without).collect()}
    for k in range(1, 6):
        store.append(name, seen([("a", k, k), (f"own{k}", 1, k)]), f"b-{k}")
        assert summed() == whole()  # not summed yet
        store.sum_up(name, f"b-{k}", merge)
    assert sorted(store._sums(name)) == [(1, 2), (1, 4), (3, 4)] and summed() == whole() and summed()["a"] == (15, 1, 6, True)
    assert len(store.partly_summed(name).inputFiles()) < len(store.read(name).inputFiles())
    for k in (1, 3, 5):
        assert summed(f"b-{k}") == whole(f"b-{k}") and summed(f"b-{k}")["a"][0] == 15 - k
    store.append(name, seen([("a", 100, 0)]), "b-3")  # a batch comes again with other rows
    assert sorted(store._sums(name)) == [(1, 2)] and summed() == whole() and summed()["a"] == (112, 0, 6, True)
    store.sum_up(name, "b-3", merge)
    assert sorted(store._sums(name)) == [(1, 2), (1, 4), (3, 4)] and summed() == whole()
    store.append(name, seen([("a", 50, 9)]), "b-1")  # lost before it was summed: others go on without its sum
    for k in (6, 7, 8):
        store.append(name, seen([("a", k, k)]), f"b-{k}")
        store.sum_up(name, f"b-{k}", merge)
    assert sorted(store._sums(name)) == [(1, 8), (3, 4), (5, 6), (5, 8), (7, 8)] and summed() == whole()
    store.compact(name)
    assert store._sums(name) == [] and summed() == whole()
