import threading

from pyspark.sql import functions as F

from tests.test_store import files_of, ids_of
from tests.test_streaming import some_frames
from tidemark.api import Engine
from tidemark.operators import queue
from tidemark.sources.tables import Store
from tidemark.streaming import stateful as st
from tidemark.streaming import worker


def filled(spark, path, n):
    store = Store(spark, f"file://{path}")
    st.ingest_plain(store, some_frames(spark, range(n))[0], spark.createDataFrame([(k, "x") for k in range(n)], "frame_id long, raw_text string"), 0, "b")
    return store


def provider(ok=True, log=None):
    def run(jobs):
        if log is not None:
            log.extend(r.job_id for r in jobs.collect())
        if ok is None:
            raise RuntimeError("out of memory")
        return jobs.select("job_id", "frame_id", "attempts", F.lit(True).alias("frame_exists"), F.lit("x").alias("text"), F.lit(False).alias("needs_image"), F.lit(None).cast("string").alias("image_state"), F.lit(ok).alias("provider_ok"))

    return run


def test_a_worker_backs_off_and_sweeps(spark, tmp_path):
    store = filled(spark, tmp_path, 3)
    pool = worker.Pool(Engine(store), {"embed_text": provider()}, batch=2)
    before, timers, now, worked = files_of(f"{tmp_path}/jobs"), worker.Timers(), 0, []
    while now < 5000:
        at = now
        timers, done = pool.tick(timers, now)
        worked.append((at, done.worked))
        now = max(timers.work, now + 1)
    assert worked[:2] == [(0, 2), (1, 1)] and all(n == 0 for _, n in worked[2:])
    waits = [b - a for (a, _), (b, _) in zip(worked[2:], worked[3:])]
    assert waits[:4] == [250, 500, 1000, 2000][: len(waits)]
    assert {r.state for r in store.read("jobs").collect()} == {"done"} and before <= files_of(f"{tmp_path}/jobs")

    # A job of a lost worker is put back after five minutes, at the next sweep without jobs running here.
    st.ingest_plain(store, some_frames(spark, [7])[0], spark.createDataFrame([(7, "x")], "frame_id long, raw_text string"), 5000, "c")
    Engine(store).claim_jobs(["embed_text"], 1, 6000)
    seen = []
    for now in range(60_000, 480_001, 60_000):
        timers, done = pool.tick(timers, now)
        seen.append((now, done.swept, done.worked))
    assert [s for s in seen if s[1]] == [(360_000, 1, 0)] and (420_000, 0, 1) in seen
    with pool._working(1):
        Engine(store).store.change("jobs", store.read("jobs").withColumn("state", F.lit("running")).withColumn("updated_at", F.lit(0).cast("long")))
        assert pool.sweep(10**9) == 0
    assert pool.sweep(10**9) == 4


def test_failures_come_again_and_end_dead(spark, tmp_path):
    store = filled(spark, tmp_path, 1)
    pool, timers, now, tried = worker.Pool(Engine(store), {"embed_text": provider(None)}), worker.Timers(), 0, []
    for now in range(0, 6001, 500):
        timers, done = pool.tick(timers, now)
        tried += [now] * done.worked
    job = store.read("jobs").first()
    assert (job.state, job.attempts, job.last_error) == ("dead", 3, "out of memory") and tried[0] == 0 and len(tried) == 3
    assert tried[1] >= 1000 and tried[2] >= tried[1] + 2000  # a second, then two
    assert worker.Pool(Engine(store), {}).work(0) == 0


def test_no_job_is_claimed_twice(spark, tmp_path):
    store, log = filled(spark, tmp_path, 12), []
    pool = worker.Pool(Engine(store), {"embed_text": provider(True, log)}, batch=2)

    def drain():
        while pool.work(10):
            pass

    threads = [threading.Thread(target=drain) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(log) == list(range(1, 13)) and {r.state for r in store.read("jobs").collect()} == {"done"}


def test_producers(spark, tmp_path):
    store = filled(spark, tmp_path, 9)
    now_set, idle = [worker.Settings()], [None]
    pool = worker.Pool(Engine(store), {}, lambda: now_set[0], lambda: idle[0])
    timers, seen = worker.Timers(), {}

    def upto(first, last):
        nonlocal timers
        for now in range(first, last, 5000):
            timers, done = pool.tick(timers, now)
            if done.queued:
                seen[now] = done.queued

    upto(0, 60_000)
    now_set[0] = worker.Settings(timer=True, interval_ms=1000, batch=2)
    upto(60_000, 190_000)
    assert seen == {60_000: 2, 120_000: 2, 180_000: 2}  # a minute at least; not the same frames again
    tags = store.read("jobs").where("kind = 'vision_tag'")
    assert ids_of(tags) == list(range(6)) and {r.priority for r in tags.collect()} == {0}

    seen.clear()
    now_set[0], idle[0] = worker.Settings(idle=True, idle_ms=1000, batch=2), 999
    upto(240_000, 300_000)
    assert seen == {} and not timers.warm
    idle[0] = 1000
    upto(300_000, 340_000)
    assert seen == {} and timers.warm  # six in flight: nothing is added, models stay
    Engine(store).claim_jobs(["vision_tag"], 99, 340_000)
    Engine(store).complete_jobs([r.job_id for r in store.read("jobs").where("kind = 'vision_tag'").collect()], 340_000)
    store.change("vision_analysis", spark.createDataFrame([(k, "d", None, None, 0.5, "m") for k in range(6)], "frame_id long, description string, activity_type string, app_hint string, confidence float, model string"))
    upto(345_000, 350_000)
    assert list(seen.values()) == [2] and timers.warm
    idle[0] = 0
    upto(400_000, 440_000)
    assert not timers.warm and queue.pending_vision(store.read("jobs")).first().n == 2


def test_a_stream_makes_the_ticks(spark, tmp_path):
    store, clock, seen = filled(spark, tmp_path / "s", 2), [0], []
    (tmp_path / "ticks").mkdir()
    ticks = spark.readStream.schema("n long").parquet(f"{tmp_path}/ticks")
    pool = worker.Pool(Engine(store), {"embed_text": provider()})
    query = worker.run(ticks, pool, lambda: clock[0], lambda timers, done: seen.append((clock[0], done.worked))).option("checkpointLocation", f"{tmp_path}/cp").start()
    for clock[0] in (0, 100, 200):
        spark.range(1).selectExpr("id AS n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        query.processAllAvailable()
    query.stop()
    assert seen == [(0, 1), (100, 1), (200, 0)] and {r.state for r in store.read("jobs").collect()} == {"done"}
