import pytest

from tidemark import schema
from tidemark.operators import queue
from tidemark.sources.tables import Store, storage_classes


@pytest.fixture
def jobs(spark):
    rows = [(1, "vision_tag", 7, "pending", 0, 0, 2, 0, None, 10), (2, "vision_tag", 8, "pending", 10, 0, 2, 0, None, 10), (3, "embed_text", 9, "pending", 0, 0, 2, 200, None, 10), (4, "embed_text", 9, "running", 0, 1, 2, 0, None, 10), (5, "embed_text", 9, "running", 0, 0, 2, 0, None, 900), (6, "vision_tag", 5, "dead", 0, 2, 2, 0, "x", 5)]
    return spark.createDataFrame(rows, schema.JOBS)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "job_id long")


def by_id(df):
    return {r.job_id: r for r in df.collect()}


def test_claim_by_priority_and_time(jobs):
    assert [r.job_id for r in queue.claimable(jobs, ["vision_tag", "embed_text"], 5, 100).collect()] == [2, 1]
    assert [r.job_id for r in queue.claimable(jobs, ["embed_text"], 5, 200).collect()] == [3]
    assert queue.claimable(jobs, [], 5, 200).count() == 0
    after = by_id(queue.claim(jobs, ["vision_tag"], 1, 100))
    assert after[2].state == "running" and after[2].updated_at == 100 and after[1].state == "pending"


def test_fail_retries_then_dies(spark, jobs):
    once = queue.fail(jobs, ids(spark, 5, 1), "lost", 1000, 1500)
    assert by_id(once)[5][3:9] == ("pending", 0, 1, 2, 1500, "lost") and by_id(once)[1].state == "pending" and by_id(once)[1].attempts == 0
    again = queue.fail(queue.claim(once, ["embed_text"], 5, 1500), ids(spark, 5), "lost", 1600, 1900)
    assert by_id(again)[5].state == "dead" and by_id(again)[5].attempts == 2
    assert by_id(queue.fail(jobs, ids(spark, 5), "lost", 1000))[5].state == "dead"


def test_only_running_jobs_finish(spark, jobs):
    assert [r.job_id for r in queue.not_running(jobs, ids(spark, 1, 4)).collect()] == [1]
    done = by_id(queue.complete(jobs, ids(spark, 1, 4), 50))
    assert done[4].state == "done" and done[1].state == "pending"


def test_stale_sweep(jobs):
    assert {k: r.state for k, r in by_id(queue.reset_stale(jobs, 1000, 500)).items() if k in (4, 5)} == {4: "pending", 5: "running"}
    swept = by_id(queue.reset_stale(jobs, 1000, 0))
    assert swept[5].state == "pending" and swept[4].attempts == 1


def test_counts_and_enqueue(spark, jobs):
    assert queue.stats(jobs).first().asDict() == {"pending": 3, "running": 2, "done": 0, "failed": 0, "dead": 1}
    assert queue.pending_vision(jobs).first().n == 2
    new = spark.createDataFrame([("embed_image", 4, 2), ("embed_text", 3, 1)], "kind string, frame_id long, seq long")
    more = by_id(queue.enqueue(jobs, new, 77))
    assert (more[7].kind, more[8].kind, more[7].state, more[7].updated_at) == ("embed_text", "embed_image", "pending", 77)


def test_upsert_replace_and_cascade(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "frame_id long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "frame_id long, v string, seq long")
    assert sorted(map(tuple, queue.upsert(table, new, ["frame_id"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, queue.replace_children(table, new.drop("seq")).collect())) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    left = queue.cascade_delete({"x": table, "y": new}, spark.createDataFrame([(2,)], "frame_id long"))
    assert [r.frame_id for r in left["x"].collect()] == [1] and [r.frame_id for r in left["y"].collect()] == [3]


def test_outcomes(spark):
    rows = [(1, None, True, "x", False, None, True, 0), (2, 1, False, "x", False, None, True, 0), (3, 1, True, " ", False, None, True, 0), (4, 1, True, "x", False, None, False, 2), (5, 1, True, None, True, "missing", True, 0), (6, 1, True, None, True, "unreadable", True, 0), (7, 1, True, None, True, "ok", True, 0)]
    df = spark.createDataFrame(rows, "job_id long, frame_id long, frame_exists boolean, text string, needs_image boolean, image_state string, provider_ok boolean, attempts int")
    got = {r.job_id: (r.outcome, r.retry_at) for r in queue.route_outcomes(df, 100).collect()}
    assert got == {1: ("dead", None), 2: ("done", None), 3: ("done", None), 4: ("retry", 4100), 5: ("dead", None), 6: ("retry", 1100), 7: ("done", None)}
    assert not queue.wants_refill(True, 5, 20) and queue.wants_refill(True, 4, 20) and not queue.wants_refill(False, 0, 20)


def test_store_versions(spark, tmp_path, jobs):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("jobs").count() == 0 and store.versions("jobs") == []
    assert (store.write("jobs", jobs), store.write("jobs", queue.reset_stale(store.read("jobs"), 1, 0))) == (1, 2)
    assert store.read("jobs").where("state = 'running'").count() == 0 and store.versions("jobs") == [1, 2]
    sizes = {r["class"]: r.n_bytes for r in storage_classes(spark, {"jobs": f"{tmp_path}/store/jobs"}).collect()}
    assert sizes["jobs"] > 0
    with pytest.raises(ValueError):
        schema.check_version(schema.SCHEMA_VERSION + 1)
