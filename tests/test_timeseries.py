import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import insights
from tidemark.operators import timeseries as ts
from tidemark.schema import DAY_MS, MAX_MS, MIN_MS


def frames(spark, times, apps=None, labels=None):
    rows = [(k, t, f"frames/{t}.jpg", (apps or {}).get(k), (labels or {}).get(k)) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "frame_id long, captured_at long, image_path string, app_hint string, activity_type string")


def at(df):
    return [r.captured_at for r in df.collect()]


def test_buckets_are_half_open_and_sparse(spark):
    f = frames(spark, [10, 20, 120, -5, 200])
    assert [tuple(r) for r in ts.timeline_buckets(f, 0, 200, 4).collect()] == [(0, 50, 2), (100, 150, 1)]
    assert [r.n for r in ts.timeline_buckets(f, 0, 200, 4, fill_gaps=True).collect()] == [2, 0, 1, 0]
    assert ts.timeline_buckets(f, 200, 0, 4).count() == ts.timeline_buckets(f, 0, 200, 0).count() == ts.timeline_buckets(f, MIN_MS, MAX_MS, 4).count() == 0
    (row,) = ts.timeline_buckets(f, 0, MAX_MS, 1).collect()
    assert row.n == 4 and row.end > row.start


def test_insights(spark):
    f = frames(spark, [1, 2, 3, 4, 5], {0: "a", 1: "a", 2: "a", 3: "b"}, {0: "coding", 1: "email"})
    assert tuple(insights.totals(f, 0, 10).first()) == (5, 2)
    assert [tuple(r) for r in insights.top_apps(f, 0, 10).collect()] == [("a", 3), (None, 1), ("b", 1)]
    assert tuple(insights.totals(f, 50, 60).first()) == (0, 0)
    assert set(insights.summary(f, 0, 10, 2)) == {"totals", "captures", "top_apps", "activity"}


@pytest.mark.parametrize("n,limit,want", [(12, 4, [0, 30, 60, 90]), (3, 10, [0, 10, 20])])
def test_even_sample(spark, n, limit, want):
    assert at(ts.sample_frames(frames(spark, [10 * k for k in range(n)]), 0, 1000, limit)) == want


def test_even_sample_takes_exactly_the_limit(spark):
    rng = random.Random(1)
    f = frames(spark, [rng.randrange(5 * DAY_MS) for _ in range(341)]).repartition(3)
    for limit in (1, 40, 340, 341, 500):
        got = at(ts.sample_frames(f, 0, 5 * DAY_MS, limit))
        assert len(got) == min(341, limit) and got == sorted(got)
    assert ts.sample_frames(f, 0, 10, 0).count() == ts.sample_frames(f, 10, 0, 5).count() == 0


def test_nearest(spark):
    f = frames(spark, [100, 200, 400])
    assert at(ts.nearest_frame(f, 300)) == [400] and at(ts.nearest_frame(f, 290)) == [200]
    g = frames(spark, [100, 500, 900])
    assert at(ts.nearest_frame(g, 890, 400, 800)) == [500] and at(ts.nearest_frame(g, 890, 600, 800)) == []


def test_nearest_for_many_anchors_against_brute_force(spark):
    rng = random.Random(2)
    times = [rng.randrange(-50, 900) for _ in range(60)]
    anchors = [(k, rng.randrange(-200, 1200)) for k in range(80)]
    got = ts.nearest_for(spark.createDataFrame(anchors, "anchor_id long, at long"), frames(spark, times), width=100).collect()
    for r in got:
        want = min(((abs(t - r.at), t < r.at, k) for k, t in enumerate(times)))
        assert r.frame_id == want[2]
    assert len(got) == 80
    none = ts.nearest_for(spark.createDataFrame(anchors, "anchor_id long, at long"), frames(spark, [5]).limit(0), width=100).collect()
    assert len(none) == 80 and all(r.frame_id is None for r in none)


def test_neighbours(spark):
    f = frames(spark, [100 * k for k in range(1, 8)])
    assert at(ts.neighbour_frames(f, 400, MAX_MS, 2)) == [200, 300, 500, 600]
    assert at(ts.neighbour_frames(f, 400, 100, 2)) == [300, 500]


def test_ranges_and_retention(spark):
    f = frames(spark, [100, 200, 300, 400], {0: "Mail", 1: "MAIL", 2: "É", 3: "é"})
    assert at(ts.frames_in_range(f, 150, 350, 10)) == [300, 200] and ts.frames_in_range(f, 350, 150, 10).count() == 0
    assert at(ts.frames_by_app(f, "mail", 10)) == [100, 200] and at(ts.frames_by_app(f, "é", 10)) == [400] and ts.frames_by_app(f, "", 10).count() == 0
    assert at(ts.frames_older_than(f, 300, 10)) == [100, 200]
    assert ts.retention_candidates(f, 10**12, 0).count() == 0 and ts.retention_candidates(f, 10**12, 1).count() == 4


def test_day_predicate_prunes(spark, tmp_path):
    frames(spark, [5, DAY_MS + 5, 2 * DAY_MS + 5]).withColumn("day", F.floor(F.col("captured_at") / DAY_MS)).write.partitionBy("day").parquet(f"{tmp_path}/f")
    df = ts.within(spark.read.parquet(f"{tmp_path}/f"), DAY_MS, DAY_MS + 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "PartitionFilters: [isnotnull(day" in plan
