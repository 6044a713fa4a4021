"""Browsing, aggregates and the job queue over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import insights, queue
from tidemark.operators import timeseries as ts
from tidemark.schema import DAY_MS
from tidemark.sources import tables as src

#: The days that the queries look at, and moments within them.
START, END = 1_704_067_200_000, 1_706_659_200_000
MIDDLE = START + 15 * DAY_MS + 7 * 3_600_000
NOW = 900_000_000_000


def over(*loaders):
    """A query from a function of the named tables."""

    def wrap(fn):
        return lambda spark, sf_dir: fn(*(load(spark, sf_dir) for load in loaders))

    return wrap


def vision(spark, sf_dir):
    """Frames with an activity label count as analysed."""
    return src.frames(spark, sf_dir).where("activity_type IS NOT NULL AND frame_id % 2 = 0").select("frame_id", F.concat(F.lit("about "), "activity_type").alias("description"), "activity_type", "app_hint", F.lit(0.5).cast("float").alias("confidence"), F.lit("m").alias("model"))


VISION_SQL = "SELECT frame_id, 'about ' || activity_type AS description, activity_type, app_hint FROM frames WHERE activity_type IS NOT NULL AND frame_id % 2 = 0"
META = ", ".join(ts.META)
WITH = f"WITH {src.WITH}, vision AS ({VISION_SQL})"


def spans(spark, sf_dir):
    """One span per line of a text; short lines aren't searchable."""
    lines = src.frame_text(spark, sf_dir).select("frame_id", F.posexplode(F.split("content_text", "\n")).alias("line_index", "text"))
    return lines.withColumn("is_searchable", F.char_length("text") >= 48)


def detail(frames, text, vision, tags):
    d = insights.frame_detail(frames, text, vision, tags, 42)
    return d.select("frame_id", "captured_at", "app_hint", "activity_type", "content_text", "primary_source", F.col("vision.description").alias("description"), F.array_join("tags", ",").alias("tags"))


def delete_tenth(frames, text, jobs):
    left = queue.cascade_delete({"frames": frames, "frame_text": text, "jobs": jobs}, frames.where("frame_id % 10 = 3"))
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def newer_labels(frames):
    rows = frames.where("frame_id % 7 = 0").select("frame_id", F.lit("reading").alias("activity_type"), F.lit(1).alias("seq"))
    rows = rows.unionByName(frames.where("frame_id % 14 = 0").select("frame_id", F.lit("chat").alias("activity_type"), F.lit(2).alias("seq")))
    return queue.upsert(frames.select("frame_id", "activity_type"), rows, ["frame_id"])


anchors_and_others = lambda frames: ts.nearest_for(frames.where("app_hint = 'purchase'").select(F.col("frame_id").alias("anchor_id"), F.col("captured_at").alias("at")), frames.where("app_hint IS NULL"))
by_day = lambda frames: ts.ranked(frames.withColumn("period", F.floor(F.col("captured_at") / DAY_MS)), ["period"]).where(ts.is_sampled(F.col("rank"), F.col("total"), 40)).select("period", *ts.META)

F_, T_, J_, V_, G_ = src.frames, src.frame_text, src.jobs, vision, src.frame_tags
running = lambda jobs: jobs.where("state = 'running' AND job_id % 2 = 0").select("job_id")
WIDTH = ts.bucket_width(START, END, 240)

QUERIES = {
    "frames_in_range": over(F_)(lambda f: ts.frames_in_range(f, START + DAY_MS, END - DAY_MS, 500)),
    "frames_older_than": over(F_)(lambda f: ts.frames_older_than(f, MIDDLE, 1000)),
    "retention_candidates": over(F_)(lambda f: ts.retention_candidates(f, END, 20)),
    "frames_by_app_nocase": over(F_)(lambda f: ts.frames_by_app(f, "CliCK", 256)),
    "get_frame_detail": over(F_, T_, V_, G_)(detail),
    "enrichment_input": over(F_, T_)(lambda f, t: insights.enrichment_input(f, t, 42)),
    "content_texts_bulk": over(F_, T_)(lambda f, t: insights.content_texts(t, f.where("app_hint = 'click'"))),
    "timeline_buckets": over(F_)(lambda f: ts.timeline_buckets(f, START, END, 240)),
    "timeline_buckets_dense": over(F_)(lambda f: ts.timeline_buckets(f, START - 5 * DAY_MS, END, 240, fill_gaps=True)),
    "insights_totals": over(F_)(lambda f: insights.totals(f, START, END)),
    "insights_top_apps": over(F_)(lambda f: insights.top_apps(f, START, END)),
    "insights_activity": over(F_)(lambda f: insights.activity_breakdown(f, START, END)),
    "insights_shares": over(F_)(lambda f: insights.shares(insights.activity_breakdown(f, START, END))),
    "sample_even": over(F_)(lambda f: ts.sample_frames(f, START, END, 96)),
    "sample_even_per_period": over(F_)(by_day),
    "nearest_frame": over(F_)(lambda f: ts.nearest_frame(f, MIDDLE)),
    "nearest_frame_in_range": over(F_)(lambda f: ts.nearest_frame(f, MIDDLE, MIDDLE + DAY_MS, END)),
    "nearest_batch": over(F_)(anchors_and_others),
    "neighbour_frames": over(F_)(lambda f: ts.neighbour_frames(f, MIDDLE, 30 * 60_000, 12)),
    "untagged_frames": over(F_, V_, J_)(lambda f, v, j: insights.untagged_frames(f, v, j, 1000, START, END)),
    "text_filter_stats": over(spans, T_)(lambda s, t: insights.suppression_stats(s, t, 2)),
    "job_stats": over(J_)(queue.stats),
    "pending_vision_count": over(J_)(queue.pending_vision),
    "claim_jobs": over(J_)(lambda j: queue.claim(j, ["vision_tag", "embed_text"], 500, NOW).select("job_id", "state", "updated_at")),
    "fail_jobs": over(J_)(lambda j: queue.fail(j, running(j), "lost", NOW, NOW + 5000).select("job_id", "state", "attempts", "not_before", "last_error", "updated_at")),
    "complete_jobs": over(J_)(lambda j: queue.complete(j, running(j), NOW).select("job_id", "state", "updated_at")),
    "reset_stale": over(J_)(lambda j: queue.reset_stale(j, NOW, 60 * DAY_MS).select("job_id", "state", "attempts", "updated_at")),
    "backoff_schedule": over(J_)(lambda j: j.select("job_id", queue.backoff_ms(F.col("job_id") % 20).alias("ms"))),
    "upsert_latest": over(F_)(newer_labels),
    "cascade_delete": over(F_, T_, J_)(delete_tenth),
}

RANK = "row_number() OVER ({p}ORDER BY captured_at, frame_id) - 1 AS r, count(*) OVER ({q}) AS total"
CHANGED = "(state = 'running' AND job_id % 2 = 0)"
BUCKET = f"(captured_at - {START}) // {WIDTH}"
DENSE_START = START - 5 * DAY_MS
DENSE_WIDTH = ts.bucket_width(DENSE_START, END, 240)

ORACLES = {
    "frames_in_range": f"{WITH} SELECT {META} FROM frames WHERE captured_at >= {START + DAY_MS} AND captured_at < {END - DAY_MS} ORDER BY captured_at DESC, frame_id DESC LIMIT 500",
    "frames_older_than": f"{WITH} SELECT {META} FROM frames WHERE captured_at < {MIDDLE} ORDER BY captured_at, frame_id LIMIT 1000",
    "retention_candidates": f"{WITH} SELECT {META} FROM frames WHERE captured_at < {END - 20 * DAY_MS} ORDER BY captured_at, frame_id LIMIT 1000",
    "frames_by_app_nocase": f"{WITH} SELECT {META} FROM frames WHERE lower(app_hint) = 'click' ORDER BY captured_at, frame_id LIMIT 256",
    "get_frame_detail": f"{WITH} SELECT f.frame_id, captured_at, f.app_hint, f.activity_type, content_text, primary_source, description, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM frame_tags t WHERE t.frame_id = f.frame_id), '') AS tags FROM frames f LEFT JOIN frame_text USING (frame_id) LEFT JOIN vision USING (frame_id) WHERE f.frame_id = 42",
    "enrichment_input": f"{WITH} SELECT frame_id, image_path, content_text AS text FROM frames LEFT JOIN frame_text USING (frame_id) WHERE frame_id = 42",
    "content_texts_bulk": f"{WITH} SELECT frame_id, content_text AS text FROM frame_text WHERE content_text <> '' AND frame_id IN (SELECT frame_id FROM frames WHERE app_hint = 'click')",
    "timeline_buckets": f"{WITH} SELECT {BUCKET} * {WIDTH} + {START} AS start, least({BUCKET} * {WIDTH} + {START + WIDTH}, {END}) AS \"end\", count(*) AS n FROM frames WHERE captured_at >= {START} AND captured_at < {END} GROUP BY {BUCKET}",
    "timeline_buckets_dense": f"{WITH} SELECT b * {DENSE_WIDTH} + {DENSE_START} AS start, least(b * {DENSE_WIDTH} + {DENSE_START + DENSE_WIDTH}, {END}) AS \"end\", count(captured_at) AS n FROM (SELECT unnest(generate_series(0, {(END - DENSE_START - 1) // DENSE_WIDTH})) AS b) LEFT JOIN frames ON (captured_at - {DENSE_START}) // {DENSE_WIDTH} = b AND captured_at >= {DENSE_START} AND captured_at < {END} GROUP BY b",
    "insights_totals": f"{WITH} SELECT count(*) AS total, count(activity_type) AS tagged FROM frames WHERE captured_at >= {START} AND captured_at < {END}",
    "insights_top_apps": f"{WITH} SELECT app_hint, count(*) AS n FROM frames WHERE captured_at >= {START} AND captured_at < {END} GROUP BY app_hint ORDER BY n DESC, app_hint NULLS FIRST LIMIT 12",
    "insights_activity": f"{WITH} SELECT activity_type, count(*) AS n FROM frames WHERE captured_at >= {START} AND captured_at < {END} AND activity_type IS NOT NULL GROUP BY activity_type ORDER BY n DESC, activity_type LIMIT 12",
    "insights_shares": f"{WITH} SELECT activity_type, n, n / max(n) OVER () AS of_max, n / sum(n) OVER () AS of_sum FROM (SELECT activity_type, count(*) AS n FROM frames WHERE activity_type IS NOT NULL AND captured_at >= {START} AND captured_at < {END} GROUP BY activity_type)",
    "sample_even": f"{WITH} SELECT {META} FROM (SELECT *, {RANK.format(p='', q='')} FROM frames WHERE captured_at >= {START} AND captured_at < {END}) WHERE r = 0 OR r * 96 // total <> (r - 1) * 96 // total",
    "sample_even_per_period": f"{WITH} SELECT period, {META} FROM (SELECT *, {RANK.format(p='PARTITION BY period ', q='PARTITION BY period')} FROM (SELECT *, captured_at // {DAY_MS} AS period FROM frames)) WHERE r = 0 OR r * 40 // total <> (r - 1) * 40 // total",
    "nearest_frame": f"{WITH} SELECT {META} FROM frames ORDER BY abs(captured_at - {MIDDLE}), captured_at < {MIDDLE}, frame_id LIMIT 1",
    "nearest_frame_in_range": f"{WITH} SELECT {META} FROM frames WHERE captured_at >= {MIDDLE + DAY_MS} AND captured_at < {END} ORDER BY abs(captured_at - {MIDDLE}), captured_at < {MIDDLE}, frame_id LIMIT 1",
    "nearest_batch": f"{WITH}, others AS (SELECT frame_id, captured_at FROM frames WHERE app_hint IS NULL), around AS (SELECT a.frame_id AS anchor_id, a.captured_at AS t, n.frame_id AS nid, n.captured_at AS nt, p.frame_id AS pid, p.captured_at AS pt FROM frames a ASOF LEFT JOIN others n ON a.captured_at <= n.captured_at ASOF LEFT JOIN others p ON a.captured_at > p.captured_at WHERE a.app_hint = 'purchase') SELECT anchor_id, t AS \"at\", CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nid ELSE pid END AS frame_id, CASE WHEN pt IS NULL OR nt - t <= t - pt THEN nt ELSE pt END AS captured_at FROM around",
    "neighbour_frames": f"{WITH} SELECT * FROM (SELECT {META} FROM frames WHERE captured_at >= {MIDDLE - 30 * 60_000} AND captured_at < {MIDDLE} ORDER BY captured_at DESC, frame_id DESC LIMIT 12) UNION ALL SELECT * FROM (SELECT {META} FROM frames WHERE captured_at > {MIDDLE} AND captured_at <= {MIDDLE + 30 * 60_000} ORDER BY captured_at, frame_id LIMIT 12)",
    "untagged_frames": f"{WITH} SELECT frame_id, captured_at FROM frames f WHERE captured_at >= {START} AND captured_at < {END} AND NOT EXISTS (SELECT 1 FROM vision v WHERE v.frame_id = f.frame_id) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.frame_id = f.frame_id AND kind = 'vision_tag' AND state IN ('pending', 'running', 'dead')) ORDER BY captured_at, frame_id LIMIT 1000",
    "text_filter_stats": f"{WITH}, s AS (SELECT target_app, unnest(string_split(content_text, chr(10))) AS line FROM frame_text WHERE filter_version = 2) SELECT target_app, count(*) AS total_spans, count(*) FILTER (length(line) < 48) AS suppressed_spans, CAST(count(*) FILTER (length(line) < 48) / count(*) AS FLOAT) AS rate FROM s GROUP BY target_app",
    "job_stats": f"{WITH} SELECT " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("pending", "running", "done", "failed", "dead")) + " FROM jobs",
    "pending_vision_count": f"{WITH} SELECT count(*) AS n FROM jobs WHERE kind = 'vision_tag' AND state IN ('pending', 'running')",
    "claim_jobs": f"{WITH}, taken AS (SELECT job_id FROM jobs WHERE state = 'pending' AND not_before <= {NOW} AND kind IN ('vision_tag', 'embed_text') ORDER BY priority DESC, job_id LIMIT 500) SELECT job_id, CASE WHEN job_id IN (FROM taken) THEN 'running' ELSE state END AS state, CASE WHEN job_id IN (FROM taken) THEN {NOW} ELSE updated_at END AS updated_at FROM jobs",
    "fail_jobs": f"{WITH} SELECT job_id, CASE WHEN NOT {CHANGED} THEN state WHEN attempts + 1 < max_attempts THEN 'pending' ELSE 'dead' END AS state, attempts + CASE WHEN {CHANGED} THEN 1 ELSE 0 END AS attempts, CASE WHEN {CHANGED} AND attempts + 1 < max_attempts THEN {NOW + 5000} ELSE not_before END AS not_before, CASE WHEN {CHANGED} THEN 'lost' ELSE last_error END AS last_error, CASE WHEN {CHANGED} THEN {NOW} ELSE updated_at END AS updated_at FROM jobs",
    "complete_jobs": f"{WITH} SELECT job_id, CASE WHEN {CHANGED} THEN 'done' ELSE state END AS state, CASE WHEN {CHANGED} THEN {NOW} ELSE updated_at END AS updated_at FROM jobs",
    "reset_stale": f"{WITH}, s AS (SELECT *, state = 'running' AND updated_at <= {NOW - 60 * DAY_MS} AS stale FROM jobs) SELECT job_id, CASE WHEN stale THEN 'pending' ELSE state END AS state, attempts, CASE WHEN stale THEN {NOW} ELSE updated_at END AS updated_at FROM s",
    "backoff_schedule": f"{WITH} SELECT job_id, CAST(least(1000 * pow(2, least(job_id % 20, 16)), 60000) AS BIGINT) AS ms FROM jobs",
    "upsert_latest": f"{WITH} SELECT frame_id, CASE WHEN frame_id % 14 = 0 THEN 'chat' WHEN frame_id % 7 = 0 THEN 'reading' ELSE activity_type END AS activity_type FROM frames",
    "cascade_delete": f"{WITH}, gone AS (SELECT frame_id FROM frames WHERE frame_id % 10 = 3) SELECT 'frames' AS name, count(*) AS n FROM frames WHERE frame_id NOT IN (FROM gone) UNION ALL SELECT 'frame_text', count(*) FROM frame_text WHERE frame_id NOT IN (FROM gone) UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE frame_id IS NULL OR frame_id NOT IN (FROM gone)",
}
