"""Further commands over the given tables: summaries, scalar helpers, changes to tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.functions import text as tx
from tidemark.operators import classify as cl
from tidemark.operators import insights, queue
from tidemark.operators import retrieval as rt
from tidemark.operators import timeseries as ts
from tidemark.queries.browse import END, MIDDLE, NOW, START, over, vision
from tidemark.queries.browse import WITH as BROWSE
from tidemark.queries.search import LIMIT, X_, knn_sql, query_vector, vector_cells
from tidemark.queries.search import WITH as SEARCH
from tidemark.schema import DAY_MS
from tidemark.sources import tables as src
from tidemark.streaming import stateful as st

BUCKETS = 30
WIDTH = ts.bucket_width(START, END, BUCKETS)
BYTES = 20
DENIED = [" CLICK ", ""]


def box(x, y, w, h):
    return F.struct(*(F.expr(e).cast("double").alias(k) for k, e in zip("xywh", (x, y, w, h))))


def rectangles(frames):
    """Windows of 50 x 40 pixels here and there, on a monitor of 100 x 80."""
    rect = sc.rect_in_monitor(box("frame_id % 120 - 20", "frame_id % 90 - 10", "50", "40"), box("0", "0", "100", "80"))
    return frames.select("frame_id", rect.alias("r")).where("r IS NOT NULL").select("frame_id", "r.*")


def pixels(frames):
    r = sc.pixel_rect(box("frame_id % 130", "frame_id % 70 - 5", "40", "30"), F.expr("CAST(IF(frame_id % 9 = 0, 0, 128) AS DOUBLE)"), F.lit(64.0))
    return frames.select("frame_id", r.alias("r")).select("frame_id", "r.*")


def paths(frames):
    path = F.expr("CASE frame_id % 4 WHEN 0 THEN image_path WHEN 1 THEN '/' || image_path WHEN 2 THEN 'frames/../' || frame_id ELSE 'frames/1/' || frame_id || '.jpg' END")
    return frames.select("frame_id", sc.is_frame_path(path).alias("inside"))


def capturable(frames):
    gate = sc.may_capture(F.expr("IF(frame_id % 3 = 0, NULL, frame_id % 13 = 1)"), F.expr("frame_id % 10 = 4"), F.col("app_hint"), F.col("activity_type"), DENIED)
    return frames.where(gate).select("frame_id")


def sent_lines(spark, sf_dir):
    """Conversation turns as lines of a server-sent stream."""
    c = src.read(spark, sf_dir, "conversations")
    delta = lambda name: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias(name)).alias("delta"))).alias("choices"))))
    line = F.when(F.col("turn") % 7 == 6, "data: [DONE]").when(F.col("turn") % 5 == 4, ": note").when(F.col("role") == "user", delta("reasoning_content")).otherwise(delta("content"))
    return c.where("text IS NOT NULL").select("conv_id", "turn", line.alias("line"))


def stream_lines(spark, sf_dir):
    found = sent_lines(spark, sf_dir).select("conv_id", "turn", sc.sse_deltas(F.col("line")).alias("d")).where("d IS NOT NULL").select("conv_id", "turn", "d.*")
    return st.until_done(found, "conv_id", "turn")


#: Bytes of a line that come with the chunk before it.
EARLY = 9


def stream_chunks(spark, sf_dir):
    """The same lines in chunks that end within the next line."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = sent_lines(spark, sf_dir).withColumn("bytes", F.encode(F.concat("line", F.lit("\n")), "utf-8"))
    early = F.coalesce(F.lead(F.substring("bytes", 1, EARLY)).over(w), F.lit("").cast("binary"))
    own = F.when(F.row_number().over(w) == 1, F.col("bytes")).otherwise(F.substring("bytes", EARLY + 1, 1 << 30))
    return st.sse_pieces(rows.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat(own, early).alias("data"))).select("stream_id", "seq", "kind", "text")


def worst(jobs):
    status = F.expr("CASE state WHEN 'dead' THEN 'error' WHEN 'failed' THEN 'unavailable' WHEN 'running' THEN 'initializing' ELSE 'ready' END")
    return jobs.groupBy("frame_id").agg(F.collect_set(status).alias("s")).select("frame_id", sc.worst_status(F.col("s")).alias("status"))


def enqueued(jobs, frames):
    new = frames.where("frame_id % 5 = 2").select("frame_id", F.lit("embed_text").alias("kind"), F.col("frame_id").alias("seq"))
    return queue.numbered(jobs, new, NOW).select("job_id", "frame_id", "kind", "state", "updated_at")


def requested(jobs, frames, vision):
    free = insights.untagged_frames(frames, vision, jobs, 1000, START, END)
    return queue.tag_requests(jobs, free, NOW).where(F.col("updated_at") == NOW).select("job_id", "frame_id", "kind", "priority")


def replaced(texts):
    new = texts.where("frame_id % 4 = 1").select("frame_id", F.lit("new").alias("content_text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    return queue.replace_children(texts.select("frame_id", "content_text", F.lit(0).alias("part")), new)


def mirrored(frames, vision):
    return queue.mirror_labels(frames, vision.withColumn("activity_type", F.when(F.col("frame_id") % 3 > 0, F.col("activity_type")))).select("frame_id", "activity_type")


def routed(jobs):
    results = jobs.where("state = 'running'").select("job_id", "frame_id", "attempts", (F.col("job_id") % 3 > 0).alias("frame_exists"), F.expr("IF(job_id % 4 = 0, ' ', 'x')").alias("text"), (F.col("kind") == "vision_tag").alias("needs_image"), F.expr("CASE job_id % 7 WHEN 1 THEN 'missing' WHEN 2 THEN 'unreadable' ELSE 'ok' END").alias("image_state"), (F.col("job_id") % 5 > 0).alias("provider_ok"))
    return queue.route_outcomes(results, NOW).select("job_id", "outcome", F.coalesce("retry_at", F.lit(0)).alias("retry_at"))


def merged(frames):
    """Sightings of the first and the later days added up."""
    seen = frames.where("app_hint IS NOT NULL").groupBy(F.concat("app_hint", F.lit("/"), F.expr("captured_at div 3600000 % 24")).alias("signature"), (F.col("captured_at") < MIDDLE).alias("early")).agg(F.min("app_hint").alias("app_hint"), F.lit("0,0").alias("region_bucket"), F.min("app_hint").alias("normalized_text"), F.count("*").alias("seen_count"), F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"))
    return cl.merge_catalog(seen.where("early").drop("early"), seen.where("NOT early").drop("early"), 4).select("signature", "seen_count", "first_seen_at", "last_seen_at", "suppressed")


def images(frames, vectors):
    own = vectors.where("chunk_index = 0")
    return rt.knn(own, frames, query_vector(vectors), LIMIT).select("frame_id", F.round("distance", 6).alias("distance"), "rank")


def images_by_cells(spark, sf_dir):
    """The same with a cell index of the image vectors."""
    vectors = X_(spark, sf_dir)
    index = vector_cells(spark, vectors.where("chunk_index = 0"), "images")
    return index.knn(src.frames(spark, sf_dir), query_vector(vectors), LIMIT).select("frame_id", F.round("distance", 6).alias("distance"), "rank")


F_, T_ = src.frames, src.frame_text

QUERIES = {
    "insights_summary": over(F_)(lambda f: insights.summary_rows(f, START, END, BUCKETS)),
    "table_counts": over(F_, T_, X_, src.jobs)(lambda f, t, x, j: insights.table_counts({"frames": f, "frame_text": t, "embeddings": x, "jobs": j})),
    "apps_before_version": over(T_)(lambda t: insights.apps_before(t, 2)),
    "nearest_thumbnail": over(F_)(lambda f: insights.nearest_thumbnail(f, MIDDLE)),
    "latency_percentile": over(src.jobs)(lambda j: insights.latency_percentile(j.select((F.col("updated_at") - F.col("not_before")).alias("ms")), "ms")),
    "worst_status": over(src.jobs)(worst),
    "truncate_bytes": over(T_)(lambda t: t.select("frame_id", tx.truncate_bytes(F.col("content_text"), BYTES).alias("text"))),
    "content_hash": over(T_)(lambda t: t.select("frame_id", sc.content_hash(F.col("content_text")).alias("hash"))),
    "window_rect": over(F_)(rectangles),
    "pixel_rect": over(F_)(pixels),
    "relative_time": over(F_)(lambda f: f.select("frame_id", sc.relative_time(F.col("captured_at"), F.lit(END)).alias("said"))),
    "frame_path_guard": over(F_)(paths),
    "privacy_gate": over(F_)(capturable),
    "degenerate_windows": over(F_)(lambda f: ts.frames_in_range(f, START, START, 10).unionByName(ts.frames_in_range(f, END, START, 10)).unionByName(ts.frames_in_range(f, START, END, 0))),
    "sse_lines": stream_lines,
    "sse_chunks": stream_chunks,
    "enqueue_jobs": over(src.jobs, F_)(enqueued),
    "tag_requests": over(src.jobs, F_, vision)(requested),
    "replace_children": over(T_)(replaced),
    "mirror_labels": over(F_, vision)(mirrored),
    "route_outcomes": over(src.jobs)(routed),
    "merge_catalog": over(F_)(merged),
    "knn_images": over(F_, X_)(images),
    "knn_cells_images": images_by_cells,
}

UNIT = "least(greatest(({}) / {}.0::DOUBLE, 0), 1)"
#: The line that ends each stream.
ENDED = "ended AS (SELECT conv_id, min(turn) AS last FROM conversations WHERE text IS NOT NULL AND turn % 7 = 6 GROUP BY conv_id)"
INSIDE = f"captured_at >= {START} AND captured_at < {END}"


def summary_sql() -> str:
    top = "SELECT '{0}' AS part, {1} AS key, count(*) AS n FROM f {2} GROUP BY {1} ORDER BY n DESC, key NULLS FIRST LIMIT 12"
    parts = [
        "SELECT 'total' AS part, NULL::VARCHAR AS key, count(*) AS n FROM f",
        "SELECT 'tagged' AS part, NULL::VARCHAR AS key, count(activity_type) AS n FROM f",
        f"SELECT 'captures' AS part, CAST((captured_at - {START}) // {WIDTH} AS VARCHAR) AS key, count(*) AS n FROM f GROUP BY 2",
        f"SELECT * FROM ({top.format('app', 'app_hint', '')})",
        f"SELECT * FROM ({top.format('activity', 'activity_type', 'WHERE activity_type IS NOT NULL')})",
    ]
    return f"{BROWSE}, f AS (SELECT * FROM frames WHERE {INSIDE}) " + " UNION ALL ".join(parts)


def rect_sql() -> str:
    x, y = "(frame_id % 120 - 20)", "(frame_id % 90 - 10)"
    at = {k: UNIT.format(v, n) for k, v, n in (("x0", x, 100), ("y0", y, 80), ("x1", f"{x} + 50", 100), ("y1", f"{y} + 40", 80))}
    return f"{BROWSE} SELECT frame_id, {at['x0']} AS x, {at['y0']} AS y, {at['x1']} - {at['x0']} AS w, {at['y1']} - {at['y0']} AS h FROM frames WHERE {x} + 25 >= 0 AND {x} + 25 < 100 AND {y} + 20 >= 0 AND {y} + 20 < 80"


def pixel_sql() -> str:
    x, y, w, h = (UNIT.format(v, n) for v, n in (("frame_id % 130", 128), ("frame_id % 70 - 5", 64), ("40", 128), ("30", 64)))
    some = lambda e: f"CASE WHEN frame_id % 9 = 0 THEN 0::DOUBLE ELSE {e} END"
    return f"{BROWSE} SELECT frame_id, {some(x)} AS x, {some(y)} AS y, {some(f'least({w}, 1 - {x})')} AS w, {some(f'least({h}, 1 - {y})')} AS h FROM frames"


ORACLES = {
    "insights_summary": summary_sql(),
    "table_counts": f"{BROWSE} SELECT 'frames' AS name, count(*) AS n FROM frames UNION ALL SELECT 'frame_text', count(*) FROM frame_text UNION ALL SELECT 'embeddings', count(*) FROM vectors UNION ALL SELECT 'jobs', count(*) FROM jobs",
    "apps_before_version": f"{BROWSE} SELECT DISTINCT target_app FROM frame_text WHERE filter_version < 2 AND target_app IS NOT NULL",
    "nearest_thumbnail": f"{BROWSE} SELECT frame_id, captured_at FROM frames ORDER BY abs(captured_at - {MIDDLE}), captured_at, frame_id LIMIT 1",
    "latency_percentile": f"{BROWSE}, v AS (SELECT updated_at - not_before AS ms FROM jobs) SELECT count(*) AS n, list_sort(list(ms))[least(count(*) * 95 // 100, count(*) - 1) + 1] AS value FROM v",
    "worst_status": f"{BROWSE} SELECT frame_id, CASE min(CASE state WHEN 'dead' THEN 0 WHEN 'failed' THEN 1 WHEN 'running' THEN 2 ELSE 3 END) WHEN 0 THEN 'error' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'initializing' ELSE 'ready' END AS status FROM jobs GROUP BY frame_id",
    "truncate_bytes": f"{BROWSE} SELECT frame_id, left(content_text, list_max(list_filter(generate_series(0, {BYTES}), lambda k: strlen(left(content_text, k)) <= {BYTES}))) AS text FROM frame_text",
    "content_hash": f"{BROWSE} SELECT frame_id, sha256(content_text) AS hash FROM frame_text",
    "window_rect": rect_sql(),
    "pixel_rect": pixel_sql(),
    "relative_time": f"{BROWSE}, s AS (SELECT frame_id, captured_at, {END} - captured_at AS age FROM frames) SELECT frame_id, CASE WHEN age < 45000 THEN 'just now' WHEN age < 90000 THEN '1m ago' WHEN age < 3600000 THEN CAST(floor(age / 60000.0::DOUBLE + 0.5) AS BIGINT) || 'm ago' WHEN age < 7200000 THEN '1h ago' WHEN age < 86400000 THEN CAST(floor(age / 3600000.0::DOUBLE + 0.5) AS BIGINT) || 'h ago' WHEN age < 172800000 THEN 'yesterday' WHEN age < 604800000 THEN CAST(floor(age / 86400000.0::DOUBLE + 0.5) AS BIGINT) || 'd ago' ELSE strftime(epoch_ms(captured_at), '%b %-d, %Y') END AS said FROM s",
    "frame_path_guard": f"{BROWSE} SELECT frame_id, frame_id % 4 IN (0, 3) AS inside FROM frames",
    "privacy_gate": f"{BROWSE} SELECT frame_id FROM frames WHERE NOT (frame_id % 3 <> 0 AND frame_id % 13 = 1) AND frame_id % 10 <> 4 AND NOT coalesce(contains(lower(app_hint), 'click'), false) AND NOT coalesce(contains(activity_type, 'click'), false)",
    "degenerate_windows": f"{BROWSE} SELECT frame_id, captured_at, image_path, app_hint FROM frames WHERE false",
    "sse_lines": f"WITH {ENDED} SELECT conv_id, turn, turn % 7 = 6 AS done, turn % 7 <> 6 AND role = 'user' AS thinking, CASE WHEN turn % 7 <> 6 THEN text END AS text FROM conversations LEFT JOIN ended USING (conv_id) WHERE text IS NOT NULL AND (turn % 7 = 6 OR (turn % 5 <> 4 AND text <> '')) AND turn <= coalesce(last, turn)",
    "sse_chunks": f"WITH {ENDED} SELECT conv_id AS stream_id, turn AS seq, CASE WHEN turn % 7 = 6 THEN 'done' WHEN role = 'user' THEN 'reasoning' ELSE 'content' END AS kind, CASE WHEN turn % 7 <> 6 THEN text END AS text FROM conversations LEFT JOIN ended USING (conv_id) WHERE text IS NOT NULL AND (turn % 7 = 6 OR (turn % 5 <> 4 AND text <> '')) AND turn <= coalesce(last, turn) UNION ALL SELECT conv_id, max(turn), 'done', NULL FROM conversations WHERE text IS NOT NULL AND conv_id NOT IN (SELECT conv_id FROM ended) GROUP BY conv_id",
    "enqueue_jobs": f"{BROWSE} SELECT (SELECT max(job_id) FROM jobs) + row_number() OVER (ORDER BY frame_id) AS job_id, frame_id, 'embed_text' AS kind, 'pending' AS state, CAST({NOW} AS BIGINT) AS updated_at FROM frames WHERE frame_id % 5 = 2",
    "tag_requests": f"{BROWSE}, free AS (SELECT frame_id FROM frames WHERE {INSIDE} AND frame_id NOT IN (SELECT frame_id FROM vision) AND frame_id NOT IN (SELECT frame_id FROM jobs WHERE kind = 'vision_tag' AND state IN ('pending', 'running', 'dead') AND frame_id IS NOT NULL) ORDER BY captured_at, frame_id LIMIT 1000) SELECT (SELECT max(job_id) FROM jobs) + row_number() OVER (ORDER BY frame_id) AS job_id, frame_id, 'vision_tag' AS kind, CAST(10 AS BIGINT) AS priority FROM free",
    "replace_children": f"{BROWSE} SELECT frame_id, content_text, 0 AS part FROM frame_text WHERE frame_id % 4 <> 1 UNION ALL SELECT frame_id, 'new', p FROM frame_text, (VALUES (0), (1)) AS t(p) WHERE frame_id % 4 = 1",
    "mirror_labels": f"{BROWSE} SELECT frame_id, CASE WHEN frame_id IN (SELECT frame_id FROM vision) AND frame_id % 3 = 0 THEN NULL ELSE activity_type END AS activity_type FROM frames",
    "route_outcomes": f"""{BROWSE}, r AS (SELECT *, CASE WHEN frame_id IS NULL THEN 'dead' WHEN job_id % 3 = 0 THEN 'done' WHEN kind = 'vision_tag' AND job_id % 7 = 1 THEN 'dead' WHEN kind = 'vision_tag' AND job_id % 7 = 2 THEN 'retry'
      WHEN kind <> 'vision_tag' AND job_id % 4 = 0 THEN 'done' WHEN job_id % 5 > 0 THEN 'done' ELSE 'retry' END AS outcome FROM jobs WHERE state = 'running')
      SELECT job_id, outcome, CASE WHEN outcome = 'retry' THEN {NOW} + CAST(least(1000 * 2 ** attempts, 60000) AS BIGINT) ELSE 0 END AS retry_at FROM r""",
    "merge_catalog": f"{BROWSE} SELECT app_hint || '/' || captured_at // 3600000 % 24 AS signature, count(*) AS seen_count, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at, count(*) >= 4 AS suppressed FROM frames WHERE app_hint IS NOT NULL GROUP BY 1",
    "knn_images": f"{SEARCH}, {knn_sql('near', prefilter=True).replace('FROM vectors WHERE frame_id IN', 'FROM vectors WHERE chunk_index = 0 AND frame_id IN').replace('LIMIT 100', f'LIMIT {LIMIT}')} SELECT frame_id, round(distance, 6) AS distance, rank FROM near",
}
ORACLES["knn_cells_images"] = ORACLES["knn_images"]
