"""Report planning and packing over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.timeseries import bucket_width
from tidemark.plans import report as rp
from tidemark.queries.browse import END, START, over
from tidemark.queries.browse import WITH as BROWSE
from tidemark.schema import DAY_MS
from tidemark.sources import tables as src

PERIODS = rp.grid_size(START, END)
WIDTH = bucket_width(START, END, PERIODS)
BATCH, PACK = 600, 800


def depth(frames):
    counts = frames.groupBy(F.expr(f"(captured_at - {START}L) div {WIDTH}L").alias("period")).agg(F.count("*").alias("n"))
    return rp.plan_depth(counts, 40, 200)


def turns(spark, sf_dir):
    return src.read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text", F.format_string("conversation %d", "conv_id").alias("label"))


def batched(turns):
    return rp.batch_labels(rp.batches(turns, BATCH, "conv_id", ["turn"]), "conv_id").select("conv_id", "turn", "batch", "label")


QUERIES = {
    "plan_depth": over(src.frames)(depth),
    "report_coverage_groups": over(src.frames, src.frame_text)(lambda f, t: rp.coverage_groups(f, t, START, END)),
    "report_batches": over(turns)(batched),
    "pack_context": over(turns)(lambda t: rp.pack_context(t, PACK, "conv_id", ["turn"]).select("conv_id", "turn", "cost", "cut")),
}

COUNTS = f"counts AS (SELECT (captured_at - {START}) // {WIDTH} AS period, count(*) AS n FROM frames GROUP BY 1), quotas AS (SELECT period, n, least(greatest(CASE WHEN count(*) OVER () * 40 <= 200 THEN 40 ELSE greatest(200 // count(*) OVER (), 3) END, 3), n) AS quota FROM counts)"
TURNS = "turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, strlen(trim(text)) // 2 + 7 AS cost FROM conversations WHERE trim(text) <> '')"

ORACLES = {
    "plan_depth": f"{BROWSE}, {COUNTS} SELECT period, n, quota FROM quotas",
    "report_coverage_groups": f"{BROWSE}, {COUNTS}, placed AS (SELECT frame_id, captured_at, period, quota, n, row_number() OVER (PARTITION BY period ORDER BY captured_at, frame_id) - 1 AS r FROM (SELECT frame_id, captured_at, (captured_at - {START}) // {WIDTH} AS period FROM frames) JOIN quotas USING (period)) SELECT period, 'day ' || (period * {WIDTH} // {DAY_MS} + 1) AS label, frame_id, captured_at, content_text AS text FROM placed JOIN frame_text USING (frame_id) WHERE (r = 0 OR r * quota // n <> (r - 1) * quota // n) AND trim(content_text) <> ''",
    "report_batches": f"WITH RECURSIVE {TURNS}, fold AS (SELECT conv_id, turn, place, cost AS spent, 0 AS batch FROM turns WHERE place = 1 UNION ALL SELECT t.conv_id, t.turn, t.place, CASE WHEN f.spent + t.cost > {BATCH} THEN t.cost ELSE f.spent + t.cost END, f.batch + CASE WHEN f.spent + t.cost > {BATCH} THEN 1 ELSE 0 END FROM fold f JOIN turns t ON t.conv_id = f.conv_id AND t.place = f.place + 1) SELECT conv_id, turn, batch, 'conversation ' || conv_id || CASE WHEN max(batch) OVER (PARTITION BY conv_id) > 0 THEN ' (part ' || (batch + 1) || ' of ' || (max(batch) OVER (PARTITION BY conv_id) + 1) || ')' ELSE '' END AS label FROM fold",
    "pack_context": f"WITH {TURNS} SELECT conv_id, turn, cost, place = 1 AND cost > {PACK} AS cut FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY place) AS spent FROM turns) WHERE spent <= {PACK} OR (place = 1 AND cost > {PACK})",
}
