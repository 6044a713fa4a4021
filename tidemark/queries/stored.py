"""Stores made from the given tables: ingest in batches, deletions, steps of the queue, older schemas, images."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.api import Engine
from tidemark.queries.browse import NOW
from tidemark.queries.browse import WITH as BROWSE
from tidemark.sources import images
from tidemark.sources import tables as src
from tidemark.sources.tables import Store
from tidemark.streaming import stateful as st

APP, KEPT_FILE = "CLICK", 7
KINDS, CLAIMED, RETRY_AT, STALE_MS = ["embed_image", "embed_text"], 60, NOW + 5000, 1000
#: Size of the images and every how many frames one can't be read.
WIDTH, HEIGHT, BROKEN = 8, 4, 19


def new_folder(spark: SparkSession) -> str:
    return f"{src.shared_folder(spark)}/store-{uuid.uuid4().hex}"


def removed(paths: list[str]) -> list[bool]:
    """Stands in for the removal of files: some of them stay."""
    return [not p.endswith(f"{KEPT_FILE}.jpg") for p in paths]


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table when an application is purged; frames whose file stays are kept."""
    store = Store(spark, new_folder(spark))
    for name, table in (("frames", src.frames), ("frame_text", src.frame_text), ("jobs", src.jobs)):
        store.write(name, table(spark, sf_dir))
    Engine(store).purge_app(APP, deleted=removed)
    out = None
    for name in ("frames", "frame_text", "jobs"):
        own = store.read(name).select(F.lit(name).alias("name"), "frame_id")
        out = own if out is None else out.unionByName(own)
    return out


def worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after stale jobs were put back, jobs were claimed, and half of these finished and half failed."""
    store = Store(spark, new_folder(spark))
    store.write("jobs", src.jobs(spark, sf_dir))
    engine = Engine(store)
    engine.sweep_stale(NOW, STALE_MS)
    ids = [r.job_id for r in engine.claim_jobs(KINDS, CLAIMED, NOW).select("job_id").collect()]  # at most CLAIMED
    engine.complete_jobs([k for k in ids if k % 2], NOW + 1)
    engine.fail_jobs([k for k in ids if k % 2 == 0], "no answer", NOW + 2, RETRY_AT)
    return store.read("jobs").select("job_id", "state", "attempts", "not_before", "last_error")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and texts taken in by two batches, the first of them twice, with the jobs that they queued."""
    store = Store(spark, new_folder(spark))
    frames = src.frames(spark, sf_dir)
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in schema.FRAMES if f.name not in frames.columns}
    frames = frames.withColumns(lacking)
    texts = src.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("raw_text"))
    for part in (0, 0, 1):
        st.ingest_plain(store, frames.where(F.col("frame_id") % 2 == part), texts, NOW, f"part{part}")
    jobs = store.read("jobs").select("frame_id", "job_id", "kind")
    return store.read("frames").select("frame_id", "captured_at").join(store.read("frame_text").select("frame_id", "content_text", "filter_version"), "frame_id").join(jobs, "frame_id")


def brought_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a store of schema version 2, opened by this build."""
    root = new_folder(spark)
    src.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), "text").write.parquet(f"{root}/ocr_text/v1")
    spark.range(1).write.parquet(f"{root}/_schema/v2")
    return Store(spark, root).read("frame_text").select("frame_id", "raw_text", "content_text", "primary_source", "filter_version", "suppressed_count")


def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one colour each, decoded and fingerprinted."""
    colour = F.concat(*(F.lpad(F.hex(F.col("frame_id") * k % 256), 2, "0") for k in (1, 7, 13)))
    data = F.unhex(F.concat(F.hex(F.lit(f"P6 {WIDTH} {HEIGHT} 255\n")), F.expr(f"repeat(colour, {WIDTH * HEIGHT})")))
    frames = src.frames(spark, sf_dir).select("frame_id", colour.alias("colour")).select("frame_id", F.when(F.col("frame_id") % BROKEN > 0, data).alias("content"))
    sums = F.aggregate("luma", F.lit(0), lambda a, x: a + x)
    return images.with_luma(frames).select("frame_id", "width", "height", sums.cast("long").alias("luma_sum"), F.array_max("luma").alias("brightest"), "error")


QUERIES = {"purge_app": purged, "queue_steps": worked, "ingest_batches": ingested, "older_schema": brought_up, "frame_luma": luma}

GREY = "((frame_id % 256) * 77 + (frame_id * 7 % 256) * 150 + (frame_id * 13 % 256) * 29) // 256"
ORACLES = {
    "purge_app": f"""{BROWSE}, gone AS (SELECT frame_id FROM frames WHERE upper(app_hint) = '{APP}' AND frame_id % 10 <> {KEPT_FILE}) SELECT 'frames' AS name, frame_id FROM frames WHERE frame_id NOT IN (FROM gone)
      UNION ALL SELECT 'frame_text', frame_id FROM frame_text WHERE frame_id NOT IN (FROM gone) UNION ALL SELECT 'jobs', frame_id FROM jobs WHERE frame_id IS NULL OR frame_id NOT IN (FROM gone)""",
    "queue_steps": f"""{BROWSE}, swept AS (SELECT * REPLACE (CASE WHEN state = 'running' AND updated_at <= {NOW} - {STALE_MS} THEN 'pending' ELSE state END AS state) FROM jobs),
      taken AS (SELECT job_id FROM swept WHERE state = 'pending' AND not_before <= {NOW} AND kind IN ('embed_image', 'embed_text') ORDER BY priority DESC, job_id LIMIT {CLAIMED}),
      s AS (SELECT *, job_id IN (FROM taken) AS hit, job_id % 2 = 0 AS bad, attempts + 1 < max_attempts AS again FROM swept)
      SELECT job_id, CASE WHEN NOT hit THEN state WHEN NOT bad THEN 'done' WHEN again THEN 'pending' ELSE 'dead' END AS state, attempts + CASE WHEN hit AND bad THEN 1 ELSE 0 END AS attempts,
        CASE WHEN hit AND bad AND again THEN {RETRY_AT} ELSE not_before END AS not_before, CASE WHEN hit AND bad THEN 'no answer' ELSE last_error END AS last_error FROM s""",
    "ingest_batches": f"{BROWSE} SELECT f.frame_id, captured_at, coalesce(d.text, '') AS content_text, 0 AS filter_version, row_number() OVER (ORDER BY f.frame_id % 2, f.frame_id) AS job_id, 'embed_text' AS kind FROM frames f LEFT JOIN documents d ON d.doc_id = f.frame_id",
    "older_schema": "SELECT doc_id AS frame_id, coalesce(text, '') AS raw_text, coalesce(text, '') AS content_text, 'ocr' AS primary_source, 0 AS filter_version, 0 AS suppressed_count FROM documents",
    "frame_luma": f"{BROWSE}, g AS (SELECT frame_id, frame_id % {BROKEN} > 0 AS ok, {GREY} AS v FROM frames) SELECT frame_id, CASE WHEN ok THEN {WIDTH} END AS width, CASE WHEN ok THEN {HEIGHT} END AS height, CASE WHEN ok THEN 1024 * v END AS luma_sum, CASE WHEN ok THEN CAST(v AS INTEGER) END AS brightest, CASE WHEN NOT ok THEN 'image: no image' END AS error FROM g",
}
