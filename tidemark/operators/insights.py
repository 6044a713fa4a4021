"""Activity aggregates and single-frame views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.timeseries import bucket_width, timeline_buckets, within

TOP_APPS = 12


def totals(frames: DataFrame, start: int, end: int) -> DataFrame:
    return within(frames, start, end).agg(F.count("*").alias("total"), F.count("activity_type").alias("tagged"))


def top_apps(frames: DataFrame, start: int, end: int, limit: int = TOP_APPS) -> DataFrame:
    """Frames without an application are a group of their own and come first among ties."""
    return within(frames, start, end).groupBy("app_hint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("app_hint")).limit(limit)


def activity_breakdown(frames: DataFrame, start: int, end: int, limit: int = TOP_APPS) -> DataFrame:
    return within(frames, start, end).where("activity_type IS NOT NULL").groupBy("activity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "activity_type").limit(limit)


def summary(frames: DataFrame, start: int, end: int, buckets: int) -> dict[str, DataFrame]:
    """All aggregates of a window; an impossible window gives empty ones."""
    return {"totals": totals(frames, start, end), "captures": timeline_buckets(frames, start, end, buckets), "top_apps": top_apps(frames, start, end), "activity": activity_breakdown(frames, start, end)}


def summary_rows(frames: DataFrame, start: int, end: int, buckets: int, limit: int = TOP_APPS) -> DataFrame:
    """``part, key, n``: totals, captures per bucket, the top applications and activities of a window from one scan.

    Counts per bucket, application and activity are taken first; the parts are sums of these.
    """
    width = bucket_width(start, end, buckets)
    inside = within(frames, start, end).groupBy(F.expr(f"(captured_at - {start}L) div {width}L").alias("bucket"), "app_hint", "activity_type").agg(F.count("*").alias("n"))
    part = lambda name, key: F.struct(F.lit(name).alias("part"), key.cast("string").alias("key"))
    tagged = F.col("activity_type").isNotNull()
    parts = F.array(part("total", F.lit(None)), F.when(tagged, part("tagged", F.lit(None))), part("captures", F.col("bucket")), part("app", F.col("app_hint")), F.when(tagged, part("activity", F.col("activity_type"))))
    summed = inside.select("n", F.explode(parts).alias("p")).where("p IS NOT NULL").groupBy("p.part", "p.key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.desc("n"), F.asc_nulls_first("key")))
    return summed.withColumn("place", place).where(~F.col("part").isin("app", "activity") | (F.col("place") <= limit)).drop("place")


def suppression_stats(spans: DataFrame, frame_text: DataFrame, filter_version: int) -> DataFrame:
    """Suppressed and all spans per target application, for texts of one filter version."""
    texts = frame_text.where(F.col("filter_version") == filter_version).select("frame_id", "target_app")
    out = spans.join(texts, "frame_id").groupBy("target_app").agg(F.count("*").alias("total_spans"), F.count_if(~F.col("is_searchable")).alias("suppressed_spans"))
    return out.withColumn("rate", (F.col("suppressed_spans") / F.col("total_spans")).cast("float")).orderBy(F.desc("suppressed_spans"), F.desc("total_spans"), F.asc_nulls_first("target_app"))


def frame_detail(frames: DataFrame, frame_text: DataFrame, vision: DataFrame, tags: DataFrame, frame_id: int) -> DataFrame:
    """One frame with its text, analysis and tag names in order."""
    one = lambda df: df.where(F.col("frame_id") == frame_id)
    names = one(tags).groupBy("frame_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    analysis = one(vision).select("frame_id", F.struct("description", "activity_type", "app_hint", "confidence", "model").alias("vision"))
    text = one(frame_text).select("frame_id", "content_text", "raw_text", "primary_source")
    joined = one(frames).join(text, "frame_id", "left").join(analysis, "frame_id", "left").join(names, "frame_id", "left")
    return joined.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def enrichment_input(frames: DataFrame, frame_text: DataFrame, frame_id: int) -> DataFrame:
    text = frame_text.select("frame_id", F.col("content_text").alias("text"))
    return frames.where(F.col("frame_id") == frame_id).select("frame_id", "image_path").join(text.where(F.col("frame_id") == frame_id), "frame_id", "left")


def content_texts(frame_text: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of many frames; frames without one, or with an empty one, are left out."""
    return frame_text.join(ids.select("frame_id").distinct(), "frame_id", "left_semi").where("content_text <> ''").select("frame_id", F.col("content_text").alias("text"))


def untagged_frames(frames: DataFrame, vision: DataFrame, jobs: DataFrame, limit: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Oldest frames without an analysis and without a tagging job that is pending, running or dead."""
    if start is not None and end is not None:
        frames = within(frames, start, end)
    busy = jobs.where((F.col("kind") == "vision_tag") & F.col("state").isin("pending", "running", "dead") & F.col("frame_id").isNotNull())
    free = frames.join(vision.select("frame_id"), "frame_id", "left_anti").join(busy.select("frame_id"), "frame_id", "left_anti")
    return free.orderBy("captured_at", "frame_id").limit(max(0, limit)).select("frame_id", "captured_at")


def shares(df: DataFrame, value: str = "n") -> DataFrame:
    """Add each row's part of the largest value and of the sum, as charts draw them."""
    sums = df.agg(F.max(value).alias("__max"), F.sum(value).alias("__sum"))
    return df.join(F.broadcast(sums)).withColumn("of_max", F.col(value) / F.col("__max")).withColumn("of_sum", F.col(value) / F.col("__sum")).drop("__max", "__sum")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n`` of tables."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def apps_before(frame_text: DataFrame, version: int) -> DataFrame:
    """Applications with texts of a filter version below ``version``."""
    return frame_text.where((F.col("filter_version") < version) & F.col("target_app").isNotNull()).select("target_app").distinct()


def nearest_thumbnail(thumbnails: DataFrame, at: int) -> DataFrame:
    """The row of ``frame_id, captured_at`` nearest to a moment, the earlier one of two."""
    gap = F.abs(F.col("captured_at") - at)
    best = F.min(F.struct(gap.alias("gap"), "captured_at", "frame_id")).alias("best")
    return thumbnails.agg(best).where("best IS NOT NULL").select("best.frame_id", "best.captured_at")


def latency_percentile(values: DataFrame, column: str, percent: int = 95) -> DataFrame:
    """``n`` and the value at place ``n * percent / 100`` of the sorted values, at most the last, from counts per value.

    Counts are summed within slices of neighbouring values and shifted, so no task sorts all values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    sliced = counts.withColumn("slice", F.floor(F.col(column) / 1000))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shift = sliced.groupBy("slice").agg(F.sum("c").alias("s")).select("slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift"))
    upto = F.sum("c").over(W.partitionBy("slice").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    placed = sliced.withColumn("upto", upto).join(shift, "slice").withColumn("upto", F.col("upto") + F.col("shift")).join(F.broadcast(total))
    place = F.least(F.expr(f"n * {percent} div 100"), F.col("n") - 1)
    return placed.where(F.col("upto") > place).groupBy("n").agg(F.min(column).alias("value"))
