"""Browsing by time: ranges, buckets, even samples, nearest and neighbouring frames, retention.

Times are whole milliseconds and windows are half-open. Ranks over a whole window are taken within days
and shifted by the counts of the days before, so no task gets the whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schema import DAY_MS, MAX_MS, MIN_MS

META = ("frame_id", "captured_at", "image_path", "app_hint")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def within(df: DataFrame, start: int, end: int, col: str = "captured_at") -> DataFrame:
    """Half-open time filter, with the day predicate that prunes a day-partitioned table."""
    df = df.where((F.col(col) >= start) & (F.col(col) < end))
    if "day" in df.columns and MIN_MS < start < end < MAX_MS:
        df = df.where(F.col("day").between(start // DAY_MS, (end - 1) // DAY_MS))
    return df


def frames_in_range(frames: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """Newest first."""
    if end <= start or limit <= 0:
        return frames.select(*META).limit(0)
    return within(frames, start, end).select(*META).orderBy(F.desc("captured_at"), F.desc("frame_id")).limit(limit)


def frames_older_than(frames: DataFrame, cutoff: int, limit: int) -> DataFrame:
    """Oldest first, strictly before ``cutoff``: what retention takes next."""
    return frames.where(F.col("captured_at") < cutoff).select(*META).orderBy("captured_at", "frame_id").limit(max(0, limit))


def retention_candidates(frames: DataFrame, now: int, days: int, limit: int = 1000) -> DataFrame:
    """Frames to drop when ``days`` are kept; 0 keeps everything."""
    return frames_older_than(frames, max(MIN_MS, now - days * DAY_MS) if days > 0 else MIN_MS, limit)


def ascii_fold(col: Column) -> Column:
    """Lower case for A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def of_app(frames: DataFrame, app: str) -> DataFrame:
    """Frames of an application, A-Z in either case; an empty name matches nothing."""
    return frames.where((ascii_fold(F.col("app_hint")) == ascii_fold(F.lit(app))) & F.lit(bool(app)))


def frames_by_app(frames: DataFrame, app: str, limit: int) -> DataFrame:
    """The oldest frames of an application."""
    return of_app(frames, app).select(*META).orderBy("captured_at", "frame_id").limit(limit)


def bucket_width(start: int, end: int, buckets: int) -> int:
    return max(1, -(-(end - start) // buckets))


def timeline_buckets(frames: DataFrame, start: int, end: int, buckets: int, fill_gaps: bool = False) -> DataFrame:
    """``start, end, n`` of equal buckets in time order; the last one ends with the window, empty ones only if asked for."""
    if end <= start or buckets <= 0 or end - start > MAX_MS:
        return frames.select(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")).limit(0)
    width = bucket_width(start, end, buckets)
    index = F.expr(f"(captured_at - {start}L) div {width}L")
    counted = within(frames, start, end).groupBy(index.alias("bucket")).agg(F.count("*").alias("n"))
    if fill_gaps:
        last = (end - start - 1) // width
        counted = frames.sparkSession.range(0, last + 1).withColumnRenamed("id", "bucket").join(F.broadcast(counted), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    begin = F.col("bucket") * F.lit(width).cast("long") + F.lit(start).cast("long")
    return counted.select(begin.alias("start"), F.least(F.try_add(begin, F.lit(width).cast("long")), F.lit(end).cast("long")).alias("end"), "n").orderBy("start")


def ranked(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add ``rank`` from 0 in order of time and id, and ``total``, for each group ``by``."""
    keys = list(by or [])
    df = df.withColumn("__day", F.floor(F.col("captured_at") / DAY_MS))
    per_day = df.groupBy(*keys, "__day").agg(F.count("*").alias("__n"))
    # One row for each day: few, whatever the number of frames.
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = per_day.withColumn("__before", F.coalesce(F.sum("__n").over(w.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("__n").over(w)).drop("__n")
    inner = F.row_number().over(W.partitionBy(*keys, "__day").orderBy("captured_at", "frame_id")) - 1
    return df.withColumn("__rank", inner).join(before, [*keys, "__day"]).withColumn("rank", F.col("__rank") + F.col("__before")).drop("__day", "__rank", "__before")


def is_sampled(rank: Column, total: Column, n) -> Column:
    """Whether the frame begins another of ``n`` even parts of its window."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    part = lambda r: F.floor(r * n / total)
    return (rank == 0) | (part(rank) != part(rank - 1))


def sample_frames(frames: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """min(total, limit) frames spread evenly over the window."""
    if end <= start or limit <= 0:
        return frames.select(*META).limit(0)
    return ranked(within(frames, start, end)).where(is_sampled(F.col("rank"), F.col("total"), limit)).select(*META).orderBy("captured_at", "frame_id")


def nearest_frame(frames: DataFrame, at: int, start: int = MIN_MS, end: int = MAX_MS) -> DataFrame:
    """The frame closest to ``at`` within the window; ties go to the one at or after it, then to the smaller id."""
    if end <= start:
        return frames.select(*META).limit(0)
    inside = within(frames, start, end).select(*META)
    after = inside.where(F.col("captured_at") >= at).orderBy("captured_at", "frame_id").limit(1).withColumn("side", F.lit(0))
    before = inside.where(F.col("captured_at") < at).orderBy(F.desc("captured_at"), "frame_id").limit(1).withColumn("side", F.lit(1))
    away = F.abs(F.col("captured_at").cast("decimal(20,0)") - at)
    return after.unionByName(before).orderBy(away, "side").limit(1).select(*META)


def nearest_for(anchors: DataFrame, frames: DataFrame, width: int = 3_600_000) -> DataFrame:
    """``anchor_id, at`` with the nearest ``frame_id, captured_at`` for each of many anchors, null without frames.

    Both sides are dealt to time slices of ``width``; within a slice a window finds the frames just before
    and at or after an anchor, and a table with the first and last frame of each slice gives those of the
    slices around it. Only that table is ordered as a whole.
    """
    slice_of = lambda c: F.floor(F.col(c) / width)
    frame = F.struct(F.col("captured_at").alias("t"), F.col("frame_id").alias("id"))
    f = frames.select(slice_of("captured_at").alias("slice"), frame.alias("f"), F.col("captured_at").alias("t"), F.col("frame_id").alias("id"))
    last = F.max(F.struct(F.col("t"), (-F.col("id")).alias("id")))
    ends = f.groupBy("slice").agg(F.min("f").alias("first"), last.alias("last")).select("slice", "first", F.struct(F.col("last.t").alias("t"), (-F.col("last.id")).alias("id")).alias("last"))
    a = anchors.select(slice_of("at").alias("slice"), "anchor_id", F.col("at").alias("t"))
    slices = a.select("slice").distinct().join(ends, "slice", "full")
    everywhere = W.partitionBy(F.lit(0)).orderBy("slice")
    around = slices.select("slice", F.last("last", True).over(everywhere.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(everywhere.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    both = a.withColumn("f", F.lit(None).cast(f.schema["f"].dataType)).withColumn("kind", F.lit(0)).withColumn("id", F.lit(0).cast("long")).unionByName(f.withColumn("anchor_id", F.lit(None).cast(anchors.schema["anchor_id"].dataType)).withColumn("kind", F.lit(1)))
    own = W.partitionBy("slice")
    seen = both.withColumn("prev", F.last("f", True).over(own.orderBy("t", "kind", F.desc("id")).rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.first("f", True).over(own.orderBy("t", "kind", "id").rowsBetween(0, W.unboundedFollowing)))
    found = seen.where("kind = 0").join(around, "slice").select("anchor_id", F.col("t").alias("at"), F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))
    later = F.col("next").isNotNull() & (F.col("prev").isNull() | (F.col("next.t") - F.col("at") <= F.col("at") - F.col("prev.t")))
    return found.withColumn("best", F.when(later, F.col("next")).otherwise(F.col("prev"))).select("anchor_id", "at", F.col("best.id").alias("frame_id"), F.col("best.t").alias("captured_at"))


def neighbour_frames(frames: DataFrame, at: int, half_window: int, limit_each: int) -> DataFrame:
    """Up to ``limit_each`` frames on either side of ``at``, which is left out; far bounds belong to the window."""
    low, high = max(MIN_MS, at - half_window), min(MAX_MS, at + half_window)
    t = F.col("captured_at")
    before = frames.where((t >= low) & (t < at)).select(*META).orderBy(F.desc("captured_at"), F.desc("frame_id")).limit(max(0, limit_each))
    after = frames.where((t > at) & (t <= high)).select(*META).orderBy("captured_at", "frame_id").limit(max(0, limit_each))
    return before.unionByName(after).orderBy("captured_at", "frame_id")
