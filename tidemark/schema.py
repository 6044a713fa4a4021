"""Schemas, closed domains and version of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 4
FILTER_VERSION = 2
DAY_MS = 86_400_000
MIN_MS, MAX_MS = -(2**63), 2**63 - 1

#: The closed domains.
JOB_KINDS = ("embed_text", "embed_image", "vision_tag")
JOB_STATES = ("pending", "running", "done", "failed", "dead")
TEXT_SOURCES = ("ocr", "uia")
TEXT_ROLES = ("content", "chrome", "background", "system", "unknown")
SUPPRESS_REASONS = ("static_chrome", "system_ui", "background_window")
ACTIVITIES = ("coding", "browsing", "email", "reading", "chat", "terminal", "design", "video")

_f = T.StructField

FRAMES = T.StructType([_f("frame_id", T.LongType(), False), _f("captured_at", T.LongType(), False), _f("monitor_index", T.IntegerType()), _f("width", T.IntegerType()), _f("height", T.IntegerType()), _f("image_path", T.StringType()), _f("content_hash", T.StringType()), _f("app_hint", T.StringType()), _f("window_title", T.StringType()), _f("browser_url", T.StringType()), _f("activity_type", T.StringType())])
FRAME_TEXT = T.StructType([_f("frame_id", T.LongType(), False), _f("raw_text", T.StringType()), _f("content_text", T.StringType()), _f("primary_source", T.StringType()), _f("filter_version", T.IntegerType()), _f("suppressed_count", T.IntegerType()), _f("target_title", T.StringType()), _f("target_app", T.StringType())])
SPANS = T.StructType([_f("frame_id", T.LongType(), False), _f("span_index", T.IntegerType(), False), _f("text", T.StringType()), _f("normalized_text", T.StringType()), _f("source", T.StringType()), _f("role", T.StringType()), *(_f(c, T.FloatType()) for c in "xywh"), _f("is_searchable", T.BooleanType()), _f("suppress_reason", T.StringType()), _f("line_index", T.IntegerType())])
VISION = T.StructType([_f("frame_id", T.LongType(), False), _f("description", T.StringType()), _f("activity_type", T.StringType()), _f("app_hint", T.StringType()), _f("confidence", T.FloatType()), _f("model", T.StringType())])
EMBEDDINGS = T.StructType([_f("frame_id", T.LongType(), False), _f("chunk_index", T.IntegerType(), False), _f("chunk_text", T.StringType()), _f("source", T.StringType()), _f("model", T.StringType()), _f("embedding", T.ArrayType(T.FloatType()))])
JOBS = T.StructType([_f("job_id", T.LongType(), False), _f("kind", T.StringType()), _f("frame_id", T.LongType()), _f("state", T.StringType()), _f("priority", T.LongType()), _f("attempts", T.LongType()), _f("max_attempts", T.LongType()), _f("not_before", T.LongType()), _f("last_error", T.StringType()), _f("updated_at", T.LongType())])
CATALOG = T.StructType([_f("signature", T.StringType(), False), _f("app_hint", T.StringType()), _f("region_bucket", T.StringType()), _f("normalized_text", T.StringType()), _f("seen_count", T.LongType()), _f("first_seen_at", T.LongType()), _f("last_seen_at", T.LongType()), _f("suppressed", T.BooleanType())])
IMAGE_EMBEDDINGS = T.StructType([_f("frame_id", T.LongType(), False), _f("model", T.StringType()), _f("embedding", T.ArrayType(T.FloatType()))])
FRAME_TAGS = T.StructType([_f("frame_id", T.LongType(), False), _f("name", T.StringType())])
SETTINGS = T.StructType([_f("key", T.StringType(), False), _f("value", T.StringType())])

TABLES = {"frames": FRAMES, "frame_text": FRAME_TEXT, "text_spans": SPANS, "vision_analysis": VISION, "embeddings": EMBEDDINGS, "jobs": JOBS, "chrome_text_catalog": CATALOG, "image_embeddings": IMAGE_EMBEDDINGS, "frame_tags": FRAME_TAGS, "settings": SETTINGS}
#: Tables whose files lie in a directory per day, which windows of time prune.
BY_DAY = ("frames", "frame_text", "text_spans")
#: Tables whose rows change one by one, and their keys.
KEYS = {"jobs": ["job_id"], "settings": ["key"], "vision_analysis": ["frame_id"]}
SATELLITES = ("frame_text", "text_spans", "vision_analysis", "embeddings", "image_embeddings", "jobs", "frame_tags")


def check_version(found: int) -> int:
    """Refuse data that a newer build wrote."""
    if found > SCHEMA_VERSION:
        raise ValueError(f"the data has schema version {found}; this build knows up to {SCHEMA_VERSION}")
    return found
