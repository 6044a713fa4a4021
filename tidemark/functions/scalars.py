"""Scalar helpers: paths, deny-lists, rectangles, model replies, settings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.timeseries import ascii_fold
from tidemark.schema import ACTIVITIES, DAY_MS


def day_shard_path(captured_at: Column, frame_id: Column) -> Column:
    """``frames/<day>/<id>.jpg``; days before 1970 count down."""
    return F.concat(F.lit("frames/"), F.floor(captured_at / DAY_MS).cast("string"), F.lit("/"), frame_id.cast("string"), F.lit(".jpg"))


def is_frame_path(path: Column) -> Column:
    """A relative path below ``frames/`` that doesn't leave it."""
    return path.rlike(r"^frames/[^\\:]+$") & ~path.rlike(r"(^|/)\.\.(/|$)")


def is_excluded(app: Column, title: Column, entries: list[str]) -> Column:
    """Whether a deny-list entry occurs in the application or the title, A-Z in either case; blank entries never do."""
    needles = [e.strip() for e in entries if e.strip()]
    out = F.lit(False)
    for n in needles:
        needle = ascii_fold(F.lit(n))
        for hay in (app, title):
            out = out | F.coalesce(F.contains(ascii_fold(hay), needle), F.lit(False))
    return out


def may_capture(locked: Column, own_window: Column, app: Column, title: Column, entries: list[str]) -> Column:
    """The privacy gate: no frame of a locked screen, of our own window or of a denied application; unknown states count as no."""
    return ~F.coalesce(locked, F.lit(False)) & ~F.coalesce(own_window, F.lit(False)) & ~is_excluded(app, title, entries)


def rect_in_monitor(rect: Column, monitor: Column) -> Column:
    """A window's pixels as parts of the monitor, clamped; null where its centre lies on another one."""
    cx, cy = rect["x"] + rect["w"] / 2, rect["y"] + rect["h"] / 2
    on = (cx >= monitor["x"]) & (cx < monitor["x"] + monitor["w"]) & (cy >= monitor["y"]) & (cy < monitor["y"] + monitor["h"]) & (monitor["w"] > 0) & (monitor["h"] > 0)
    unit = lambda v, at, size: F.least(F.greatest((v - at) / size, F.lit(0.0)), F.lit(1.0))
    x0, y0 = unit(rect["x"], monitor["x"], monitor["w"]), unit(rect["y"], monitor["y"], monitor["h"])
    x1, y1 = unit(rect["x"] + rect["w"], monitor["x"], monitor["w"]), unit(rect["y"] + rect["h"], monitor["y"], monitor["h"])
    return F.when(on, F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def reply_struct(reply: Column) -> Column:
    """``description, activity_type, app_hint, confidence`` of a model's reply.

    The JSON object between the first and the last brace counts if it has a description; else the whole
    reply is the description and the confidence is -1. Labels outside the closed set and the word null are dropped.
    """
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    json = F.from_json(body, "description string, activity_type string, app_hint string, confidence double")
    good = F.coalesce(F.trim(json["description"]) != "", F.lit(False))
    label = F.lower(F.trim(json["activity_type"]))
    app = F.trim(json["app_hint"])
    sure = json["confidence"]
    return F.struct(
        F.when(good, F.trim(json["description"])).otherwise(F.trim(reply)).alias("description"),
        F.when(good & label.isin(*ACTIVITIES), label).alias("activity_type"),
        F.when(good & (app != "") & (F.lower(app) != "null"), app).alias("app_hint"),
        F.coalesce(F.when(good & (sure > 0) & (sure <= 1), sure), F.lit(-1.0)).alias("confidence"),
    )


def sse_deltas(line: Column) -> Column:
    """``done, thinking, text`` of a server-sent line, null for comments, blanks, empty pieces and lines that aren't JSON."""
    data = F.trim(F.regexp_extract(line, r"(?s)^data:(.*)$", 1))
    delta = F.get(F.from_json(data, "choices array<struct<delta struct<content string, reasoning_content string>>>")["choices"], F.lit(0))["delta"]
    some = lambda name: F.nullif(delta[name], F.lit(""))
    text = F.coalesce(some("reasoning_content"), some("content"))
    done = data == "[DONE]"
    return F.when(done | text.isNotNull(), F.struct(done.alias("done"), some("reasoning_content").isNotNull().alias("thinking"), F.when(~done, text).alias("text")))


def relative_time(at_ms: Column, now_ms: Column) -> Column:
    """How long ago, in words up to a week (times to come are just now), and the date of what is older."""
    age = now_ms - at_ms
    ago = lambda each, unit: F.concat(F.floor(age / each + 0.5).cast("string"), F.lit(f"{unit} ago"))
    label = F.when(age < 45_000, "just now").when(age < 90_000, "1m ago").when(age < 3_600_000, ago(60_000, "m")).when(age < 7_200_000, "1h ago")
    label = label.when(age < DAY_MS, ago(3_600_000, "h")).when(age < 2 * DAY_MS, "yesterday").when(age < 7 * DAY_MS, ago(DAY_MS, "d"))
    return label.otherwise(F.date_format(F.timestamp_millis(at_ms), "MMM d, yyyy"))


#: Settings with their least and largest values.
LIMITS = {"capture_interval_ms": (250, 3_600_000), "change_threshold": (0.0, 1.0), "max_width": (320, 7680), "worker_concurrency": (1, 16), "chrome_min_seen": (2, 1000), "chrome_protect_chars": (1, 10_000), "chrome_grid": (1, 32), "ctx_size": (512, 32_768)}


#: Settings that are stored, with their defaults.
DEFAULTS = {"capture_interval_ms": 2000, "change_threshold": 0.006, "max_width": 1920, "worker_concurrency": 1, "chrome_min_seen": 4, "chrome_protect_chars": 48, "chrome_grid": 8, "ctx_size": 0, "retention_days": 0, "excluded_apps": "[]", "tagging_enabled": False}


def clamp_setting(name: str, value: float) -> float:
    """Within the setting's limits; values that aren't finite become the least. A context size of 0 means automatic."""
    low, high = LIMITS[name]
    if name == "ctx_size" and value == 0:
        return 0
    return low if not math.isfinite(value) else type(low)(max(low, min(value, high)))


def parse_setting(text: str | None, default):
    """A stored text as the type of its default; the default where it can't be read."""
    if text is None:
        return default
    try:
        if isinstance(default, bool):
            word = text.strip().lower()
            return True if word in ("true", "1", "yes", "on") else False if word in ("false", "0", "no", "off") else default
        return type(default)(text.strip()) if not isinstance(default, str) else text
    except ValueError:
        return default


def format_setting(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def pixel_rect(rect: Column, width: Column, height: Column) -> Column:
    """A pixel rectangle as parts of its image, clamped so that it ends within it; zeros for an empty image."""
    unit = lambda v, size: F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0))
    x, y = unit(rect["x"], width), unit(rect["y"], height)
    w, h = F.least(unit(rect["w"], width), 1 - x), F.least(unit(rect["h"], height), 1 - y)
    some, zero = (width > 0) & (height > 0), F.lit(0.0)
    return F.struct(*(F.when(some, v).otherwise(zero).alias(k) for k, v in zip("xywh", (x, y, w, h))))


def content_hash(content: Column) -> Column:
    """An opaque id of bytes or text: equal content, equal id."""
    return F.sha2(content.cast("binary"), 256)


def local_day_range(day: Column, zone: str) -> Column:
    """``start, end`` in milliseconds of a local date in a time zone; days with a change of the clock are shorter or longer."""
    midnight = lambda d: F.timestamp_millis(F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS)
    at = lambda d: F.unix_millis(F.to_utc_timestamp(midnight(d), zone))
    return F.struct(at(day).alias("start"), at(F.date_add(day, 1)).alias("end"))


def bucket_count(pixels: float, pixels_each: float, low: int, high: int) -> int:
    """How many buckets a chart of some width shows."""
    return max(low, min(high, math.floor(pixels / pixels_each + 0.5)))


#: Statuses of a part of the system from the worst on.
STATUSES = ("error", "unavailable", "initializing", "ready", "disabled", "unknown")


def worst_status(statuses: Column, order: tuple[str, ...] = STATUSES) -> Column:
    """The worst of an array of statuses; others than these don't count, none gives unknown."""
    known = F.array_intersect(F.array(*map(F.lit, order)), statuses)
    return F.coalesce(F.get(known, F.lit(0)), F.lit(order[-1]))


def nearest_rank(values: list[float], percent: int = 95) -> float | None:
    """The value at place ``len * percent / 100`` of the sorted values, at most the last."""
    return sorted(values)[min(len(values) - 1, len(values) * percent // 100)] if values else None
