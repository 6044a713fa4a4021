"""Text roles from geometry and repetition: classification, reconciliation, backfill.

Whether a line counts as an observation of its signature depends on geometry and title alone, so the
number of earlier observations is a running count over (frame, signature) pairs. Counts are taken within
slices of the frame sequence and shifted by the slices before, so a signature that is everywhere is
still dealt to many tasks. All geometry is in single precision.

Spans that come as rows are shuffled once to make their lines. Where a row holds a whole line's words, the line
is made in its row, and only lines that repetition may suppress are shuffled to be counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_text
from tidemark.operators.queue import upsert
from tidemark.schema import FILTER_VERSION

#: Top of the system band, inset of a window's interior, least part of a line inside it.
SYSTEM_TOP, INSET, INSIDE = 0.95, 0.06, 0.5
SEPARATOR = "\x1f"
SLICE = 10_000


@dataclass(frozen=True)
class Config:
    """Sightings that suppress a line, characters that protect one, cells of the grid per side."""

    min_seen: int = 4
    protect_chars: int = 48
    grid: int = 8

    def sane(self) -> Config:
        return Config(max(self.min_seen, 1), self.protect_chars, max(self.grid, 1))


def f32(x) -> Column:
    return (F.lit(float(x)) if not isinstance(x, Column) else x).cast("float")


def lines_of(spans: DataFrame) -> DataFrame:
    """``frame_id, line_index, x, y, right, bottom, text, normalized`` and the first span's role, if there is one."""
    word = F.struct("span_index", "text")
    role = [F.min_by("role", "span_index").alias("role")] if "role" in spans.columns else []
    grouped = spans.groupBy("frame_id", "line_index").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.sort_array(F.collect_list(word)).alias("words"), *role)
    text = F.array_join(F.transform("words", lambda s: s["text"]), " ")
    return grouped.withColumn("text", text).withColumn("normalized", normalize_text(F.col("text"))).drop("words")


def lines_within(rows: DataFrame) -> DataFrame:
    """The lines of ``lines_of`` with ``n_words``, where each row holds one line's spans: ``words``, an array of ``text, x, y, w, h`` in order.

    Each row has a word at least. Nothing is shuffled; all other columns stay.
    """
    edge = lambda at, size: F.array_max(F.transform("words", lambda s: s[at] + s[size]))
    lines = rows.withColumns({"x": F.array_min("words.x"), "y": F.array_min("words.y"), "right": edge("x", "w"), "bottom": edge("y", "h"), "text": F.array_join("words.text", " "), "n_words": F.size("words").cast("long")})
    return lines.withColumn("normalized", normalize_text(F.col("text"))).drop("words")


def inside_fraction(rect: Column) -> Column:
    """Part of a line's area inside ``rect``; a line without area is inside if its top left corner is."""
    w, h = F.col("right") - F.col("x"), F.col("bottom") - F.col("y")
    rx, ry, rr, rb = rect["x"], rect["y"], rect["x"] + rect["w"], rect["y"] + rect["h"]
    corner = F.when((F.col("x") >= rx) & (F.col("x") <= rr) & (F.col("y") >= ry) & (F.col("y") <= rb), f32(1)).otherwise(f32(0))
    shared = F.greatest(F.least("right", rr) - F.greatest("x", rx), f32(0)) * F.greatest(F.least("bottom", rb) - F.greatest("y", ry), f32(0))
    return F.when(w * h <= f32(0), corner).otherwise((shared / (w * h)).cast("float"))


def centroid() -> tuple[Column, Column]:
    return F.col("x") + (F.col("right") - F.col("x")) * f32(0.5), F.col("y") + (F.col("bottom") - F.col("y")) * f32(0.5)


def is_interior(rect: Column) -> Column:
    cx, cy = centroid()
    dx, dy = f32(INSET) * rect["w"], f32(INSET) * rect["h"]
    return (cx >= rect["x"] + dx) & (cx <= rect["x"] + rect["w"] - dx) & (cy >= rect["y"] + dy) & (cy <= rect["y"] + rect["h"] - dy)


def region(grid: int) -> Column:
    cx, cy = centroid()
    cell = lambda c: F.least(F.floor(F.least(F.greatest(c, f32(0)), f32(1)) * f32(grid)).cast("int"), F.lit(grid - 1)).cast("string")
    return F.concat(cell(cy), F.lit(","), cell(cx))


def signature(app: Column, grid: int) -> Column:
    return F.concat(F.coalesce(app, F.lit("")), F.lit(SEPARATOR), region(grid), F.lit(SEPARATOR), F.col("normalized"))


def _with_prior(seen: DataFrame) -> DataFrame:
    """Add ``prior``, the earlier frames with the same signature, to distinct ``frame_id, seq, signature``."""
    sliced = seen.withColumn("slice", F.floor(F.col("seq") / SLICE))
    before = W.partitionBy("signature").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shift = sliced.groupBy("signature", "slice").agg(F.count("*").alias("n")).select("signature", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(W.partitionBy("signature", "slice").orderBy("seq", "frame_id")) - 1
    return sliced.withColumn("own", own).join(shift, ["signature", "slice"]).select("frame_id", "signature", (F.col("own") + F.col("shift")).alias("prior"))


def line_roles(spans: DataFrame, context: DataFrame, config: Config = Config(), catalog: DataFrame | None = None) -> DataFrame:
    """Lines with ``role, reason, signature`` (null where a line isn't observed).

    ``context``: ``frame_id, seq, app, title, rect`` of frames in ingest order; ``rect`` is null where the
    window isn't known. ``catalog`` holds sightings from before.
    """
    lines = lines_of(spans).join(context.select("frame_id", "seq", "app", "title", "rect"), "frame_id")
    return with_roles(with_signatures(lines, config), config, catalog).drop("early", "own")


def with_signatures(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Lines that hold their frame's ``seq, app, title, rect``, with what follows from geometry and title alone.

    ``early``: a role that repetition doesn't change, or null; ``own``: the signature of a line short enough to
    be suppressed, else null; ``signature, region_bucket``: those of an observed line, else null.
    """
    config = config.sane()
    rect, known = F.col("rect"), F.col("rect").isNotNull()
    short = F.char_length("normalized") < config.protect_chars
    outside = known & (inside_fraction(rect) < f32(INSIDE))
    title = normalize_text(F.col("title"))
    early = F.when(outside & short & (F.col("y") >= f32(SYSTEM_TOP)), "system").when(outside, "background").when((title != "") & (F.col("normalized") == title), "chrome")
    lines = lines.withColumn("early", early).withColumn("own", F.when(short, signature(F.col("app"), config.grid)))
    observed = F.col("early").isNull() & short & known & ~is_interior(rect)
    return lines.withColumn("signature", F.when(observed, F.col("own"))).withColumn("region_bucket", F.when(observed, region(config.grid)))


def with_roles(lines: DataFrame, config: Config = Config(), catalog: DataFrame | None = None) -> DataFrame:
    """Add ``prior, role, reason`` to the lines of ``with_signatures``; only observed lines are shuffled.

    ``frame_id, seq, rect, early, signature`` are read; all other columns stay.
    """
    config = config.sane()
    observed = lines.where("signature IS NOT NULL")
    prior = _with_prior(observed.select("frame_id", "seq", "signature").distinct())
    if catalog is not None:
        prior = prior.join(catalog.select("signature", "seen_count"), "signature", "left").withColumn("prior", F.col("prior") + F.coalesce("seen_count", F.lit(0))).drop("seen_count")
    others = lines.where("signature IS NULL").withColumn("prior", F.lit(None).cast("long"))
    lines = observed.join(prior, ["frame_id", "signature"]).unionByName(others)
    role = F.coalesce("early", F.when(F.col("prior") + 1 >= config.min_seen, "chrome"), F.when(F.col("rect").isNotNull(), "content").otherwise("unknown"))
    lines = lines.withColumn("role", role)
    reason = F.when(F.col("role") == "system", "system_ui").when(F.col("role") == "background", "background_window").when(F.col("role") == "chrome", "static_chrome")
    return lines.withColumn("reason", reason)


def content_texts(lines: DataFrame) -> DataFrame:
    """``frame_id, content_text``: kept lines in order; frames that keep none have an empty text."""
    kept = F.when(F.col("role").isin("content", "unknown"), F.struct("line_index", "text"))
    return lines.groupBy("frame_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda s: s["text"]), "\n").alias("content_text"))


def classify_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans with the role of their line."""
    roles = lines.select("frame_id", "line_index", "role", "reason")
    out = spans.drop("role", "suppress_reason", "is_searchable").join(roles, ["frame_id", "line_index"], "left")
    role = F.coalesce("role", F.lit("unknown"))
    return out.withColumn("role", role).withColumn("is_searchable", F.col("role").isin("content", "unknown")).withColumnRenamed("reason", "suppress_reason")


def suppressed_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("frame_id").agg(F.count_if(~F.col("is_searchable")).alias("suppressed_count"))


def suppressed_words(lines: DataFrame) -> DataFrame:
    """``suppressed_counts`` from lines with ``n_words`` and their roles."""
    kept = F.col("role").isin("content", "unknown")
    return lines.groupBy("frame_id").agg(F.sum(F.when(kept, 0).otherwise(F.col("n_words"))).alias("suppressed_count"))


def observations(lines: DataFrame, at: int) -> DataFrame:
    """Catalog rows from one ingest: sightings per signature."""
    seen = lines.where("signature IS NOT NULL").groupBy("signature").agg(F.min("app").alias("app_hint"), F.min("region_bucket").alias("region_bucket"), F.min("normalized").alias("normalized_text"), F.count_distinct("frame_id").alias("seen_count"))
    return seen.withColumn("first_seen_at", F.lit(at).cast("long")).withColumn("last_seen_at", F.lit(at).cast("long"))


def merge_catalog(catalog: DataFrame, new: DataFrame, min_seen: int) -> DataFrame:
    """Counts add up; a signature is suppressed once it was seen often enough."""
    both = catalog.select(*new.columns).unionByName(new)
    merged = both.groupBy("signature").agg(*(F.min(c).alias(c) for c in ("app_hint", "region_bucket", "normalized_text")), F.sum("seen_count").alias("seen_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return merged.withColumn("suppressed", F.col("seen_count") >= min_seen)


def reconcile(spans: DataFrame, apps: DataFrame, catalog: DataFrame, config: Config = Config()) -> DataFrame:
    """Spans after kept, short lines of known signatures are demoted; it only suppresses more, so running it again changes nothing.

    ``apps``: ``frame_id, app``. The catalog counted these frames already.
    """
    config = config.sane()
    lines = lines_of(spans).join(apps, "frame_id")
    kept = lines.where(F.col("role").isin("content", "unknown") & (F.char_length("normalized") < config.protect_chars))
    warm = catalog.where(F.col("seen_count") >= config.min_seen).select("signature")
    demoted = kept.withColumn("signature", signature(F.col("app"), config.grid)).join(warm, "signature", "left_semi").select("frame_id", "line_index", F.lit(True).alias("demoted"))
    out = spans.join(demoted, ["frame_id", "line_index"], "left")
    hit = F.col("demoted").isNotNull()
    changes = {"role": F.when(hit, "chrome").otherwise(F.col("role")), "suppress_reason": F.when(hit, "static_chrome").otherwise(F.col("suppress_reason")), "is_searchable": F.when(hit, False).otherwise(F.col("role").isin("content", "unknown"))}
    return out.withColumns(changes).select(*spans.columns)


def reconcile_lines(lines: DataFrame, catalog: DataFrame, config: Config = Config()) -> DataFrame:
    """``reconcile`` for lines of ``with_roles``: only kept, short ones are shuffled, by their own signatures."""
    config = config.sane()
    may = F.col("role").isin("content", "unknown") & F.col("own").isNotNull()
    warm = catalog.where(F.col("seen_count") >= config.min_seen).select(F.col("signature").alias("own"), F.lit(True).alias("warm"))
    kept = lines.where(may).join(warm, "own", "left")
    kept = kept.withColumns({"role": F.when(F.col("warm"), "chrome").otherwise(F.col("role")), "reason": F.when(F.col("warm"), "static_chrome").otherwise(F.col("reason"))})
    return kept.select(*lines.columns).unionByName(lines.where(~may))


def backfill(frame_text: DataFrame, spans: DataFrame, embeddings: DataFrame, catalog: DataFrame, config: Config = Config(), current: int = FILTER_VERSION) -> dict[str, DataFrame]:
    """Re-clean texts of older filter versions: the new ``frame_text``, ``spans`` and ``embeddings``, and ``changed`` frames to embed again."""
    old = frame_text.where(F.col("filter_version") < current)
    own = spans.join(old.select("frame_id"), "frame_id", "left_semi")
    redone = reconcile(own, old.select("frame_id", F.col("target_app").alias("app")), catalog, config)
    texts = content_texts(lines_of(redone)).join(suppressed_counts(redone), "frame_id")
    new = old.drop("content_text", "suppressed_count").join(texts, "frame_id", "left")
    new = new.withColumn("content_text", F.coalesce("content_text", F.lit(""))).withColumn("suppressed_count", F.coalesce("suppressed_count", F.lit(0)).cast("int")).withColumn("filter_version", F.lit(current))
    before = old.select("frame_id", F.col("content_text").alias("before"))
    changed = new.join(before, "frame_id").where(~F.col("content_text").eqNullSafe(F.col("before"))).select("frame_id")
    gone = embeddings.where("source = 'ocr'").join(changed, "frame_id", "left_semi").select("frame_id", "chunk_index")
    return {
        "frame_text": upsert(frame_text, new.withColumn("seq", F.lit(0)), ["frame_id"]),
        "spans": spans.join(old.select("frame_id"), "frame_id", "left_anti").select(*spans.columns).unionByName(redone),
        "embeddings": embeddings.join(gone, ["frame_id", "chunk_index"], "left_anti").select(*embeddings.columns),
        "changed": changed,
    }
