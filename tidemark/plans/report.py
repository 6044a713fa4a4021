"""Report planning: period grids, quotas, groups, batches, packing, and the map-reduce driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.text import token_estimate, truncate_bytes
from tidemark.operators.timeseries import bucket_width, is_sampled, ranked, within
from tidemark.plans.folds import Fold, fold_slices
from tidemark.schema import DAY_MS

#: Frames a period has at least, nodes per reduction, periods, passes and citations at most,
#: tokens around a prompt and around a chunk, and the context size where a provider names none.
LEAST_FRAMES, FAN_IN, MOST_PERIODS, MOST_PASSES, MOST_CITED = 3, 6, 31, 64, 200
PROMPT_TOKENS, CHUNK_TOKENS, CONTEXT_TOKENS = 96, 6, 8192
MAP_PROMPT = "Summarise what these notes say in one short paragraph."
FINAL_PROMPT = "Write one report in Markdown from these summaries."


def estimate(text: str) -> int:
    return len(text.encode()) // 2 + 1


def grid_size(start: int, end: int, most: int = MOST_PERIODS) -> int:
    """One period per day, up to ``most``."""
    return 0 if end <= start else max(1, min(-(-(end - start) // DAY_MS), max(1, most)))


def reply_budget(asked: int, context: int) -> int:
    return min(asked, max(context // 2, 1))


def per_batch(reply: int, context: int) -> int:
    return max(1, context - reply - estimate(MAP_PROMPT) - PROMPT_TOKENS)


def plan_depth(counts: DataFrame, daily: int, weekly: int) -> DataFrame:
    """Add ``quota`` to ``period, n`` of active periods."""
    periods = F.count("*").over(W.partitionBy(F.lit(0)))  # at most MOST_PERIODS rows
    each = F.when(periods * daily <= weekly, F.lit(daily)).otherwise(F.greatest(F.floor(F.lit(weekly) / periods), F.lit(LEAST_FRAMES)))
    return counts.withColumn("quota", F.least(F.greatest(each, F.lit(LEAST_FRAMES)), F.col("n")).cast("long"))


def coverage_groups(frames: DataFrame, texts: DataFrame, start: int, end: int, daily: int = 40, weekly: int = 200) -> DataFrame:
    """``period, label, frame_id, captured_at, text``: an even sample of every active period, blank texts left out."""
    n = grid_size(start, end)
    if n == 0:
        return frames.select(F.lit(0).cast("long").alias("period"), F.lit("").alias("label"), "frame_id", "captured_at", F.lit("").alias("text")).limit(0)
    width = bucket_width(start, end, n)
    inside = within(frames, start, end).select("frame_id", "captured_at", F.expr(f"(captured_at - {start}L) div {width}L").alias("period"))
    quotas = plan_depth(inside.groupBy("period").agg(F.count("*").alias("n")), daily, weekly).select("period", "quota")
    taken = ranked(inside, ["period"]).join(F.broadcast(quotas), "period").where(is_sampled(F.col("rank"), F.col("total"), F.col("quota")))
    day = F.expr(f"period * {width}L div {DAY_MS}L + 1")
    text = texts.select("frame_id", F.col("content_text").alias("text")).where(F.trim("text") != "")
    return taken.join(text, "frame_id").select("period", F.concat(F.lit("day "), day.cast("string")).alias("label"), "frame_id", "captured_at", "text")


def fold(costs: list[int], budget: int, spent: int = 0, batch: int = 0) -> tuple[list[int], int, int]:
    """Batch numbers of costs in order: a new batch where the next would exceed ``budget``; and where that leaves off."""
    out = []
    for cost in costs:
        if spent > 0 and spent + cost > budget:
            spent, batch = 0, batch + 1
        spent += cost
        out.append(batch)
    return out, spent, batch


def batches(chunks: DataFrame, budget: int, by: str, order: list[str]) -> DataFrame:
    """Add ``batch`` from 0 within each group ``by``: rows in order, a new batch where the next would exceed ``budget``.

    A row that exceeds it alone has a batch of its own. This is a fold in order, taken in slices, so that
    a group of any size is shared by all tasks.
    """

    def step(spent: int, batch: int, rows: pd.DataFrame):
        numbers, spent, batch = fold(rows["__cost"].tolist(), budget, spent, batch)
        return rows.drop(columns="__cost").assign(batch=np.array(numbers, np.int32)), spent, batch

    rows = chunks.where(F.trim("text") != "").withColumn("__cost", token_estimate(F.trim("text")) + CHUNK_TOKENS)
    return fold_slices(rows, by, order, Fold(step, 0), StructType([*chunks.schema.fields, StructField("batch", IntegerType())]))


def batch_labels(batched: DataFrame, by: str) -> DataFrame:
    """Add ``(part k of n)`` to labels of groups that were split."""
    parts = F.max("batch").over(W.partitionBy(by)) + 1
    return batched.withColumn("label", F.when(parts > 1, F.format_string("%s (part %d of %d)", "label", F.col("batch") + 1, parts)).otherwise(F.col("label")))


def pack_context(chunks: DataFrame, budget: int, by: str, order: list[str]) -> DataFrame:
    """Best first within ``budget`` tokens per group: the rows kept, trimmed; only an oversize first one is ``cut`` to what fits.

    Packing stops at the first row that doesn't fit, so a running sum says which rows are kept.
    """
    w = W.partitionBy(by).orderBy(*order)
    rows = chunks.where(F.trim("text") != "").withColumn("place", F.row_number().over(w)).withColumn("cost", token_estimate(F.trim("text")) + CHUNK_TOKENS)
    spent = F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))
    cut = (F.col("place") == 1) & (F.col("cost") > budget) & (F.lit(budget) > CHUNK_TOKENS)
    kept = rows.withColumn("spent", spent).withColumn("cut", cut).where((F.col("spent") <= budget) | F.col("cut")).drop("spent")
    head = truncate_bytes(F.trim("text"), 2 * (budget - CHUNK_TOKENS))
    return kept.withColumn("text", F.when(F.col("cut"), head).otherwise(F.trim("text"))).where("text <> ''")


class Summariser(Protocol):
    """What writes the summaries: a model behind any interface."""

    context_tokens: int

    def summarise(self, prompt: str, texts: list[tuple[int, str]], reply_tokens: int) -> tuple[str, list[int]]:
        """A text, and the ids it cites."""


@dataclass
class Report:
    markdown: str = ""
    cited: list[int] = field(default_factory=list)
    mode: str = "empty"
    periods_total: int = 0
    periods_covered: int = 0
    frames_sampled: int = 0
    frames_summarized: int = 0
    passes: int = 0
    truncated: bool = False


class Cancelled(Exception):
    pass


Chunk = tuple[int, str, int]  # frame_id, text, captured_at
Group = tuple[str, list[Chunk]]


def fitted(groups: list[Group], budget: int) -> list[Group]:
    """Groups split into parts that fit one pass each; blank chunks and groups without chunks go."""
    out = []
    for label, chunks in groups:
        chunks = [c for c in chunks if c[1].strip()]
        numbers = fold([estimate(c[1].strip()) + CHUNK_TOKENS for c in chunks], budget)[0]
        parts = [[c for c, n in zip(chunks, numbers) if n == k] for k in range(numbers[-1] + 1 if numbers else 0)]
        out += [(f"{label} (part {k + 1} of {len(parts)})" if len(parts) > 1 else label, part) for k, part in enumerate(parts)]
    return out


def relevance_groups(context: DataFrame, reply: int, context_tokens: int) -> list[Group]:
    """``part 1``, ``part 2``, ...: retrieved texts, best first, in groups that fit a pass each; the search's limit bounds them."""
    rows = context.orderBy(F.desc("score"), F.desc("frame_id")).select("frame_id", "text", "captured_at").collect()
    parts = fitted([("", [tuple(r) for r in rows])], per_batch(reply, context_tokens))
    return [(f"part {k + 1}", chunks) for k, (_, chunks) in enumerate(parts)]


def grouped(sampled: DataFrame) -> list[Group]:
    """The groups of ``coverage_groups`` in order of time; quotas bound them."""
    out: dict[str, list[Chunk]] = {}
    for r in sampled.orderBy("captured_at", "frame_id").collect():
        out.setdefault(r.label, []).append((r.frame_id, r.text, r.captured_at))
    return list(out.items())


def generate_report(groups: list[Group], provider: Summariser, periods_total: int, reply_tokens: int = 512, min_frames: int = 20, truncated: bool = False, by_time: bool = True, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[str, int], None] = lambda what, n: None) -> Report:
    """Map, reduce and finish a report over planned groups.

    The plan is bounded (31 periods, 64 passes), so the driver holds it; each pass is one call of the provider.
    ``truncated`` says that the plan left frames out already; ``by_time`` puts a single pass in order of time.
    Only what is summarised from frames cites them.
    """
    groups = [(label, chunks) for label, chunks in groups if any(c[1].strip() for c in chunks)]
    every = [c for _, chunks in groups for c in chunks if c[1].strip()]
    if not every:
        return Report(periods_total=periods_total)
    context = provider.context_tokens or CONTEXT_TOKENS
    reply, cited, passes = reply_budget(reply_tokens, context), {}, 0
    room = per_batch(reply, context)
    out = Report(periods_total=periods_total, periods_covered=len(groups), frames_sampled=len(every), truncated=truncated)

    def call(what: str, prompt: str, texts: list[tuple[int, str]]) -> tuple[str, list[int]]:
        nonlocal passes
        if cancelled():
            raise Cancelled
        text, ids = provider.summarise(prompt, texts, reply)
        passes += 1
        progress(what, passes)
        return text.strip(), ids

    def done(mode: str, markdown: str) -> Report:
        out.mode, out.markdown, out.passes = mode, markdown, passes
        out.cited, out.frames_summarized = list(cited)[:MOST_CITED], len(cited)
        return out

    parts = fitted(groups, room)
    if len(parts) == 1 or (len(every) <= min_frames and sum(estimate(c[1].strip()) + CHUNK_TOKENS for c in every) <= room):
        chunks = sorted(every, key=lambda c: c[2]) if by_time else every
        text, ids = call("final", FINAL_PROMPT, [c[:2] for c in chunks])
        cited.update(dict.fromkeys(ids))
        return done("single_pass", text)

    nodes = []
    for label, chunks in parts:
        text, ids = call("map", MAP_PROMPT, [c[:2] for c in chunks])
        if text:
            cited.update(dict.fromkeys(ids))
            nodes.append(f"{label}: {text}")
        if passes >= MOST_PASSES:
            out.truncated = True
            break
    if not nodes:
        return Report(periods_total=periods_total)
    last_room = context - reply - estimate(FINAL_PROMPT) - PROMPT_TOKENS
    as_texts = lambda some: [(0, n) for n in some]
    while len(nodes) > 1 and sum(estimate(n) + CHUNK_TOKENS for n in nodes) > last_room:
        level = []
        for k in range(0, len(nodes), FAN_IN):
            if passes >= MOST_PASSES:
                out.truncated = True
                break
            some = nodes[k : k + FAN_IN]
            level.append(some[0] if len(some) == 1 else call("reduce", MAP_PROMPT, as_texts(some))[0])
        nodes = level or nodes
        if passes >= MOST_PASSES:
            out.truncated = True
            break
    return done("map_reduce", call("final", FINAL_PROMPT, as_texts(nodes))[0])
