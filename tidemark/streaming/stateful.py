"""Stateful operators: the change gate, the splitter of thinking segments, and streamed ingest."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import schema
from tidemark.operators import classify as cl
from tidemark.operators import queue
from tidemark.operators.timeseries import within
from tidemark.plans.folds import Fold, fold_slices
from tidemark.schema import DAY_MS
from tidemark.sources.images import GRID, fingerprint  # noqa: F401 (what the gate compares)
from tidemark.sources.tables import Store

#: Fixed value: change that keeps a frame.
THRESHOLD = 0.006


def difference(a: np.ndarray, b: np.ndarray, same_size: bool = True) -> float:
    """Mean absolute difference as a part of the full range; another size is a full change."""
    if not same_size or len(a) != len(b):
        return 1.0
    return float(np.abs(a.astype(np.int64) - b.astype(np.int64)).sum()) / (len(a) * 255.0)


def change_gate(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``monitor_index, captured_at, luma array<int>, ...`` that differ from the last row kept on their monitor.

    The reference row moves only when a row is kept, so this is a fold in order of time; it is taken in slices,
    so that one monitor with all rows is shared by all tasks.
    """

    def step(last: list[int] | None, number: int, rows: pd.DataFrame):
        keep, last = np.zeros(len(rows), bool), None if last is None else np.array(last)
        for k, luma in enumerate(rows["luma"]):
            if last is None or difference(last, luma) > threshold:
                last, keep[k] = luma, True
        return rows[keep], [int(x) for x in last], number

    order = ["captured_at", *(c for c in ("frame_id",) if c in df.columns)]
    return fold_slices(df, "monitor_index", order, Fold(step), df.schema)


def change_gate_stream(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The change gate over a stream; the last kept row of each monitor is state.

    Rows whose image can't be read have no ``luma``: they are kept, so that they can be set aside, and move nothing.
    """

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get[0]) if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values("captured_at", ignore_index=True)
            keep = np.zeros(len(pdf), bool)
            for k, luma in enumerate(pdf["luma"]):
                if luma is None:
                    keep[k] = True
                    continue
                luma = np.asarray(luma)
                if last is None or difference(last, luma) > threshold:
                    last, keep[k] = luma, True
            yield pdf[keep]
        if last is not None:
            state.update(([int(x) for x in last],))

    return df.groupBy("monitor_index").applyInPandasWithState(gate, df.schema, "luma array<int>", "append", GroupStateTimeout.NoTimeout)


class Splitter:
    """Splits text that comes in pieces into thinking and spoken segments.

    A tail that may be the beginning of the next tag waits for the next piece.
    """

    TAGS = ("<think>", "</think>")

    def __init__(self, thinking: bool = False, held: str = ""):
        self.thinking, self.held = thinking, held

    def push(self, piece: str, last: bool = False) -> list[tuple[bool, str]]:
        return [(thinking, said) for _, thinking, said in self.numbered(piece, 0, last)[0]]

    def numbered(self, piece: str, tags: int, last: bool = False) -> tuple[list[tuple[int, bool, str]], int]:
        """Segments with the number of tags before them, of which there were ``tags``; and the number after the piece."""
        text, out = self.held + piece, []
        while True:
            before, tag, after = text.partition(self.TAGS[self.thinking])
            if not tag:
                break
            if before:
                out.append((tags, self.thinking, before))
            self.thinking, text, tags = not self.thinking, after, tags + 1
        wait = "" if last else self._tail(text)
        if said := text[: len(text) - len(wait)]:
            out.append((tags, self.thinking, said))
        self.held = wait
        return out, tags

    def _tail(self, text: str) -> str:
        tag = self.TAGS[self.thinking]
        beginnings = "|".join(re.escape(tag[:k]) for k in range(len(tag) - 1, 0, -1))
        return m.group() if (m := re.search(f"(?:{beginnings})$", text)) else ""


SEGMENTS = "stream_id long, seq long, thinking boolean, text string"


def split_think_stream(df: DataFrame) -> DataFrame:
    """Segments of ``stream_id, seq, text`` pieces; mode and held tail of each stream are state."""

    def split(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        splitter = Splitter(*state.get) if state.exists else Splitter()
        for pdf in frames:
            rows = [(key[0], r.seq, *segment) for r in pdf.sort_values("seq").itertuples() for segment in splitter.push(r.text)]
            yield pd.DataFrame(rows, columns=["stream_id", "seq", "thinking", "text"])
        state.update((splitter.thinking, splitter.held))

    return df.groupBy("stream_id").applyInPandasWithState(split, SEGMENTS, "thinking boolean, held string", "append", GroupStateTimeout.NoTimeout)


def split_think(pieces: DataFrame) -> DataFrame:
    """``stream_id, seq, thinking, text`` segments of whole streams, numbered from 0 by the tags before them.

    A closing tag in speech, or an opening one in thought, is text. Pieces pass through in slices of order with
    the mode and the open tail as state, so a stream may be of any length; a segment is one row.
    """
    names = ["stream_id", "seq", "piece", "part", "text"]

    def rows_of(found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names)

    def step(state: list, tags: int, rows: pd.DataFrame):
        splitter, out = Splitter(*state[:2]), []
        for stream, at, text in zip(rows["stream_id"], rows["seq"], rows["text"]):
            found, tags = splitter.numbered(text or "", tags)
            out += [(stream, n, at, part, said) for part, (n, _, said) in enumerate(found)]
        return rows_of(out), [splitter.thinking, splitter.held, int(at)], tags

    def finish(state: list, tags: int, stream) -> pd.DataFrame | None:
        found, _ = Splitter(*state[:2]).numbered("", tags, last=True)
        return rows_of([(stream, n, state[2], 1 << 30, said) for n, _, said in found]) if found else None

    own = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), "text")
    kind = own.schema["stream_id"].dataType.simpleString()
    cut = fold_slices(own, "stream_id", ["seq"], Fold(step, [False, "", 0], finish), f"stream_id {kind}, seq long, piece long, part int, text string")
    joined = cut.groupBy("stream_id", "seq").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY piece, part)").alias("text"))
    return joined.select("stream_id", "seq", (F.col("seq") % 2 == 1).alias("thinking"), "text")


def until_done(lines: DataFrame, by: str, order: str, done: str = "done") -> DataFrame:
    """The lines of each stream up to the first that ends it; what a server sends after that isn't read."""
    end = lines.where(done).groupBy(by).agg(F.min(order).alias("__end"))
    return lines.join(end, by, "left").where(F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end")


def _said(line: bytes) -> list[tuple[str, str | None]]:
    """Pieces of one server-sent line: reasoning, content, or the end; none for comments, blanks and what isn't JSON."""
    prefix, _, data = line.decode("utf-8", "replace").partition("data:")
    data = data.strip()
    if prefix or not data:
        return []
    if data == "[DONE]":
        return [("done", None)]
    try:
        delta = json.loads(data)["choices"][0].get("delta") or {}
        return [(kind, delta[name]) for kind, name in (("reasoning", "reasoning_content"), ("content", "content")) if isinstance(delta.get(name), str) and delta[name]]
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        return []


def sse_pieces(chunks: DataFrame) -> DataFrame:
    """``stream_id, seq, part, kind, text`` from ``stream_id, seq, data binary``: what a server has sent, as it arrived.

    Chunks may end anywhere, within a line or a character: an open line waits for the next chunk (``seq`` is
    that of the chunk that ends it), and only whole lines are decoded. Nothing after ``[DONE]`` counts; a
    stream that ends without it is done after its last chunk, and its open line isn't read.
    """
    names = ["stream_id", "seq", "part", "kind", "text"]

    def step(state: list, number: int, rows: pd.DataFrame):
        held, ended, out = bytes.fromhex(state[0]), state[1], []
        for stream, at, data in zip(rows["stream_id"], rows["seq"], rows["data"]):
            *lines, held = (held + (data or b"")).split(b"\n") if not ended else (b"",)
            found = []
            for line in lines:
                found += [] if ended else _said(line)
                ended = ended or ("done", None) in found
            out += [(stream, at, part, *piece) for part, piece in enumerate(found)]
        return pd.DataFrame(out, columns=names, dtype=object), [held.hex(), ended, int(at)], number

    def finish(state: list, number: int, stream) -> pd.DataFrame | None:
        return None if state[1] else pd.DataFrame([(stream, state[2], 1 << 30, "done", None)], columns=names, dtype=object)

    own = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"))
    kind = own.schema["stream_id"].dataType.simpleString()
    return fold_slices(own, "stream_id", ["seq"], Fold(step, ["", False, 0], finish), f"stream_id {kind}, seq long, part int, kind string, text string")


def catalog(store: Store, min_seen: int = cl.Config().min_seen, without: str | None = None) -> DataFrame:
    """The catalog of repeated lines: sightings are appended batch by batch and added up here.

    Finished batches are summed by twos, so few files are read, whatever the number of batches.
    """
    return _added_up(store.partly_summed("chrome_text_catalog", without), min_seen)


def _added_up(rows: DataFrame, min_seen: int) -> DataFrame:
    return cl.merge_catalog(rows.limit(0), rows, min_seen)


def ingest_batch(store: Store, frames: DataFrame, spans: DataFrame, now: int, config: cl.Config = cl.Config(), batch: str | None = None) -> None:
    """One micro-batch: classify against the catalog as it was before, then append to every table.

    ``frames`` holds the columns of the frames table and ``seq, app, title, rect``. Frames that another
    batch stored are left out. Nothing stored is rewritten: each table gets the files of this batch, in
    directories by day. Frames come last and say that the batch is done; a batch that failed before, run
    again under its name (a hash of its frames if none is given), replaces what it wrote, and all that it
    reads leaves out its own files, so the result is that of one run.
    """
    low, high, key = frames.agg(F.min("captured_at"), F.max("captured_at"), F.sum(F.xxhash64("frame_id").cast("decimal(38,0)"))).first()
    if low is None:
        return
    batch = batch or f"frames{key}"
    done = within(store.read("frames", batch), low, high + 1).select("frame_id")
    frames = store.living("frames", frames.join(done, "frame_id", "left_anti")).withColumn("day", F.floor(F.col("captured_at") / DAY_MS).cast("int"))
    spans = spans.join(frames.select("frame_id", "day"), "frame_id")
    lines = cl.line_roles(spans, frames, config, catalog(store, config.min_seen, batch)).persist()  # for three tables
    classified = cl.classify_spans(spans, lines)
    raw = cl.lines_of(spans).groupBy("frame_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda s: s["text"]), "\n").alias("raw_text"))
    texts = frames.select("frame_id", "day", F.col("title").alias("target_title"), F.col("app").alias("target_app")).join(raw, "frame_id", "left").join(cl.content_texts(lines), "frame_id", "left").join(cl.suppressed_counts(classified), "frame_id", "left")
    texts = texts.withColumns({"raw_text": F.coalesce("raw_text", F.lit("")), "content_text": F.coalesce("content_text", F.lit("")), "suppressed_count": F.coalesce("suppressed_count", F.lit(0)).cast("int"), "primary_source": F.lit("ocr"), "filter_version": F.lit(cl.FILTER_VERSION)})
    _append(store, frames, texts, now, batch, {"text_spans": classified, "chrome_text_catalog": cl.observations(lines, now).withColumn("suppressed", F.col("seen_count") >= config.min_seen)})
    store.sum_up("chrome_text_catalog", batch, lambda rows: _added_up(rows, config.min_seen))
    lines.unpersist()


def _append(store: Store, frames: DataFrame, texts: DataFrame, now: int, batch: str, others: dict[str, DataFrame]) -> None:
    """The files of one batch, frames last; a job that is queued already isn't queued again."""
    jobs = store.read("jobs", batch)
    new = frames.select("frame_id", F.lit("embed_text").alias("kind"), F.col("frame_id").alias("seq")).join(jobs.select("frame_id", "kind"), ["frame_id", "kind"], "left_anti")
    for name, rows in (others | {"frame_text": texts, "jobs": queue.numbered(jobs, new, now), "frames": frames}).items():
        columns = [*schema.TABLES[name].names, *(["day"] if name in schema.BY_DAY else [])]
        store.append(name, rows.select(*columns), batch)


def ingest_plain(store: Store, frames: DataFrame, texts: DataFrame, now: int, batch: str) -> None:
    """Frames with ``frame_id, raw_text`` taken as they are: the content is the raw text, of filter version 0, nothing suppressed."""
    low, high = frames.agg(F.min("captured_at"), F.max("captured_at")).first()
    if low is None:
        return
    done = within(store.read("frames", batch), low, high + 1).select("frame_id")
    frames = store.living("frames", frames.join(done, "frame_id", "left_anti")).withColumn("day", F.floor(F.col("captured_at") / DAY_MS).cast("int"))
    text = F.coalesce("raw_text", F.lit(""))
    none = F.lit(None).cast("string")
    rows = frames.select("frame_id", "day").join(texts.select("frame_id", "raw_text"), "frame_id", "left")
    rows = rows.select("frame_id", "day", text.alias("raw_text"), text.alias("content_text"), F.lit("ocr").alias("primary_source"), F.lit(0).alias("filter_version"), F.lit(0).alias("suppressed_count"), none.alias("target_title"), none.alias("target_app"))
    _append(store, frames, rows, now, batch, {})


def ingest_stream(stream: DataFrame, store: Store, clock: Callable[[], int], config: cl.Config = cl.Config(), name: str = "stream"):
    """A ``writeStream`` that ingests frames whose ``spans`` come as an array of structs.

    Batches are named by the stream's ``name`` and their number, which stays the same when one is run again.
    """

    def batch(df: DataFrame, number: int) -> None:
        spans = df.select("frame_id", F.explode("spans").alias("s")).select("frame_id", "s.*")
        ingest_batch(store, df.drop("spans"), spans, clock(), config, f"{name}-{number}")

    return stream.writeStream.foreachBatch(batch)


def debounce(df: DataFrame, gap: str = "800 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """One row per burst of events closer together than ``gap``; later events than ``delay`` are dropped by the watermark."""
    return df.withWatermark("ts", delay).groupBy(F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "n")
