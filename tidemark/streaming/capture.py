"""Captured frames as a stream: a source with an offset for each monitor, and what is done with each frame.

A capturing program drops ``monitor-<n>/<captured_at>.ppm`` files below a root, each with a ``.json`` of the
same name beside it (``app, title, locked, own_window, rect``) that is written first where there is one, and a
file ``END`` when it stops. The stream takes them in order of time, a few at a time from each monitor.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import scalars
from tidemark.operators import classify as cl
from tidemark.sources import images
from tidemark.sources.tables import Store
from tidemark.streaming import stateful as st

CAPTURED = "monitor_index int, captured_at long, content binary, app string, title string, locked boolean, own_window boolean, rect struct<x:float,y:float,w:float,h:float>"
SPAN = "struct<span_index:int,text:string,normalized_text:string,source:string,x:float,y:float,w:float,h:float,line_index:int>"
#: Monitors that frame ids tell apart, and frames that one task reads.
MONITORS, SLICE = 64, 32


def _listed(root: str, folder: str = "") -> tuple[arrow_fs.FileSystem, list[arrow_fs.FileInfo]]:
    system, base = arrow_fs.FileSystem.from_uri(root)
    return system, system.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))


def _context(data: bytes) -> dict:
    try:
        found = json.loads(data)
        return found if isinstance(found, dict) else {}
    except ValueError:
        return {}


def _rect(found: object) -> tuple | None:
    try:
        return tuple(float(found[k]) for k in "xywh")
    except (TypeError, KeyError, ValueError):
        return None


def ended(root: str) -> bool:
    """Whether the capturing program has stopped."""
    return any(f.base_name == "END" for f in _listed(root)[1])


@dataclass
class Files(InputPartition):
    monitor: int
    times: list[int]


class CaptureReader(DataSourceStreamReader):
    """Offsets are the time of the last frame taken from each monitor.

    A batch takes at most ``per_batch`` frames of a monitor, so a backlog is worked off in batches of a bounded
    size. What lies between two offsets stays the same when a batch is read again, as long as the program
    writes the frames of a monitor in order of time.
    """

    def __init__(self, options: dict):
        self.root, self.per_batch, self.at = options["root"].rstrip("/"), int(options.get("perBatch", "256")), None

    def _times(self, monitor: int, after: int | None, upto: int | None = None) -> list[int]:
        found = (f.base_name.removesuffix(".ppm") for f in _listed(self.root, f"monitor-{monitor}")[1] if f.base_name.endswith(".ppm"))
        return sorted(t for t in map(int, (n for n in found if n.isdigit())) if (after is None or t > after) and (upto is None or t <= upto))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        at = dict(self.at or {})
        for f in _listed(self.root)[1]:
            name, _, number = f.base_name.partition("monitor-")
            if not name and number.isdigit():
                new = self._times(int(number), at.get(number))[: self.per_batch]
                if new:
                    at[number] = new[-1]
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.at = end if self.at is None else self.at
        out = []
        for number, last in end.items():
            times = self._times(int(number), start.get(number), last)
            out += [Files(int(number), times[k : k + SLICE]) for k in range(0, len(times), SLICE)]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = arrow_fs.FileSystem.from_uri(self.root)

        def content(name: str) -> bytes | None:
            try:
                with system.open_input_stream(f"{base}/monitor-{partition.monitor}/{name}", compression=None) as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for t in partition.times:
            about = _context(content(f"{t}.json") or b"{}")
            flag, text = (lambda k: about.get(k) is True), (lambda k: about[k] if isinstance(about.get(k), str) else None)
            yield partition.monitor, t, content(f"{t}.ppm"), text("app"), text("title"), flag("locked"), flag("own_window"), _rect(about.get("rect"))


class CaptureSource(DataSource):
    """``spark.readStream.format("captures").option("root", ...)``, once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURED

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def captures(spark: SparkSession, root: str, per_batch: int = 256) -> DataFrame:
    """The stream of captured frames, with ids that follow from time and monitor."""
    spark.dataSource.register(CaptureSource)
    df = spark.readStream.format("captures").option("root", root).option("perBatch", str(per_batch)).load()
    return df.withColumn("frame_id", F.col("captured_at") * MONITORS + F.col("monitor_index"))


def changed_frames(frames: DataFrame, denied: list[str], threshold: float = st.THRESHOLD) -> DataFrame:
    """What is worth storing: past the privacy gate, and unlike the last frame kept on its monitor.

    Denied frames are dropped before their pixels are looked at. Frames that can't be read come with their error.
    """
    allowed = frames.where(scalars.may_capture(F.col("locked"), F.col("own_window"), F.col("app"), F.col("title"), denied))
    return st.change_gate_stream(images.with_luma(allowed), threshold)


def recognised(frames: DataFrame, recognise: Callable[[object], list[dict]], folder: images.Folder, most_columns: int = 1920) -> DataFrame:
    """Frames with their ``spans`` and stored image, or with the ``error`` that the frame met.

    Text is recognised on the whole image, and a smaller one is stored under the day of the frame. A frame's
    fault ends neither the task nor the stream. Paths follow from time and monitor, so a task that runs
    again writes the same files.
    """
    names = ["span_index", "text", "normalized_text", "source", "x", "y", "w", "h", "line_index"]

    def one(row) -> tuple[list | None, str | None]:
        if row.error:
            return None, row.error
        try:
            pixels = images.decode(row.content)
            spans = [{k: s.get(k) for k in names} for s in recognise(pixels)]
        except Exception as e:
            return None, f"recognise: {e}"
        try:
            folder.write(row.image_path, images.encode(images.scaled(pixels, most_columns)))
        except Exception as e:
            return None, f"store: {e}"
        return spans, None

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(row) for row in part.itertuples()]
            yield part.drop(columns=["content", "luma", "error"]).assign(spans=pd.Series([s for s, _ in found], part.index, object), error=pd.Series([e for _, e in found], part.index, object))

    placed = frames.withColumn("image_path", F.format_string("frames/day-%d/%d-%d.ppm", F.floor(F.col("captured_at") / st.DAY_MS), F.col("captured_at"), F.col("monitor_index"))).withColumn("content_hash", F.sha2("content", 256))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name not in ("content", "luma", "error"))
    return placed.mapInPandas(each, f"{kinds}, spans array<{SPAN}>, error string")


def set_aside(store: Store) -> DataFrame:
    """``frame_id, monitor_index, captured_at, error, batch`` of frames that could not be stored."""
    kinds = "frame_id long, monitor_index int, captured_at long, error string, batch string"
    path = f"{store.root}/_errors"
    at = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(at)
    return store.spark.read.schema(kinds).parquet(path) if there else store.spark.createDataFrame([], kinds)


def ingest_captures(frames: DataFrame, store: Store, recognise: Callable, folder: images.Folder, clock: Callable[[], int], config: cl.Config = cl.Config(), most_columns: int = 1920, name: str = "capture"):
    """A ``writeStream`` of changed frames: recognise, store the image, set errors aside, insert and enqueue.

    A batch that is run again replaces what it wrote, so a restart from the checkpoint neither loses nor
    repeats a frame. Images are written before the rows that name them.
    """

    def batch(df: DataFrame, number: int) -> None:
        key = f"{name}-{number}"
        done = recognised(df, recognise, folder, most_columns).persist()
        done.where("error IS NOT NULL").select("frame_id", "monitor_index", "captured_at", "error").write.mode("overwrite").parquet(f"{store.root}/_errors/batch={key}")
        good = done.where("error IS NULL").withColumns({"seq": F.col("captured_at"), "app_hint": F.col("app"), "window_title": F.col("title"), "browser_url": F.lit(None).cast("string"), "activity_type": F.lit(None).cast("string")})
        spans = good.select("frame_id", F.explode("spans").alias("s")).select("frame_id", "s.*")
        st.ingest_batch(store, good.drop("spans", "error", "locked", "own_window"), spans, clock(), config, key)
        done.unpersist()

    return frames.writeStream.foreachBatch(batch)


def run_to_the_end(query: StreamingQuery, root: str, seconds: float = 1.0) -> None:
    """Wait until the program has stopped and all that it left is stored, then stop the query; its error is raised."""
    while not ended(root):
        if query.awaitTermination(seconds):
            return
    query.processAllAvailable()
    query.stop()
