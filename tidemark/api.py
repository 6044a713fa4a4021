"""The command surface: typed calls with the limits that clients are held to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import scalars
from tidemark.operators import classify, insights, queue, retrieval
from tidemark.operators import timeseries as ts
from tidemark.plans import report
from tidemark.providers import Answerer, Asks, Embedder, answer_deltas
from tidemark.sources import images
from tidemark.sources.tables import Store, storage_classes
from tidemark.streaming import stateful

#: Least and largest sizes of answers.
FRAMES, CONTEXT, TIMELINE, INSIGHTS = 500, 50, (120, 2000), (24, 720)
LAYERS = ("content_text", "raw_text")
#: What the segments of an index begin with that stand for deletions.
DELETION = "deletion-"


class Engine:
    """Commands over one store. Without an embedder, searches use text alone.

    ``index_texts`` stores the full-text index; searches use it while it is that of the texts' version.
    """

    def __init__(self, store: Store, embedder: Embedder | None = None, stemmed: bool = True):
        self.store, self.embedder, self.stemmed, self.asks = store, embedder, stemmed, Asks()

    def _t(self, name: str) -> DataFrame:
        return self.store.read(name)

    def corpus(self) -> retrieval.Corpus:
        return retrieval.Corpus(self._t("frames"), self._t("frame_text"), self._t("embeddings"), self.stemmed, self.indexes())

    def _index_path(self, layer: str) -> str:
        version = (self.store.versions("frame_text") or [0])[-1]
        return f"{self.store.root}/_index-3/{layer}-{'stems' if self.stemmed else 'words'}-v{version}"

    def index_texts(self) -> None:
        """Bring the stored index up to the texts: the texts of a version are one segment, and so is each batch since.

        A deletion takes the deleted texts off the totals, so scores are those of an index made anew.
        """
        spark, version = self.store.spark, (self.store.versions("frame_text") or [0])[-1]
        for layer in LAYERS:
            path = self._index_path(layer)
            done = set(retrieval.segments(spark, path))
            texts = spark.read.schema(schema.FRAME_TEXT)
            if version and "texts" not in done:
                retrieval.write_index(texts.parquet(f"{self.store.root}/frame_text/v{version}"), layer, path, self.stemmed, segment="texts")
            for batch in self.store.batches("frame_text"):
                if batch not in done:
                    retrieval.write_index(self.store.batch("frame_text", batch), layer, path, self.stemmed, segment=batch)
            for part in self.store.deletions():
                if f"{DELETION}{part}" not in done:
                    hidden = self.store.stored("frame_text").join(self.store.deleted([part]).select("frame_id").distinct(), "frame_id", "left_semi")
                    retrieval.write_removal(hidden, layer, path, f"{DELETION}{part}", self.stemmed)

    def indexes(self) -> dict[str, retrieval.Index]:
        """The stored indexes that cover all texts and deletions."""
        wanted = {*(["texts"] if self.store.versions("frame_text") else []), *self.store.batches("frame_text"), *(f"{DELETION}{n}" for n in self.store.deletions())}
        paths = {layer: self._index_path(layer) for layer in LAYERS}
        found = {layer: retrieval.read_index(self.store.spark, path) for layer, path in paths.items() if wanted and wanted == set(retrieval.segments(self.store.spark, path))}
        gone = self.store.deleted()
        return found if gone is None else {layer: retrieval.without(index, gone) for layer, index in found.items()}

    def get_settings(self) -> dict:
        """All settings with their defaults, as the types of these and within their limits."""
        stored = {r.key: r.value for r in self._t("settings").collect()}  # a row for each known key at most
        read = {k: scalars.parse_setting(stored.get(k), default) for k, default in scalars.DEFAULTS.items()}
        return {k: scalars.clamp_setting(k, v) if k in scalars.LIMITS else v for k, v in read.items()}

    def set_settings(self, changes: dict) -> None:
        """All changes or none: they are checked first and stored as one change of the table."""
        if unknown := sorted(set(changes) - set(scalars.DEFAULTS)):
            raise KeyError(f"no such settings: {', '.join(unknown)}")
        for k, v in changes.items():
            if not isinstance(v, (int, float) if k in scalars.LIMITS else type(scalars.DEFAULTS[k])) or (isinstance(v, bool) and k in scalars.LIMITS):
                raise TypeError(f"{k} is no {type(scalars.DEFAULTS[k]).__name__}")
        rows = [(k, scalars.format_setting(scalars.clamp_setting(k, v) if k in scalars.LIMITS else v)) for k, v in changes.items()]
        if rows:
            self.store.change("settings", self.store.spark.createDataFrame(rows, schema.SETTINGS))

    def _vector(self, text: str) -> list[float] | None:
        return [float(x) for x in self.embedder.embed([text])[0]] if self.embedder and text.strip() else None

    def search(self, text: str, limit: int = 20, time_range: tuple[int, int] | None = None, include_chrome: bool = False) -> DataFrame:
        start, end = time_range or (schema.MIN_MS, schema.MAX_MS)
        hits = retrieval.search_hits(self.corpus(), text, limit, self._vector(text), start, end, include_chrome)
        return self.store.spark.createDataFrame(hits, retrieval.HITS)

    def ask_context(self, text: str, k: int = 8, budget: int = 4096) -> DataFrame:
        """What an answer is grounded on: retrieved texts packed into a token budget."""
        chunks = retrieval.rag_context(self.corpus(), text, k, self._vector(text)).withColumn("ask", F.lit(0))
        return report.pack_context(chunks, budget, "ask", [F.desc("score"), F.desc("frame_id")])

    def ask(self, text: str, provider: Answerer, k: int = 8, budget: int = 4096, cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, object]]:
        """The deltas of an answer in order: ``("thinking" | "token", text)``, ``("citation", frame_id)``, then ``("done", None)``,
        ``("cancelled", None)`` or ``("error", message)``. At most ``k`` retrieved texts come to the driver."""
        rows = self.ask_context(text, k, budget).orderBy("place").select("frame_id", "text").collect()
        yield from answer_deltas(provider, text, list({r.frame_id: (r.frame_id, r.text) for r in reversed(rows)}.values())[::-1], cancelled)

    def start_ask(self, request: str, text: str, provider: Answerer, k: int = 8, budget: int = 4096) -> Iterator[tuple[str, str, object]]:
        """``ask`` under an id: ``(id, kind, what)`` deltas, which ``cancel_ask`` ends, as does another request with the id."""
        return self.asks.start(request, lambda cancelled: self.ask(text, provider, k, budget, cancelled))

    def cancel_ask(self, request: str) -> bool:
        return self.asks.cancel(request)

    def search_images(self, vector: list[float], limit: int = 20) -> DataFrame:
        """Frames by the distance of their image vectors."""
        images = self._t("image_embeddings").select("frame_id", F.lit(0).alias("chunk_index"), "embedding")
        return retrieval.knn(images, self._t("frames"), vector, retrieval.normalized_limit(limit))

    def get_timeline(self, start: int, end: int, buckets: int) -> DataFrame:
        return ts.timeline_buckets(self._t("frames"), start, end, ts.clamp(buckets, *TIMELINE))

    def get_frames(self, start: int, end: int, limit: int) -> DataFrame:
        return ts.frames_in_range(self._t("frames"), start, end, ts.clamp(limit, 0, FRAMES))

    def get_nearest_frame(self, at: int, start: int = schema.MIN_MS, end: int = schema.MAX_MS) -> DataFrame:
        return ts.nearest_frame(self._t("frames"), at, start, end)

    def get_frame_context(self, at: int, half_window: int, limit_each: int) -> DataFrame:
        return ts.neighbour_frames(self._t("frames"), at, half_window, ts.clamp(limit_each, 0, CONTEXT))

    def get_insights(self, start: int, end: int, buckets: int) -> dict[str, DataFrame]:
        return insights.summary(self._t("frames"), start, end, ts.clamp(buckets, *INSIGHTS))

    def get_frame(self, frame_id: int, tags: DataFrame) -> DataFrame:
        return insights.frame_detail(self._t("frames"), self._t("frame_text"), self._t("vision_analysis"), tags, frame_id)

    def get_text_filter_stats(self) -> DataFrame:
        return insights.suppression_stats(self._t("text_spans"), self._t("frame_text"), schema.FILTER_VERSION)

    def get_job_stats(self) -> DataFrame:
        return queue.stats(self._t("jobs"))

    def get_storage_stats(self) -> DataFrame:
        return storage_classes(self.store.spark, {"tables": self.store.root})

    def enqueue_vision(self, now: int, frame_id: int | None = None, start: int = schema.MIN_MS, end: int = schema.MAX_MS) -> None:
        """One frame as asked, or the untagged ones of a window."""
        frames, jobs = self._t("frames"), self._t("jobs")
        chosen = frames.where(F.col("frame_id") == frame_id) if frame_id is not None else insights.untagged_frames(frames, self._t("vision_analysis"), jobs, 1000, start, end)
        self.store.change("jobs", queue.new_tag_requests(jobs, chosen, now))

    def plan_report(self, start: int, end: int, daily: int = 40, weekly: int = 200) -> DataFrame:
        return report.coverage_groups(self._t("frames"), self._t("frame_text"), start, end, daily, weekly)

    def generate_report(self, start: int, end: int, provider: report.Summariser, prompt: str | None = None, daily: int = 40, weekly: int = 200, min_frames: int = 20, reply_tokens: int = 512, **hooks) -> report.Report:
        """A report over a window: of what is relevant to ``prompt``, else of an even sample of every period.

        It is marked truncated where frames were left out: more frames than sampled, or a full search.
        """
        if prompt and prompt.strip():
            context = provider.context_tokens or report.CONTEXT_TOKENS
            hits = retrieval.hybrid_search(self.corpus(), prompt.strip(), weekly, self._vector(prompt.strip()), start, end)
            found = hits.select("frame_id", "snippet", "score", "captured_at").collect()  # at most ``weekly`` rows
            local = self.store.spark.createDataFrame(found, hits.select("frame_id", "snippet", "score", "captured_at").schema)
            groups = report.relevance_groups(retrieval.with_texts(local, self._t("frame_text"), drop_blank=True), report.reply_budget(reply_tokens, context), context)
            return report.generate_report(groups, provider, len(groups), reply_tokens, min_frames, len(found) >= weekly, by_time=False, **hooks)
        groups = report.grouped(self.plan_report(start, end, daily, weekly))
        there = ts.within(self._t("frames"), start, end).count()
        return report.generate_report(groups, provider, report.grid_size(start, end), reply_tokens, min_frames, sum(len(c) for _, c in groups) < there, **hooks)

    def complete_jobs(self, ids: list[int], now: int) -> None:
        """Finish running jobs; an error if one isn't running. Like all steps of the queue it writes the changed jobs alone."""
        self._finish(ids, lambda jobs, wanted: queue.complete(jobs, wanted, now))

    def fail_jobs(self, ids: list[int], error: str, now: int, retry_at: int | None = None) -> None:
        self._finish(ids, lambda jobs, wanted: queue.fail(jobs, wanted, error, now, retry_at))

    def _finish(self, ids: list[int], step: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        jobs, wanted = self._t("jobs").where(F.col("job_id").isin(ids)), self._ids(ids, "job_id")
        queue.check_running(jobs, wanted)
        self.store.change("jobs", step(jobs, wanted))

    def claim_jobs(self, kinds: list[str], limit: int, now: int) -> DataFrame:
        """The claimed jobs, which are running when this returns."""
        due = queue.claimable(self._t("jobs"), kinds, limit, now)
        ids = [r.job_id for r in due.select("job_id").collect()]  # at most ``limit``
        if ids:
            self.store.change("jobs", queue.claim(self._t("jobs").where(F.col("job_id").isin(ids)), kinds, limit, now))
        return self._t("jobs").where(F.col("job_id").isin(ids))

    def work(self, kinds: list[str], now: int, provider: Callable[[DataFrame], DataFrame], batch: int = 1) -> int:
        """Claim due jobs, do them and finish them; how many there were.

        The claim is stored before the work begins, so jobs of a worker that is lost are found by the sweep.
        """
        running = self.claim_jobs(kinds, batch, now)
        n = running.count()
        if n:
            self.store.change("jobs", queue.finished(running, provider(running), now))
        return n

    def sweep_stale(self, now: int, older_ms: int) -> int:
        """Put jobs that have run for too long back in the queue; how many there were."""
        stale = queue.stale(self._t("jobs"), now, older_ms)
        if n := stale.count():
            self.store.change("jobs", queue.reset_stale(stale, now, older_ms))
        return n

    def sweep_retention(self, now: int, days: int, deleted: Callable[[list[str]], list[bool]], limit: int = 1000) -> int:
        """Delete the oldest expired frames whose files are gone; how many there were.

        ``deleted`` runs in tasks and says of each image whether its file is gone (``images.Remover`` removes files).
        """
        oldest = ts.retention_candidates(self._t("frames"), now, days, limit).select("frame_id")
        return self._delete_with_files(self._t("frames").join(oldest, "frame_id", "left_semi"), deleted)

    def purge_app(self, app: str, batch: int = 256, deleted: Callable[[list[str]], list[bool]] | None = None) -> int:
        """Delete all frames of an application once, images first; how many were deleted.

        A frame whose file stays is kept, and the setting that says that the purge is done is written only when
        no frame is left, so that a later call tries the others again. All frames go in one pass: tasks hand
        ``batch`` paths at a time to ``deleted``, and one deletion holds the frames whose files are gone.
        """
        mark = f"purged:{app.lower()}"
        if self._t("settings").where(F.col("key") == mark).count():
            return 0
        n = self._delete_with_files(ts.of_app(self._t("frames"), app), deleted, batch)
        if not ts.of_app(self._t("frames"), app).limit(1).count():
            self.store.change("settings", self.store.spark.createDataFrame([(mark, "true")], schema.SETTINGS))
        return n

    def _delete_with_files(self, frames: DataFrame, deleted: Callable[[list[str]], list[bool]] | None, batch: int = 256) -> int:
        gone = frames.select("frame_id", "captured_at", "image_path")
        if not gone.limit(1).count():
            return 0
        part = self.store.delete(gone if deleted is None else images.without_files(gone, deleted, batch))
        return self.store.deleted([part]).count()

    def _ids(self, ids: list[int], name: str) -> DataFrame:
        return self.store.spark.createDataFrame([(i,) for i in ids], f"{name} long")

    def backfill(self, config: classify.Config = classify.Config()) -> int:
        """Re-clean older texts, queue the changed ones for embedding, and say how many there were."""
        out = classify.backfill(self._t("frame_text"), self._t("text_spans"), self._t("embeddings"), stateful.catalog(self.store, config.min_seen), config)
        changed = out["changed"].select("frame_id", F.lit("embed_text").alias("kind"), F.col("frame_id").alias("seq"))
        n = changed.count()
        if n:
            self.store.change("jobs", queue.numbered(self._t("jobs"), changed, 0))
        for name, key in (("embeddings", "embeddings"), ("text_spans", "spans"), ("frame_text", "frame_text")):  # texts last: they say what is done
            self.store.write(name, out[key].select(*schema.TABLES[name].names))
        return n

    def delete_frames(self, ids: DataFrame) -> None:
        """Frames and all that hangs off them."""
        self.store.delete(self._t("frames").join(ids.select("frame_id").distinct(), "frame_id", "left_semi"))
