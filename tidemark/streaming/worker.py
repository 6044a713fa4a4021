"""Work on the queue by itself: workers that back off, a sweep of stale jobs, producers of tagging jobs.

Everything that waits is a ``Timers`` value: when each part is due next. A tick does what is due at its moment
and says when it is due again, so a run is a fold over ticks and can be repeated with a clock of its own. A
stream's trigger makes the ticks (``run``).
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.api import Engine
from tidemark.operators import insights, queue

#: Fixed values, in ms: between sweeps, until a running job counts as lost, least interval of the timer
#: producer, between looks at a timer that is off, between looks of the idle producer and while it has a backlog.
SWEEP, LOST, LEAST_INTERVAL, OFF_LOOK, IDLE_LOOK, DRAIN_LOOK = 60_000, 300_000, 60_000, 30_000, 30_000, 5_000

#: What does the jobs of one kind: claimed jobs in, the columns of ``queue.route_outcomes`` out.
Provider = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """What producers may do; read anew at each tick that they are due."""

    timer: bool = False
    interval_ms: int = 300_000
    idle: bool = False
    idle_ms: int = 300_000
    batch: int = 20


@dataclass(frozen=True)
class Timers:
    """When each part is due next (None: not set yet), how long the worker waited last, and whether models stay loaded."""

    work: int = 0
    waited: int = 0
    sweep: int | None = None
    timer: int | None = None
    idle: int | None = None
    warm: bool = False


@dataclass(frozen=True)
class Done:
    """What a tick did: jobs worked on, put back and queued."""

    worked: int = 0
    swept: int = 0
    queued: int = 0


@dataclass
class Pool:
    """Workers of one process over one store: they take turns at writing, and work at the same time.

    The claim of a job is stored before its work begins and no other claim runs meanwhile, so no job is
    claimed twice. The sweep waits while jobs of this process run. Kinds without a provider stay in the queue.
    """

    engine: Engine
    providers: dict[str, Provider]
    settings: Callable[[], Settings] = Settings
    idle_for: Callable[[], int | None] = lambda: None
    batch: int = 1
    _turn: threading.RLock = field(default_factory=threading.RLock)
    _active: int = 0

    @contextmanager
    def _working(self, n: int) -> Iterator[None]:
        with self._turn:
            self._active += n
        try:
            yield
        finally:
            with self._turn:
                self._active -= n

    def work(self, now: int) -> int:
        """Claim due jobs, do them and finish them; how many there were. Jobs whose provider raises come again later."""
        with self._turn:
            running = self.engine.claim_jobs(sorted(self.providers), self.batch, now) if self.providers else None
            rows = running.collect() if running is not None else []  # at most ``batch``
        if not rows:
            return 0
        with self._working(len(rows)):
            found = [row for kind in sorted({r.kind for r in rows}) for row in self._finished(kind, [r for r in rows if r.kind == kind], running.schema, now)]
            with self._turn:
                self.engine.store.change("jobs", self.engine.store.spark.createDataFrame(found, running.schema))
        return len(rows)

    def _finished(self, kind: str, rows: list, shape, now: int) -> list:
        jobs = self.engine.store.spark.createDataFrame(rows, shape)
        try:
            return queue.finished(jobs, self.providers[kind](jobs), now).collect()
        except Exception as e:  # the provider's fault is the jobs' to keep
            failed = jobs.select("job_id", F.coalesce("frame_id", F.lit(0)).alias("frame_id"), "attempts", F.lit(True).alias("frame_exists"), F.lit("x").alias("text"), F.lit(False).alias("needs_image"), F.lit(None).cast("string").alias("image_state"), F.lit(False).alias("provider_ok"))
            return queue.finished(jobs, failed, now).withColumn("last_error", F.lit(str(e)[:1000])).collect()

    def sweep(self, now: int, older_ms: int = LOST) -> int:
        """Jobs put back that have run for too long; none while jobs run here."""
        with self._turn:
            return 0 if self._active else self.engine.sweep_stale(now, older_ms)

    def produce(self, now: int, batch: int) -> int:
        """Queue tagging of the oldest untagged frames; how many there were. Two producers never queue the same frame."""
        with self._turn:
            store = self.engine.store
            jobs = store.read("jobs")
            ids = insights.untagged_frames(store.read("frames"), store.read("vision_analysis"), jobs, batch).collect()  # at most ``batch``
            if ids:
                frames = store.spark.createDataFrame(ids, "frame_id long, captured_at long")
                store.change("jobs", queue.new_tag_requests(jobs, frames, now, batch, priority=0))
            return len(ids)

    def tick(self, timers: Timers, now: int) -> tuple[Timers, Done]:
        """Do what is due, and say when it is due again."""
        worked = swept = queued = 0
        if now >= timers.work:
            worked = self.work(now)
            waited = 0 if worked else queue.idle_wait_ms(timers.waited)
            timers = replace(timers, waited=waited, work=now + waited)
        if timers.sweep is None:
            timers = replace(timers, sweep=now + SWEEP)
        elif now >= timers.sweep:
            swept = self.sweep(now)
            timers = replace(timers, sweep=now + SWEEP)
        timers, queued = self._by_timer(timers, now)
        timers, more = self._when_idle(timers, now)
        return timers, Done(worked, swept, queued + more)

    def _by_timer(self, timers: Timers, now: int) -> tuple[Timers, int]:
        if timers.timer is not None and now < timers.timer:
            return timers, 0
        s = self.settings()
        queued = self.produce(now, s.batch) if s.timer and timers.timer is not None else 0
        return replace(timers, timer=now + (max(s.interval_ms, LEAST_INTERVAL) if s.timer else OFF_LOOK)), queued

    def _when_idle(self, timers: Timers, now: int) -> tuple[Timers, int]:
        """While nobody uses the machine, keep a quarter of a batch in flight, and models loaded until all is tagged."""
        if timers.idle is None:
            return replace(timers, idle=now + IDLE_LOOK), 0
        if now < timers.idle:
            return timers, 0
        s, queued, warm, quiet = self.settings(), 0, False, self.idle_for()
        if s.idle and quiet is not None and quiet >= s.idle_ms:
            in_flight = queue.pending_vision(self.engine.store.read("jobs")).first().n
            if queue.wants_refill(True, in_flight, s.batch):
                queued = self.produce(now, s.batch)
                warm = queued > 0
            else:
                warm = True
        return replace(timers, warm=warm, idle=now + (DRAIN_LOOK if warm else IDLE_LOOK)), queued


def run(ticks: DataFrame, pool: Pool, clock: Callable[[], int], seen: Callable[[Timers, Done], None] = lambda timers, done: None):
    """A ``writeStream`` that ticks once for each batch of a stream, as a rate source with a trigger gives them.

    Timers begin anew when the stream does, as after a crash; jobs that were running then are found by the sweep.
    """
    state = [Timers()]

    def batch(df: DataFrame, number: int) -> None:
        state[0], done = pool.tick(state[0], clock())
        seen(state[0], done)

    return ticks.writeStream.foreachBatch(batch)
