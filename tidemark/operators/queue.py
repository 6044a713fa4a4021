"""The job queue as transitions of a jobs DataFrame, and other changes to tables.

Every transition is pure: it takes the current version and returns the next one. One writer at a time
stores it (``sources.tables.Store``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import timeseries as ts

BACKOFF_BASE_MS, BACKOFF_MOST_MS = 1000, 60_000

#: Jobs that are numbered together, about; jobs that one claim may take.
SLICE, MOST_CLAIMED = 100_000, 100_000


def stats(jobs: DataFrame) -> DataFrame:
    """One row with a column per state; states without jobs count zero."""
    return jobs.agg(*(F.count_if(F.col("state") == s).alias(s) for s in schema.JOB_STATES))


def pending_vision(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("kind") == "vision_tag") & F.col("state").isin("pending", "running")).agg(F.count("*").alias("n"))


def numbered(jobs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """New pending jobs with the columns of ``jobs``; ids continue after the largest one in the order of the caller's ``seq``.

    Ranks are taken within slices of ``seq`` and shifted by the counts of the slices before.
    """
    top = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("top"))  # one row
    sliced = new.withColumn("__slice", F.floor(F.col("seq") / SLICE))
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    shift = sliced.groupBy("__slice").agg(F.count("*").alias("n")).select("__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(W.partitionBy("__slice").orderBy("seq", *(c for c in ("frame_id", "kind") if c in new.columns)))
    placed = sliced.withColumn("own", own).join(shift, "__slice").join(F.broadcast(top))
    fixed = {"job_id": F.col("own") + F.col("shift") + F.col("top"), "state": F.lit("pending"), "attempts": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "updated_at": F.lit(now).cast("long")}
    defaults = {"priority": F.lit(0).cast("long"), "max_attempts": F.lit(3).cast("long"), "not_before": F.lit(0).cast("long"), "frame_id": F.lit(None).cast("long")}
    return placed.withColumns(fixed | {c: d for c, d in defaults.items() if c not in new.columns}).select(*jobs.columns)


def enqueue(jobs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """The queue with new pending jobs."""
    return jobs.unionByName(numbered(jobs, new, now))


def claimable(jobs: DataFrame, kinds: list[str], limit: int, now: int) -> DataFrame:
    """The next jobs to run: due, of the kinds asked for, highest priority first, then by id."""
    if not kinds or limit <= 0:
        return jobs.limit(0)
    due = jobs.where((F.col("state") == "pending") & (F.col("not_before") <= now) & F.col("kind").isin(*kinds))
    return due.orderBy(F.desc("priority"), "job_id").limit(limit)


def claim(jobs: DataFrame, kinds: list[str], limit: int, now: int) -> DataFrame:
    """The queue after the claim; claimed jobs are running. They are broadcast, so their number is checked."""
    if limit > MOST_CLAIMED:
        raise ValueError(f"one claim takes at most {MOST_CLAIMED} jobs")
    taken = claimable(jobs, kinds, limit, now).select("job_id", F.lit(True).alias("taken"))
    out = jobs.join(F.broadcast(taken), "job_id", "left")  # at most ``limit`` rows
    return out.withColumn("state", F.when(F.col("taken"), "running").otherwise(F.col("state"))).withColumn("updated_at", F.when(F.col("taken"), now).otherwise(F.col("updated_at"))).select(*jobs.columns)


def _change(jobs: DataFrame, ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
    hit = F.col("hit") & (F.col("state") == "running")
    out = jobs.join(ids.select("job_id", F.lit(True).alias("hit")), "job_id", "left")
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*jobs.columns)


def not_running(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that can't be finished."""
    return ids.select("job_id").join(jobs.where("state = 'running'"), "job_id", "left_anti")


def check_running(jobs: DataFrame, ids: DataFrame) -> None:
    """Raise if a job isn't there or isn't running."""
    if wrong := not_running(jobs, ids).orderBy("job_id").limit(5).collect():
        raise LookupError(f"jobs that aren't running: {', '.join(str(r.job_id) for r in wrong)}")


def retention_sweep(frames: DataFrame, now: int, days: int, deleted: Callable[[list[str]], list[bool]], limit: int = 1000) -> DataFrame:
    """``frame_id`` of at most ``limit`` expired frames whose image file ``deleted`` has removed; a frame whose file stays is kept."""
    rows = ts.retention_candidates(frames, now, days, limit).collect()  # at most ``limit`` rows
    gone = deleted([r.image_path for r in rows])
    return frames.sparkSession.createDataFrame([(r.frame_id,) for r, ok in zip(rows, gone) if ok], "frame_id long")


def work_once(jobs: DataFrame, kinds: list[str], now: int, work: Callable[[DataFrame], DataFrame], batch: int = 1) -> tuple[DataFrame, int]:
    """Claim up to ``batch`` due jobs, do them and finish them: the queue afterwards, and how many there were.

    ``work`` gets the claimed jobs and returns ``job_id`` and the columns of ``route_outcomes``.
    """
    taken = claimable(jobs, kinds, batch, now)
    ids = [r.job_id for r in taken.select("job_id").collect()]
    if not ids:
        return jobs, 0
    running = claim(jobs, kinds, batch, now)
    done = finished(running.where(F.col("job_id").isin(ids)), work(running.where(F.col("job_id").isin(ids))), now)
    return running.where(~F.col("job_id").isin(ids)).unionByName(done), len(ids)


def finished(running: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Running jobs as the results of their work (the columns of ``route_outcomes``) leave them."""
    out = running.join(route_outcomes(results, now), "job_id", "left")
    again = (F.col("outcome") == "retry") & (F.col("attempts") + 1 < F.col("max_attempts"))
    failed = F.col("outcome").isin("retry", "dead")
    changes = {
        "state": F.when(F.col("outcome") == "done", "done").when(again, "pending").when(failed, "dead").otherwise(F.col("state")),
        "not_before": F.when(again, F.col("retry_at")).otherwise(F.col("not_before")).cast("long"),
        "last_error": F.when(failed, F.coalesce("last_error", F.lit("the provider failed"))).otherwise(F.col("last_error")),
        "updated_at": F.when(F.col("outcome").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).cast("long"),
        "attempts": F.col("attempts") + F.when(failed, 1).otherwise(0),
    }
    return out.select(*(changes[c].alias(c) if c in changes else F.col(c) for c in running.columns))


def idle_wait_ms(waited: int) -> int:
    """How long a worker without jobs waits: 250 ms, doubled up to two seconds."""
    return min(2 * waited, 2000) if waited else 250


def refill(idle: bool, in_flight: int, batch: int, backlog: int) -> tuple[int, bool]:
    """How many frames an idle producer adds, and whether models stay loaded because there was a backlog."""
    take = min(batch, backlog) if wants_refill(idle, in_flight, batch) else 0
    return take, take > 0

def complete(jobs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    return _change(jobs, ids, {"state": F.lit("done"), "updated_at": F.lit(now).cast("long")})


def fail(jobs: DataFrame, ids: DataFrame, error: str, now: int, retry_at: int | None = None) -> DataFrame:
    """One more attempt; pending again if a time for it is given and attempts are left, else dead."""
    again = (F.col("attempts") + 1 < F.col("max_attempts")) if retry_at is not None else F.lit(False)
    changes = {
        "state": F.when(again, "pending").otherwise("dead"),
        "not_before": F.when(again, F.lit(retry_at)).otherwise(F.col("not_before")).cast("long"),
        "attempts": F.col("attempts") + 1,
        "last_error": F.lit(error),
        "updated_at": F.lit(now).cast("long"),
    }
    return _change(jobs, ids, changes)


def reset_stale(jobs: DataFrame, now: int, older_ms: int) -> DataFrame:
    """Running jobs untouched for ``older_ms`` are pending again; 0 or less resets all. Attempts stay."""
    late = _is_stale(now, older_ms)
    return jobs.withColumns({"updated_at": F.when(late, now).otherwise(F.col("updated_at")), "state": F.when(late, "pending").otherwise(F.col("state"))}).select(*jobs.columns)


def _is_stale(now: int, older_ms: int) -> Column:
    return (F.col("state") == "running") & ((F.col("updated_at") <= now - older_ms) if older_ms > 0 else F.lit(True))


def stale(jobs: DataFrame, now: int, older_ms: int) -> DataFrame:
    """The jobs that ``reset_stale`` changes."""
    return jobs.where(_is_stale(now, older_ms))


def backoff_ms(attempts: Column) -> Column:
    """1 s doubled for each attempt, at most a minute."""
    return F.least(F.lit(BACKOFF_BASE_MS) * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(attempts, F.lit(16)))), F.lit(BACKOFF_MOST_MS)).cast("long")


def route_outcomes(results: DataFrame, now: int) -> DataFrame:
    """``job_id, outcome, retry_at`` of finished work with ``frame_id, frame_exists, text, needs_image, image_state, provider_ok, attempts``."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    outcome = (
        F.when(F.col("frame_id").isNull(), "dead")
        .when(~F.col("frame_exists"), "done")
        .when(F.col("needs_image") & (F.col("image_state") == "missing"), "dead")
        .when(F.col("needs_image") & (F.col("image_state") == "unreadable"), "retry")
        .when(~F.col("needs_image") & blank, "done")
        .when(F.col("provider_ok"), "done")
        .otherwise("retry")
    )
    return results.select("job_id", outcome.alias("outcome"), F.when(outcome == "retry", F.lit(now) + backoff_ms(F.col("attempts"))).alias("retry_at"))


def new_tag_requests(jobs: DataFrame, frames: DataFrame, now: int, most: int = 1000, priority: int = 10) -> DataFrame:
    """New jobs: on-demand tagging of the oldest ``most`` frames given."""
    new = frames.orderBy("captured_at", "frame_id").limit(most).select("frame_id", F.col("frame_id").alias("seq"), F.lit("vision_tag").alias("kind"), F.lit(priority).cast("long").alias("priority"))
    return numbered(jobs, new, now)


def tag_requests(jobs: DataFrame, frames: DataFrame, now: int, most: int = 1000, priority: int = 10) -> DataFrame:
    """The queue with on-demand tagging of the oldest ``most`` frames given."""
    return jobs.unionByName(new_tag_requests(jobs, frames, now, most, priority))


def wants_refill(idle: bool, in_flight: int, batch: int) -> bool:
    """Whether an idle producer adds work: when what is in flight falls below a quarter of a batch."""
    return idle and in_flight < max(batch // 4, 1)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with the same keys; of several new rows with equal keys the largest ``seq`` counts."""
    latest = rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seq")))).where("__n = 1").select(*table.columns)
    return table.join(latest.select(*keys), keys, "left_anti").select(*table.columns).unionByName(latest)


def replace_children(table: DataFrame, rows: DataFrame, parent: str = "frame_id") -> DataFrame:
    """All rows of the parents in ``rows`` are replaced."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given frames."""
    gone = ids.select("frame_id").distinct()
    return {name: df.join(gone, "frame_id", "left_anti").select(*df.columns) for name, df in tables.items()}


def mirror_labels(frames: DataFrame, analyses: DataFrame) -> DataFrame:
    """Activity labels of new analyses on their frames; a null label overwrites too."""
    new = analyses.select("frame_id", F.col("activity_type").alias("__new"), F.lit(True).alias("__hit"))
    return frames.join(new, "frame_id", "left").withColumn("activity_type", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("activity_type"))).select(*frames.columns)
