"""The durable work queue as a fold over an append-only log of job events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("state") == "PENDING") & (F.col("available_at") <= now))


def stale(jobs: DataFrame, now: Column, lease_seconds: int = SETTINGS.job_lease_seconds) -> DataFrame:
    """Running jobs whose lock is older than the lease."""
    return jobs.where((F.col("state") == "RUNNING") & F.col("locked_at").isNotNull() & (F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds))))


def assign(jobs: DataFrame, now: Column, workers: int, each: int) -> DataFrame:
    """The next ``workers * each`` jobs by priority and id, dealt to workers in that order; each job once.

    A top-k per task comes before the single ordered list, so that only ``workers * each`` rows meet in one task.
    """
    chosen = claimable(jobs, now).orderBy("priority", "job_id").limit(workers * each)
    place = F.row_number().over(Window.orderBy("priority", "job_id"))
    return chosen.withColumn("place", place).withColumn("worker", ((F.col("place") - 1) % workers).cast("int"))


def pending(jobs: DataFrame, job_type: str | None = None) -> DataFrame:
    found = jobs.where(F.col("state") == "PENDING")
    return found.where(F.col("job_type") == job_type) if job_type else found


def backoff(attempts: Column) -> Column:
    """Seconds until the next try: two to the power of the attempts so far."""
    return F.pow(F.lit(2), attempts).cast("int")


STEP = "struct<state:string,attempts:int,available_at:timestamp,locked_at:timestamp,last_error:string,completed:int>"


def fold(events: DataFrame, max_attempts: int = SETTINGS.job_max_attempts) -> DataFrame:
    """The current state of each job from its events (job_id, seq, at, kind, error), in order.

    CLAIM runs a pending job and counts an attempt; COMPLETE ends it; FAIL retries it after the backoff, or kills it
    when its attempts are used up; REAP puts a running job back. Events that don't fit the state change nothing.
    """
    start = F.expr(f"cast(named_struct('state', 'PENDING', 'attempts', 0, 'available_at', cast(null as timestamp), 'locked_at', cast(null as timestamp), 'last_error', cast(null as string), 'completed', 0) as {STEP})")

    def step(s: Column, e: Column) -> Column:
        running, dead = s["state"] == "RUNNING", s["attempts"] >= max_attempts
        claim, done, fail, reap = ((e["kind"] == k) & ok for k, ok in (("CLAIM", s["state"] == "PENDING"), ("COMPLETE", running), ("FAIL", running), ("REAP", running)))
        state = F.when(claim, "RUNNING").when(done, "DONE").when(fail, F.when(dead, F.lit("DEAD")).otherwise("PENDING")).when(reap, "PENDING").otherwise(s["state"])
        later = e["at"] + F.make_dt_interval(secs=backoff(s["attempts"]))
        return F.struct(
            state.alias("state"),
            (s["attempts"] + F.when(claim, 1).otherwise(0)).alias("attempts"),
            F.when(fail & ~dead, later).otherwise(s["available_at"]).alias("available_at"),
            F.when(claim, e["at"]).when(done | fail | reap, F.lit(None).cast("timestamp")).otherwise(s["locked_at"]).alias("locked_at"),
            F.when(done, F.lit(None).cast("string")).when(fail, F.substring(e["error"], 1, 4000)).when(reap, "lease expired").otherwise(s["last_error"]).alias("last_error"),
            (s["completed"] + F.when(done, 1).otherwise(0)).alias("completed"),
        ).cast(STEP)

    ordered = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "kind", "error"))).alias("log"))
    return ordered.withColumn("s", F.aggregate("log", start, step)).select("job_id", "s.*")


def next_attempt(jobs: DataFrame, max_attempts: int = SETTINGS.job_max_attempts) -> DataFrame:
    """What a failure now would make of each running job."""
    dead = F.col("attempts") >= max_attempts
    return jobs.select(
        "job_id",
        F.when(dead, "DEAD").otherwise("PENDING").alias("state"),
        F.when(~dead, F.col("available_at") + F.make_dt_interval(secs=backoff(F.col("attempts")))).alias("available_at"),
    )
