"""The job queue's state over a stream of its events, one state a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SETTINGS

STATE = "state string, attempts int, completed int, seq long"
OUT = "job_id long, state string, attempts int, completed int, seq long"


def step(state: str, attempts: int, completed: int, kind: str, most: int = SETTINGS.job_max_attempts) -> tuple[str, int, int]:
    """One event on a job; what doesn't fit the state changes nothing."""
    if kind == "CLAIM" and state == "PENDING":
        return "RUNNING", attempts + 1, completed
    if state != "RUNNING":
        return state, attempts, completed
    if kind == "COMPLETE":
        return "DONE", attempts, completed + 1
    if kind == "FAIL":
        return ("DEAD" if attempts >= most else "PENDING"), attempts, completed
    return ("PENDING" if kind == "REAP" else state), attempts, completed


def fold_stream(events: DataFrame) -> DataFrame:
    """(job_id, seq, kind) to the job's state after each batch; late repeats of an event are passed over by seq."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempts, completed, last = held.get if held.exists else ("PENDING", 0, 0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, kind in zip(rows["seq"], rows["kind"]):
            if seq > last:
                state, attempts, completed = step(state, attempts, completed, kind)
                last = int(seq)
        held.update((state, attempts, completed, last))
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "attempts": [attempts], "completed": [completed], "seq": [last]})

    return events.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
