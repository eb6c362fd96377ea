"""The job queue: assignment, the fold, its stream, and append-only history."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from triagelake.operators import history as H
from triagelake.operators import jobs as J
from triagelake.operators import merging as M
from triagelake.sources import files
from triagelake.streaming import jobs as S

START = dt.datetime(2024, 1, 1)


def log(seed=0, jobs=6, n=200):
    rng = random.Random(seed)
    return [(rng.randrange(jobs), k, START + dt.timedelta(seconds=k), rng.choice(["CLAIM", "CLAIM", "COMPLETE", "FAIL", "FAIL", "REAP"]), f"e{k}") for k in range(n)]


def plain_fold(rows):
    out = {}
    for job, _, _, kind, _ in rows:
        out[job] = S.step(*out.get(job, ("PENDING", 0, 0)), kind)
    return out


SCHEMA = "job_id long, seq long, at timestamp, kind string, error string"


def test_fold_is_the_step_in_order(spark):
    rows = log()
    got = {r.job_id: (r.state, r.attempts, r.completed) for r in J.fold(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert got == plain_fold(rows)


def test_backoff_and_death(spark):
    rows = [(1, k, START, kind, "x") for k, kind in enumerate(["CLAIM", "FAIL", "CLAIM", "FAIL"])] + [(2, k, START, kind, "y" * 5000) for k, kind in enumerate(["CLAIM", "FAIL"] * 3 + ["CLAIM"])]
    got = {r.job_id: r for r in J.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].state == "PENDING" and got[1].available_at == START + dt.timedelta(seconds=4) and got[1].locked_at is None
    assert got[2].state == "DEAD" and got[2].attempts == 3 and len(got[2].last_error) == 4000


def test_assignment_gives_each_job_once(spark):
    rows = [(k, ["PENDING", "RUNNING"][k % 5 == 0], k % 3, START + dt.timedelta(days=k % 2), "PARSE", None) for k in range(60)]
    jobs = spark.createDataFrame(rows, "job_id long, state string, priority int, available_at timestamp, job_type string, locked_at timestamp")
    got = J.assign(jobs, F.lit(START).cast("timestamp"), workers=3, each=4).orderBy("place").collect()
    free = sorted((r[2], r[0]) for r in rows if r[1] == "PENDING" and r[3] <= START)[:12]
    assert [(r.priority, r.job_id) for r in got] == free and [r.worker for r in got] == [k % 3 for k in range(len(free))]
    assert J.pending(jobs).count() == 48 and J.pending(jobs, "OTHER").count() == 0


def test_stale_locks(spark):
    rows = [(1, "RUNNING", START), (2, "RUNNING", START + dt.timedelta(seconds=700)), (3, "RUNNING", None), (4, "PENDING", START)]
    jobs = spark.createDataFrame(rows, "job_id long, state string, locked_at timestamp")
    assert [r.job_id for r in J.stale(jobs, F.lit(START + dt.timedelta(seconds=900)).cast("timestamp")).collect()] == [1]


def test_stream_state_equals_the_batch_fold(spark, tmp_path):
    rows = log(seed=3)
    folder = tmp_path / "log"
    folder.mkdir()
    for k, part in enumerate((rows[:90], rows[90:140], rows[130:])):  # some events arrive twice
        pd.DataFrame(part, columns=["job_id", "seq", "at", "kind", "error"]).astype({"at": "datetime64[us]"}).to_parquet(folder / f"{k}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = {}

    def keep(batch, _):
        seen.update({r.job_id: (r.state, r.attempts, r.completed) for r in batch.collect()})

    query = S.fold_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == plain_fold(rows)


def test_overrides_supersede_what_was_live(spark):
    labels = spark.createDataFrame([(1, 11, "ICSR"), (1, 12, "MI"), (2, 21, "PQC")], "message_id long, id long, category string")
    decisions = spark.createDataFrame(
        [(100, 1, "OVERRIDE", '["PQC","MI"]'), (101, 1, "ACCEPT", "[]"), (102, 1, "OVERRIDE", '["ICSR"]'), (103, 2, "REJECT", "[]")], "decision_id long, message_id long, decision string, categories string"
    )
    history = H.with_overrides(labels, decisions)
    rows = {r.id: r.superseded_by for r in history.collect()}
    first, last = H.REVIEWER_IDS + 1000, H.REVIEWER_IDS + 1020
    assert rows == {11: first, 12: first, 21: None, first: last, first + 1: last, last: None}
    assert {r.message_id: (r.live, r.n_superseded) for r in H.current_labels(history).collect()} == {1: ('["ICSR"]', 4), 2: ('["PQC"]', 0)}
    assert {r.message_id: r.status for r in H.decided_status(decisions).collect()} == {1: "REVIEWED", 2: "REJECTED"}
    ends = {r.start: r.final for r in H.chain_ends(history, spark).collect()}
    assert ends[11] == last and ends[21] == 21


def test_merging_folds_in_order(spark):
    rows = [
        (1, "p", "PATIENT", 1, "58 years", 0.9, "Y", "STATED"), (1, "p", "PATIENT", 2, "58", 0.95, "N", "STATED"), (1, "q", "PATIENT", 1, "male", 0.9, "Y", "STATED"), (1, "q", "PATIENT", 2, "female", 0.3, "Y", "UNCERTAIN"),
        (1, "n", "NARRATIVE", 1, "one", 0.9, "N", "STATED"), (1, "n", "NARRATIVE", 2, "two", 0.2, "Y", "STATED"), (1, "z", "REPORTER", 1, None, 0.1, "N", "NOT_STATED"), (1, "s", "REPORTER", 1, "Ann", 0.8, "N", "STATED"),
        (2, "r", "REACTION", 1, "a b", 0.9, "Y", "STATED"), (2, "r", "REACTION", 2, "a", 0.9, "Y", "STATED"), (2, "r", "REACTION", 3, "b", 0.9, "Y", "STATED"),
    ]
    df = spark.createDataFrame(rows, "case_id long, field_path string, field_group string, field_id long, value_text string, confidence double, verified string, status string")
    got = {(r.case_id, r.field_path): (r.outcome, r.kept, float(r.confidence) if r.confidence is not None else None) for r in M.merged(df, ["case_id", "field_path"], ["field_id"]).collect()}
    assert got == {
        (1, "p"): ("MERGED", "58 years", 0.9), (1, "q"): ("CONFLICT", "male | female", 0.5), (1, "n"): ("MERGED", "two", 0.2), (1, "z"): ("ABSTAINED", None, None), (1, "s"): ("SINGLE", "Ann", 0.8),
        (2, "r"): ("MERGED", "a b", 0.9),
    }


def test_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text('{"key": "a", "subject": "s", "labels": ["ICSR"], "edge_cases": ["E1"],\n "cases": [{"icsr_elements": {"has_suspect_product": true}, "fields": {"patient.age.raw": "58", "x[0].y": "z"}}]}')
    facts = files.golden_facts(files.goldens(spark, str(tmp_path / "g"))).collect()
    assert sorted((r.key, r.case_index, r.path, r.expected) for r in facts) == [("a", 0, "patient.age.raw", "58"), ("a", 0, "x[0].y", "z")]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "message_id long, v string")
    files.replace_messages(rows, str(tmp_path / "t"))
    files.replace_messages(spark.createDataFrame([(2, "c")], "message_id long, v string"), str(tmp_path / "t"))
    assert sorted((r.message_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    files.export_samples(rows, str(tmp_path / "out"))
    text, markdown = files.report({"rows": rows})
    assert '"v": "a"' in text and "| message_id | v |" in markdown
