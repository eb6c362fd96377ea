"""Exact substring removal against brute force over every string."""

import collections
import decimal
import hashlib
import random

import numpy as np
import pytest

from triagelake.llm import suffix

SCHEMA = "doc_id long, text string"


def brute(rows):
    """For rows in order of (doc_id, place): bytes covered by a string that starts earlier."""
    seen, out = set(), {}
    for k, (_, text) in enumerate(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - suffix.LENGTH + 1):
            window = raw[s : s + suffix.LENGTH]
            if window in seen:
                gone[s : s + suffix.LENGTH] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randint(12, 60)) for _ in range(5)]
    rows = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:
            text = rng.choice(rows)[1]
            for _ in range(rng.randint(0, 3)):
                if text:
                    at = rng.randrange(len(text))
                    text = text[:at] + rng.choice(["X", "", "yy "]) + text[at + rng.randint(0, 2) :]
        elif kind < 0.7:
            text = prose(rng.randint(0, 40)) + " " + rng.choice(passages) + " " + prose(rng.randint(0, 30))
        elif kind < 0.8:
            text = rng.choice(["a", "ab", "abc ", "日本"]) * rng.randint(10, 300)
        else:
            text = prose(rng.randint(0, 200))
        rows.append((k, text))
    return rows


def result(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_query(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot,chunk,sorted_,block", [(1, 1 << 20, 1 << 20, 1), (2, 700, 50, 3), (1000, 300, 2000, 17), (3, 5000, 9000, 100_000)])
@pytest.mark.parametrize("tasks", [1, 2, 5])
def test_small_limits_change_nothing(monkeypatch, hot, chunk, sorted_, block, tasks):
    rows = corpus(7, 50)
    for name, value in (("HOT", hot), ("CHUNK", chunk), ("SORTED", sorted_), ("BLOCK", block), ("DEALT", 40 * hot)):
        monkeypatch.setattr(suffix, name, value)
    assert in_memory(rows, tasks) == brute(rows)


def dealt(batches, keys, whole, tasks):
    """Rows sorted by keys, cut into tasks between different keys, in batches of two rows."""
    import pyarrow as pa

    table = pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in keys])
    order = list(zip(*(table.column(k).to_pylist() for k in keys[:whole])))
    cuts = [0] + sorted({next((j for j in range(len(order) * t // tasks, len(order)) if order[j] != order[j - 1]), len(order)) for t in range(1, tasks)}) + [len(order)]
    return [table.slice(a, b - a).to_batches(max_chunksize=2) for a, b in zip(cuts, cuts[1:])]


def in_memory(rows, tasks):
    """The stages of the operator without Spark, so that limits can be set."""
    import pyarrow as pa

    table = [pa.RecordBatch.from_pydict({"doc": [d], "rid": [k], "text": [t]}, pa.schema([("doc", pa.int64()), ("rid", pa.int64()), ("text", pa.string())])) for k, (d, t) in enumerate(rows)]
    anchors = [b for k in (0, 1) for b in suffix.find_anchors(iter(table[k::2]))]
    grams = sorted({g for b in anchors for g in b.column("gram").to_pylist()})
    hot = np.array(grams[::3] if tasks > 1 else [], np.int64)  # as if a third were hot
    slot = lambda r: (r["c1"] if r["gram"] in set(hot.tolist()) else r["gram"]) % tasks
    each = [r for b in anchors for r in b.to_pylist()]
    parts = [[r for r in each if slot(r) == k] for k in range(tasks)]
    met = [b for part in parts if part for task in dealt([pa.RecordBatch.from_pylist(part)], list(suffix.ANCHOR), 3, 1) for b in suffix.match_anchors(iter(task), hot)]
    met = [b for task in dealt(met, ["rid"], 1, 1) for b in suffix.join_intervals(iter(task))]
    rows_ = [r for b in met for r in b.to_pylist()]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("value", pa.int64()), ("kind", pa.int32())]))
    wanted = [[r for r in rows_ if r["rid"] == k and r["kind"] != suffix.COVERED] or None for k in range(len(rows))]
    asked = pa.RecordBatch.from_pydict({"doc": [d for d, _ in rows], "rid": [*range(len(rows))], "text": [t for _, t in rows], "wanted": pa.array(wanted, kind)})
    contexts = [b for k in range(0, len(rows), 7) for b in suffix.cut_contexts(iter([asked.slice(k, 7)]))]
    compared = [r for task in dealt(contexts, ["gram"], 1, 1) for b in suffix.sort_contexts(iter(task)) for r in b.to_pylist()]
    out = {}
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        spans, removed = suffix.kept_spans(raw, [r for r in rows_ + compared if r["rid"] == k and r["kind"] == suffix.COVERED])
        kept = b"".join(raw[s:e] for s, e in spans)
        out[k] = (len(raw), len(raw) - len(kept), removed, hashlib.sha256(kept).hexdigest())
    return out


def multiset(spark, rows, schema):
    got = suffix.dedup_query(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


@pytest.mark.parametrize("key", ["null", "shared", "few", "string", "decimal"])
def test_ids_that_are_shared_or_missing_or_no_numbers(spark, key):
    """Rows are documents of their own, in the order of the table where ids don't tell."""
    name = {"null": lambda k: None, "shared": lambda k: 5, "few": lambda k: [3, None, 1][k % 3], "string": lambda k: f"d{k % 9}", "decimal": lambda k: decimal.Decimal(k % 7)}[key]
    rows = [(name(k), t) for k, (_, t) in enumerate(corpus(23, 120))]
    kind = {"string": "string", "decimal": "decimal(5,0)"}.get(key, "long")
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0 if kind != "string" else rows[k][0], k))
    want = brute([rows[k] for k in order])
    assert multiset(spark, rows, f"doc_id {kind}, text string") == collections.Counter((rows[k][0], *want[n]) for n, k in enumerate(order))


def test_many_rows_without_ids(spark):
    """2,000 rows, half of them unique prose: exactly what brute force removes."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    unique = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(1000)]
    rows = [(None if k % 2 else k % 5, unique[k % 1000] if k < 1000 or k % 4 else unique[3]) for k in range(2000)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    want = brute([rows[k] for k in order])
    assert multiset(spark, rows, SCHEMA) == collections.Counter((rows[k][0], *want[n]) for n, k in enumerate(order))


def test_edges(spark):
    long = "x" * 50 + "".join(chr(97 + k % 23) for k in range(400))
    rows = [(3, None), (1, ""), (5, long), (5, long), (4, "a" * 99), (6, "a" * 99), (2, "b" * 100), (7, "b" * 100)]
    df = spark.createDataFrame(rows + [(None, long)], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_removed) for r in suffix.dedup_query(df).collect())
    own = brute([(5, long)])[0][1]
    assert got == [(1, 0, 0), (2, 100, 0), (3, 0, 0), (4, 99, 0), (5, 450, own), (5, 450, 450), (6, 99, 0), (7, 100, 100), (99, 450, 450)]
    assert suffix.dedup_query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_keep_their_columns(spark):
    rows = [(1, "p" * 30 + "né" * 80, "a", 190, 0), (2, "q" * 7 + "né" * 80 + "z", "b", 168, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tie string, n_chars long, covered int")
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect()}
    assert got[1].tie == "a" and got[2].covered == 1
    assert len(got[2].text) == got[2].n_chars <= 10


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[500:1200] = data[1300:2000]
    suffixes = suffix.Suffixes(np.concatenate((data, np.zeros(suffix.LENGTH, np.uint8))))
    starts = rng.permutation(2900)[:900]
    order = suffixes.mergesort(starts, np.array([0, 300]), np.array([300, 600]))
    text = data.tobytes() + bytes(suffix.LENGTH)
    for a, b in ((0, 300), (300, 900)):
        want = sorted(range(a, b), key=lambda k: text[starts[k] : starts[k] + suffix.LENGTH])
        assert order[a:b].tolist() == want
