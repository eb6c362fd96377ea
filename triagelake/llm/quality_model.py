"""Quality classifier: a sparse ensemble of rules.

Statistics of each whole text are counted in one Arrow pass. Small regression trees, grown in numpy on the labelled
sample, give conjunctive rules: every path from the root is one. A lasso-penalised logistic regression weighs the rules
and leaves few; these are compiled into one Spark column expression over the statistics, so that scoring is a projection.

Labels teach, and the statistics are the only inputs: lang, source and doc_id never reach a score. At most ``SAMPLE``
labelled rows are used, those with the least hash of their id; every tree grows on a random ``TREE_ROWS`` of them.

Defined results: a null or empty text has all statistics 0 and is scored like any other; without usable labels every
score is 0.5 and every text is kept; repeated rows get equal scores; an empty table gives an empty result. The statistics
travel in one struct column whose name is chosen free of the input's, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, released, texts_of

#: The bound on labelled rows; folds by crc32 of the id; how many trees grow, on how many of those rows each, and how deep.
SAMPLE, FOLDS, HELD_OUT = 20_000, 3, 1
TREES, TREE_ROWS, DEPTH, PENALTY, ROUNDS = 24, 4_000, 3, 2e-3, 600
STATISTICS = (
    "words", "word_length", "symbols", "marks", "bars", "capitals", "distinct", "repeats",
    "duplicate_lines", "digits", "stops", "line_words", "longest",
)


def statistics(text: str) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        sum(map(text.count, "#*$%&<>")) / n,
        (text.count("!") + text.count("?")) / n,
        text.count("|") / n,
        sum(map(str.isupper, words)) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(map(text.count, "0123456789")) / len(text),
        (text.count(".") + text.count(",")) / n,
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log1p(max(map(len, words)))),
    )


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """The input's columns and a struct of statistics."""
    field = pa.struct([(s, pa.float64()) for s in STATISTICS])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in texts_of(batch)], np.float64).reshape(-1, len(STATISTICS))
            stats = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], fields=list(field))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], [*batch.schema.names, name])

    struct = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, struct)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it above, threshold)


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, rng: np.random.Generator, path: Rule, out: set[Rule]) -> None:
    """Adds to ``out`` the rule of every node below: splits that lower the squared error most, on some of the statistics."""
    if not depth or len(rows) < 20 or np.ptp(y[rows]) == 0:
        return
    best = (1e-9, -1, 0.0)
    total = ((y[rows] - y[rows].mean()) ** 2).sum()
    for k in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        order = rows[np.argsort(x[rows, k], kind="stable")]
        v, t = x[order, k], y[order]
        sums, n = np.cumsum(t)[:-1], np.arange(1, len(t))
        squares = t @ t
        error = squares - sums**2 / n - (t.sum() - sums) ** 2 / (len(t) - n)
        error[(v[1:] == v[:-1]) | (n < 5) | (len(t) - n < 5)] = np.inf
        at = int(np.argmin(error))
        if total - error[at] > best[0]:
            best = (total - error[at], int(k), float((v[at] + v[at + 1]) / 2))
    if best[1] < 0:
        return
    above = x[rows, best[1]] > best[2]
    for side, part in ((True, rows[above]), (False, rows[~above])):
        longer = (*path, (best[1], side, best[2]))
        out.add(longer)
        grow(x, y, part, depth - 1, rng, longer, out)


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for k, above, at in rule:
        hit &= (x[:, k] > at) == above
    return hit


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    top = np.ones(m + 1)
    for _ in range(30):
        top = a.T @ (a @ top)
        top /= np.linalg.norm(top)
    step = 4 * n / max(np.linalg.norm(a @ top) ** 2, 1e-9)
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        v = z - step * (a.T @ (p - y)) / n
        new = np.sign(v) * np.maximum(np.abs(v) - step * penalty, 0)
        new[0] = v[0]
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


class Ensemble:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float = 0.0, rules: list[tuple[Rule, float]] | None = None) -> None:
        self.intercept, self.rules = intercept, rules or []

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * fires(rule, x) for rule, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str) -> Column:
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            hit = F.lit(True)
            for k, above, at in rule:
                value = F.col(f"`{stats}`.{STATISTICS[k]}")
                hit = hit & (value > at if above else value <= at)
            z = z + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    if len(y) < 20 or np.ptp(y) == 0:
        return Ensemble()
    rng, found = np.random.default_rng(seed), set()
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), TREE_ROWS), replace=False)
        grow(x, y, rows, DEPTH, rng, (), found)
    rules = sorted(found)
    r = np.stack([fires(rule, x) for rule in rules], axis=1).astype(np.float32)
    _, once = np.unique(np.packbits(r > 0, axis=0), axis=1, return_index=True)  # rules that agree on every row are one
    rules, r = [rules[k] for k in sorted(once)], r[:, sorted(once)]
    intercept, weights = lasso(r, y, PENALTY, ROUNDS)
    return Ensemble(intercept, [(rule, float(w)) for rule, w in zip(rules, weights) if abs(w) > 1e-6])


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def free_name(docs: DataFrame) -> str:
    name = "statistics"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Learns from labelled rows outside the held-out fold; what reaches the driver is bounded by ``sample``."""
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != HELD_OUT))
    taught = taught.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taught = taught.select(F.col("doc_id").alias("taught_id"), F.col("quality").cast("double").alias("label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), F.col("doc_id") == F.col("taught_id")).select("doc_id", "text", "label")
    seen = with_statistics(rows, "statistics").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("statistics").alias("statistics"))
    seen = seen.orderBy("doc_id").select("label", "statistics.*").toArrow()
    data = np.stack([seen.column(c).to_numpy() for c in ("label", *STATISTICS)], axis=1).astype(np.float64)
    return fit_rules(data[:, 1:], data[:, 0])


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = with_statistics(docs.select("doc_id", "text"), "statistics").withColumn("score", model.column("statistics"))
    return rows.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The rows predicted to be good, in the input's columns."""
    name = free_name(docs)
    return with_statistics(docs, name).where(model.column(name) >= 0.5).drop(name)


def classifier_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
