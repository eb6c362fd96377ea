"""Quality rules as a short-circuit cascade.

Base statistics are counted once per text. Each rule is a test on what is cheap or dear to find; a rule's cost and the
texts that it rejects are measured on a bounded sample of those that pass the base rules, and the cascade tries rules in the
order of rejections per second among the texts that all earlier ones passed. The order decides the cost alone: a
text is kept if every rule passes, whichever comes first.

Defined results: a null text has no words and fails the base rules (fewer than ten words); very long texts are read
whole; repeated rows each get their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Texts of which the rules' cost and selectivity are measured.
SAMPLE = 1024


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[str, dict], bool]


def _alphabetic(text: str, m: dict) -> bool:
    return 100 * sum(1 for w in text.encode().split() if _LETTER.search(w)) < 60 * m["n_words"]


_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")

#: The rules after the base. Names, tests and limits are parameters of ``cascade``.
RULES = (
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("mean_word", lambda t, m: not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]),
    Rule("duplicate_lines", lambda t, m: 2 * m["n_dup_lines"] > t.count("\n") + 1),
    Rule("alphabetic_words", _alphabetic),
    Rule("capitals", lambda t, m: 2 * sum(map(len, re.findall(r"[A-Z]+", t))) > m["word_chars"]),
    Rule("distinct_words", lambda t, m: m["n_words"] >= 50 and 20 * len(set(t.encode().split())) < m["n_words"]),
)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of five words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen: dict[tuple, int] = {}  # equal hashes are only candidates
    windows = [tuple(words[i : i + WINDOW]) for i in at.tolist()]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    at = at[np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> dict:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)] if "\n" in text else []
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def base_failed(m: dict) -> bool:
    return m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]


def costs(docs: DataFrame, rules: tuple[Rule, ...], sample: int) -> list[tuple[int, int, list[float]]]:
    """(set of rules that reject, texts, seconds of each rule) over the sampled texts that pass the base rules.

    The sample are the rows with the least hashes of their numbers, whatever their place in the table. Only hashes are sorted;
    the texts stay where they are read.
    """
    hashed = docs.select("text", F.xxhash64(F.monotonically_increasing_id()).alias("h"))
    last = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for text in texts_of(batch):
                m, mask, seconds = measure(text), 0, []
                if base_failed(m):
                    continue
                for k, rule in enumerate(rules):
                    start = time.perf_counter()
                    mask |= bool(rule.rejects(text, m)) << k
                    seconds.append(time.perf_counter() - start)
                n, total = found.get(mask, (0, [0.0] * len(rules)))
                found[mask] = [n + 1, [a + b for a, b in zip(total, seconds)]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([t for _, t in found.values()], pa.list_(pa.float64()))],
            ["mask", "n", "seconds"],
        )

    some = hashed.where(F.col("h") <= F.lit(last)).select("text")
    return [tuple(r) for r in some.mapInArrow(run, "mask long, n long, seconds array<double>").collect()]


def ordered(rules: tuple[Rule, ...], measured: list[tuple[int, int, list[float]]]) -> list[Rule]:
    """The rules by rejections per second, each counted on the texts that the rules before it let through."""
    cost = [sum(seconds[k] for *_, seconds in measured) + 1e-9 for k in range(len(rules))]
    left, plan = list(range(len(rules))), []
    while left:
        passed = [(mask, n) for mask, n, _ in measured if not any(mask >> k & 1 for k in plan)]
        best = max(left, key=lambda k: ((sum(n for mask, n in passed if mask >> k & 1) + 1e-3) / cost[k], -k))
        plan.append(best)
        left.remove(best)
    return [rules[k] for k in plan]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    plan = ordered(rules, costs(docs, rules, sample))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, failed, kept = [], [], []
            for text in texts_of(batch):
                m = measure(text)
                rows.append(m)
                failed.append(base_failed(m))
                kept.append(not failed[-1] and not any(r.rejects(text, m) for r in plan))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([m[k] for m in rows], pa.int64()) for k in names), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                ["doc_id", *names, "base_failed", "kept"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS gram,
             unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2), (3), (4)) AS o(k) GROUP BY rid),
m AS (
  SELECT doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND 2 * n_dup_lines <= len(string_split(text, chr(10)))
       AND 100 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) >= 60 * n_words
       AND 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) <= word_chars
       AND NOT (n_words >= 50 AND 20 * len(list_distinct(words)) < n_words) AS kept
FROM b
"""
