"""Evidence: normalisation, the fuzzy window against brute force, pages, and the exact join."""

import random
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from triagelake.functions import evidence as E
from triagelake.operators import evidence as V
from triagelake.plans import catalog
from pyspark.sql import functions as F


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=150), st.text(alphabet="abcde", max_size=150), st.integers(1, 90))
def test_common_lengths(needle, hay, size):
    starts = np.arange(max(1, len(hay)))
    ends = np.minimum(starts + size, len(hay))
    got = E.Comparison(needle, hay).common(starts[: len(hay)], ends[: len(hay)])
    assert got.tolist() == [plain_lcs(needle, hay[a:b]) for a, b in zip(starts[: len(hay)], ends)]


def test_normalise_keeps_offsets():
    text = "  “Straße” —  ﬁn﻿ "
    flat, at = E.normalise(text)
    assert flat == '"strasse" - fin' and len(flat) == len(at)
    assert text[at[flat.index("fin")]] == "ﬁ" and at == sorted(at)
    assert E.normalise("") == ("", []) and E.normalise(" \n")[0] == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBß é“—ﬁ\u0301\u00a0\u2003\n\ufeffÅ①e", max_size=25))
def test_fold_is_normalise(text):
    assert E.fold(text) == E.normalise(text)[0]


def naive_similarity(a, b):
    return 200.0 * plain_lcs(a, b) / (len(a) + len(b))


def naive_verdict(quote, page):
    """(method, score to 6 digits, start, end, note), by plain loops over windows."""
    if not (quote or "").strip():
        return "FAILED", 0.0, None, None, "no quote supplied"
    if not (page or "").strip():
        return "FAILED", 0.0, None, None, "source page has no text to search"
    needle, (hay, at) = E.normalise(quote)[0], E.normalise(page)
    if not needle:
        return "FAILED", 0.0, None, None, "quote normalised to nothing"
    if needle in hay:
        k = hay.index(needle)
        return "EXACT", 100.0, at[k], at[k + len(needle) - 1] + 1, ""
    n, short, long = len(needle), *sorted((needle, hay), key=len)
    every = max((naive_similarity(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))), default=0.0)
    if n <= len(hay):
        step, best = max(1, n // 4), None
        for k in range(0, len(hay) - n + 1, step):
            score = naive_similarity(needle, hay[k : k + n])
            if best is None or score > best[1]:
                best = k, score
        if best[1] >= 90:
            for k in range(max(0, best[0] - step), min(len(hay) - n, best[0] + step) + 1) if best[0] >= 0 else ():
                score = naive_similarity(needle, hay[k : k + n])
                if score > best[1]:
                    best = k, score
            return "FUZZY", round(best[1], 6), at[best[0]], at[best[0] + n - 1] + 1, f"matched at {best[1]:.0f}% similarity, not verbatim"
    elif every >= 90:
        return "FUZZY", round(every, 6), 0, at[-1] + 1, f"matched at {every:.0f}% similarity, not verbatim"
    return "FAILED", round(every, 6), None, None, f"quote not found in the cited source (best similarity {every:.0f}%)"


def spoilt(rng, text, share):
    return "".join(rng.choice("xyz") if rng.random() < share else c for c in text)


def citations(seed, units):
    """Quotes of all kinds and the pages of their units."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeß ") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    pages, quotes = [], []
    for u in range(units):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 4))]
        pages += [(u, k + 1, t) for k, t in enumerate(texts)]
        for k in range(5):
            page = rng.randrange(len(texts))
            a = rng.randrange(20)
            quote = spoilt(rng, texts[page][a : a + rng.randint(8, 70)], rng.choice([0, 0.03, 0.1, 0.4]))
            quotes.append((10 * u + k, u, rng.choice([page + 1, 1, None, 9]), quote))
    pages += [(90, 1, None), (91, 1, "only page")]
    quotes += [(900, 90, 1, "lost"), (901, 91, 1, "no such words at all"), (902, 91, None, "only page"), (903, 99, 1, "no unit"), (904, None, 1, "x"), (905, 0, 1, None), (906, 0, 1, " ")]
    return quotes, pages


def test_verdicts_against_plain_loops():
    quotes, pages = citations(2, 12)
    text, seen = {(u, p): t for u, p, t in pages}, set()
    for _, unit, _, quote in quotes:
        for (u, _), page in text.items():
            if u == unit:
                got = E.verdict(quote, page)
                assert (got.method, round(got.match_score, 6), *got[2:]) == naive_verdict(quote, page)
                seen.add(got.method)
    assert seen == {"EXACT", "FUZZY", "FAILED"}
    assert E.verdict("\ufeff", "a").note == "quote normalised to nothing" and E.verdict("long quote here", "ong quote her").method == "FUZZY"


def test_every_quote_gets_its_verdict(spark):
    quotes, pages = citations(5, 10)
    want = {}
    for q, unit, cited, quote in quotes:
        own = {p: t for u, p, t in pages if u == unit}
        tried = {p: naive_verdict(quote, t) for p, t in own.items()}
        if cited in own and tried[cited][0] != "FAILED":
            want[q] = (cited, *tried[cited])
            continue
        good = [p for p in sorted(own) if p != cited and tried[p][0] != "FAILED"]
        if good:
            *found, note = tried[good[0]]
            said = f"found on page {good[0]}, but the model cited page {cited}" if cited is not None else ""
            want[q] = (good[0], *found, "; ".join(x for x in (said, note) if x))
        else:
            rest = [p for p in sorted(own) if p != cited]
            best = max(rest, key=lambda p: (tried[p][1], -p), default=None)
            want[q] = (cited, *(tried[best] if best else ("FAILED", 0.0, None, None, "no source pages available to verify against")))
    got = V.verify_quotes(
        spark.createDataFrame(quotes, "quote_id long, unit_id long, cited_page long, quote string"), spark.createDataFrame(pages, "unit_id long, page_no long, text string")
    ).collect()
    assert len(got) == len(quotes)
    assert {r.quote_id: (r.page_id, r.method, round(r.match_score, 6), r.char_start, r.char_end, r.note) for r in got} == want
    assert {w[1] for w in want.values()} == {"EXACT", "FUZZY", "FAILED"}


def test_quotes_that_share_an_id_get_a_verdict_each_and_steps_run_once(spark):
    quotes = [(1, 1, 1, "alpha beta"), (1, 1, 1, "gamma delta"), (None, 1, 1, "alpha beta"), (None, 1, 2, "nowhere at all"), (2, 1, 2, "alpha beta"), (3, 7, 1, "x")]
    pages = [(1, 1, "say alpha beta"), (1, 1, "say alpha beta"), (1, 2, "say gamma delta"), (2, 1, "alpha beta")]
    found = V.verify_quotes(spark.createDataFrame(quotes, "quote_id long, unit_id long, cited_page long, quote string"), spark.createDataFrame(pages, "unit_id long, page_no long, text string"))
    got = sorted(((r.quote_id or 0, r.page_id, r.method, r.char_start, r.note[:15]) for r in found.collect()), key=str)
    assert got == [
        (0, 1, "EXACT", 4, ""), (0, 2, "FAILED", None, "quote not found"), (1, 1, "EXACT", 4, ""), (1, 2, "EXACT", 4, "found on page 2"),
        (2, 1, "EXACT", 4, "found on page 1"), (3, 1, "FAILED", None, "no source pages"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3


def test_a_long_failure_is_found_fast():
    rng, took = random.Random(1), time.perf_counter()
    page = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(1500))
    assert E.verdict("".join(rng.choice("ijklmnab ") for _ in range(210)), page).method == "FAILED"
    assert time.perf_counter() - took < 1.5


def test_failures_of_usual_length_are_found_fast():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    pages = [" ".join(rng.choice(words) for _ in range(520)) for _ in range(10)]
    quotes = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(10)]
    took = time.perf_counter()
    assert {E.verdict(q, p).method for q in quotes for p in pages} == {"FAILED"}
    assert time.perf_counter() - took < 1.2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc ", max_size=40), st.text(alphabet="abcd ", max_size=150))
def test_the_best_window_of_all(needle, hay):
    short, long = sorted((needle, hay), key=len)
    every = (naive_similarity(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long)))
    assert E.partial_similarity(needle, hay) == (max(every, default=0.0) if short else 0.0)


def test_exact_pairs_against_search(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdß") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    pages = [(k, "  ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(60)] + [(90, None), (91, "")]
    quotes = []
    for k in range(60):
        text = E.normalise(rng.choice(pages[:60])[1])[0]
        a = rng.randrange(max(1, len(text)))
        quotes.append((k, text[a : a + rng.randint(1, 60)].upper()))
    quotes += [(100, ""), (101, None), (102, quotes[0][1])]
    tables = spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(pages, "page_id long, text string")
    want = {(q, p) for q, quote in quotes for p, page in pages if E.normalise(quote)[0] and E.normalise(quote)[0] in E.normalise(page)[0]}
    for block_bytes in (1 << 20, 200):
        assert {tuple(r) for r in V.exact_pairs(*tables, block_bytes).collect()} == want


@pytest.mark.parametrize("block_bytes", [V.BLOCK_BYTES, 20])
def test_exact_queries_are_their_sql_on_odd_texts(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(V.exact_pairs, "__defaults__", (block_bytes, *V.exact_pairs.__defaults__[1:]))
    six = "one two three four five six seven"
    said = ["strasse", "Straße", "ﬁn", "fin", "\u201cq\u201d", '"q"', "a\u00a0b", "a b", "a\x0bb", "ΑΣ", "İx", "x\ufeffy", "", "  \t", None, six, six, six.upper().replace(" ", "\n "), "Straße " + six, "\u00a0a b"]
    ids = [*range(len(said) - 4), 3, None, 15, 7]
    texts = ["die Straße ß", "die strasse", "ﬁn", "a fin", "say \u201cQ\u201d", 'say "q"', "a\u00a0b", "a\tb", "a\x0bb", "ας ΑΣ ασ", "İX ix i\u0307x", "x\ufeffy xy", "", None, f"{six} eight", f"eight {six}  nine", f"straße {six}", f"strasse {six}", f"0 {six}"]
    pages = [*range(len(texts) - 5), 14, 14, 259, None, None]
    spark.createDataFrame(list(zip(ids, said)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(zip(pages, texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("evidence_exact", "evidence_exact_page"):
        got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(con.execute(catalog.ORACLE[name]).fetchall(), key=repr)


def test_best_page(spark):
    rows = [
        (1, 5, 3, "EXACT", 100.0, ""), (1, 3, 3, "FUZZY", 95.0, "x"), (2, 7, 3, "EXACT", 100.0, ""), (2, 6, 3, "EXACT", 100.0, ""),
        (3, 1, 9, "FAILED", 10.0, "a"), (3, 2, 9, "FAILED", 40.0, "b"), (4, 8, None, "EXACT", 100.0, ""),
    ]
    df = spark.createDataFrame(rows, "quote_id long, page_id long, cited_page long, method string, match_score double, note string")
    got = {r.quote_id: (r.page_id, r.note) for r in V.best_page(df).collect()}
    assert got == {1: (3, "x"), 2: (6, "found on page 6, but the model cited page 3"), 3: (9, "b"), 4: (8, "")}


def test_caps(spark):
    rows = [("0.9", False, "1.0", False), ("0.9", True, "0.3", False), ("0.9", True, "1.0", True), ("1.7", False, "0.35", True), ("-1", True, "1.0", False)]
    df = spark.createDataFrame(rows, "c string, ok boolean, leg string, conflict boolean")
    confidence, reason = V.capped(F.col("c").cast("decimal(9,4)"), F.col("ok"), F.col("leg").cast("decimal(9,4)"), F.col("conflict"))
    got = [(str(r.c2), r.reason) for r in df.select(confidence.alias("c2"), reason.alias("reason")).collect()]
    assert got == [
        ("0.4000", "evidence could not be verified, capped at 0.40"), ("0.3000", "source page legibility 0.30"), ("0.5000", "sources disagree, capped at 0.50"),
        ("0.3500", "evidence could not be verified, capped at 0.40; source page legibility 0.35"), ("0.0000", ""),
    ]
