"""The pipeline's near-dedup stage against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from triagelake.llm import similar


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept_by_all_pairs(rows):
    """Least doc_id of each component of pairs with Jaccard similarity of 0.8 or more; and the similarities of linked pairs."""
    sets, root, found = [shingles(t) for _, t in rows], list(range(len(rows))), []

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                found.append(both / max(1, len(sets[i] | sets[j])))
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {rows[k][0] for k in range(len(rows)) if top(k) == k}, found


def corpus(seed, base, copies, edits):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for _ in range(base):
        text = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        rows.append(" ".join(text))
        for _ in range(copies):
            near = [rng.choice(words) if rng.random() < rng.uniform(0, edits) else w for w in text]
            rows.append(" ".join(near))
    rows += ["", " ", "one two", "One  two", "a b c d e"]
    return list(enumerate(rows))


def stage(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    out = [r.doc_id for r in kept.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_planted_near_copies(spark):
    rows = corpus(3, 60, 5, 0.04)
    want, found = kept_by_all_pairs(rows)
    assert sum(0.8 <= s < 0.95 for s in found) > 100
    assert stage(spark, rows) == want


def test_a_group_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)
    rows = corpus(4, 2, 70, 0.03)
    want, found = kept_by_all_pairs(rows)
    assert 2 < len(want) < 120
    assert stage(spark, rows) == want


def test_bktree_pairs_against_all_pairs():
    rng = random.Random(5)
    sets = {k: similar.shingles(" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(rng.randint(1, 60)))) for k in range(40)}
    base = similar.shingles(" ".join(f"w{k}" for k in range(200)))
    sets |= {100 + k: np.delete(base, range(k, 20 + k)) for k in range(0, 60, 4)}
    wide = {k: similar.wide_fingerprint(s) for k, s in sets.items()}
    keys = {k: [1, 2] if k % 2 else [2] for k in wide}
    rows = [{"part": s, "key": s, "keys": keys[k], "side": side, "fp": k, "root": k % 3, "wide": wide[k], "size": 100, "shared": 100 - k % 5 * 4} for s, side in ((1, -1), (2, -1)) for k in wide if s in keys[k]]
    rows.sort(key=lambda r: (r["part"], r["side"]))
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    found = [tuple(sorted(p)) for out in similar.near_pairs(iter(batches), similar.RADIUS) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    got = set(found)
    assert len(found) == len(got)  # though many pairs meet in both shards
    bits = lambda a, b: (int.from_bytes(wide[a], "big") ^ int.from_bytes(wide[b], "big")).bit_count()
    assert got == {(a, b) for a in wide for b in wide if a < b and a % 3 != b % 3 and bits(a, b) <= similar.RADIUS and max(a % 5, b % 5) < 3} and len(got) > 20


def test_radius_holds_what_is_similar():
    """Pairs of sets at a similarity of 0.8 differ in no more bits than the radius; unrelated ones do."""
    rng, far = np.random.default_rng(2), []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 540, np.uint64)
        a, b = (int.from_bytes(similar.wide_fingerprint(s), "big") for s in (x[:486], x[54:]))
        assert (a ^ b).bit_count() <= similar.RADIUS
        far.append((a ^ int.from_bytes(similar.wide_fingerprint(rng.integers(0, 1 << 63, 500, np.uint64)), "big")).bit_count())
    assert min(far) > similar.RADIUS + 20


def test_links_by_whole_texts_only(spark):
    texts = ["a b c d e f", "x b c d e f", "a b c d e", " ".join(f"w{k}" for k in range(29)), " ".join(f"w{k}" for k in range(24))]
    sets = spark.createDataFrame([(k, bytearray(similar.shingles(t).tobytes())) for k, t in enumerate(texts)], "fp long, hashes binary")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a)], "a long, b long")
    assert {tuple(r) for r in similar.confirmed(pairs, sets).collect()} == {(4, 3)}  # 20 of 25 shingles
    assert not len(similar.shingles(" ")) and not len(similar.keys_of(similar.shingles("")))
