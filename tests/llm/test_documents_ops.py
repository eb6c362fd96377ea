"""The operators over documents against brute force, and their defined results on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from triagelake.llm import lm, media, mixing, packing, quality_model, rules, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket string, score int, size string"
WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    """(doc_id, text, source) as documents with extra columns whose names the operators use inside."""
    full = [(d, t, "en", s, None if t is None else len(t), "x", "y", 1, "z") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, prose(rng.randint(5, 120)), f"s{k % 3}") for k in range(40)]
    near = prose(400)
    rows += [(100 + k, near + f" tail{k}", "s0") for k in range(6)]
    rows += [(50, None, None), (51, "", "s1"), (52, " \n\t", None), (None, prose(30), "s2"), (53, "One", ""), (54, "Ab\x0bcd\x1cef gh", "s1")]
    rows += [rows[0], rows[0], (7, prose(9), "s0"), (60, prose(30_000), "s0"), (61, "a " * 3000, "s1"), (62, "x" * 50_000, "s2")]
    return rows


# --- SimHash ---------------------------------------------------------------------------------------------------------


def naive_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    rows = odd_rows()
    fps = [naive_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    find = lambda k: k if group[k] == k else find(group[k])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for k, (d, _, _) in enumerate(rows):
        ids[find(k)].append(d)
    want = sorted((str(d), f"{fps[k]:016x}", min((x for x in ids[find(k)] if x is not None), default=None)) for k, (d, _, _) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_query(frame(spark, rows)).collect())
    assert got == want


def test_simhash_chains_join_components(spark):
    """A long chain of links is one component, though its ends differ in many bits."""
    chain, value = [], 0
    for k in range(40):
        chain.append(value)
        value |= 0b111 << (k % 21 * 3)
    fps = sorted({c for c in chain})
    edges = spark.createDataFrame([(a, b) for a, b in simhash.linked(fps, 4)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    ring = spark.createDataFrame([(k, (k + 1) % 50) for k in range(50)] + [(100, 101)], "a long, b long")
    assert {r.root for r in simhash.components(ring).collect()} == {0, 100}


def test_bktree_finds_what_brute_force_finds():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(12)})
    parent = {v: v for v in values}
    find = lambda v: v if parent[v] == v else find(parent[v])
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    root = {v: v for v in values} | dict(simhash.linked(values, 4))
    assert all((root[a] == root[b]) == (find(a) == find(b)) for a in values for b in values)


def test_shard_edges_over_batch_borders():
    fps = [0, 1, 3, 1 << 40, 5]
    batches = [pa.RecordBatch.from_pydict({"shard": [1], "part": [0], "fp": [f]}) for f in fps] + [pa.RecordBatch.from_pydict({"shard": [2, 2, 2, 3], "part": [0, 0, 1, 1], "fp": [8, 9, 11, 10]})]
    edges = {(a, b) for out in simhash.shard_edges(iter(batches), 4) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    assert edges == {(1, 0), (3, 0), (5, 0), (1 << 40, 0), (9, 8)}


def test_near_dedup_keeps_one_row_and_all_columns(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    groups = {(r.component_id, r.first_rid) for r in simhash.grouped(df).collect()}
    assert kept.count() == len(groups)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c, _ in groups)


@pytest.mark.parametrize("dense", [1, 5, 50])
def test_dense_shards_split_without_losing_a_link(spark, dense):
    """Thousands of fingerprints around two centres: shards of any size find the components of all pairs."""
    rng = random.Random(dense)
    centres = [rng.getrandbits(64) for _ in range(2)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), dense=dense)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    parent = list(range(len(values)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                parent[top(i)] = top(j)
    ours, theirs = {}, {}
    for k, v in enumerate(signed):
        ours.setdefault(root.get(v, v), set()).add(k)
        theirs.setdefault(top(k), set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


# --- quality classifier ----------------------------------------------------------------------------------------------


def labelled(n=400):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 200)))
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join(w + "***" for w in text.split()), " ".join([words[k % 9]] * 80)][k % 3]
        rows.append((k, text, "s0"))
        labels.append((k, int(good), 0))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.classifier_query(frame(spark, rows), lab).collect()}
    held = [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in held) for k in got)
    assert np.mean([got[k].predicted == q for k, q, _ in labels if k in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_held_out_labels_never_teach(spark):
    rows, labels = labelled()
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    lied = [(k, 1 - q if held(k) else q, t) for k, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    df = frame(spark, rows)
    a, b = (quality_model.fit(df, spark.createDataFrame(x, schema)) for x in (labels, lied))
    assert (a.intercept, a.rules) == (b.intercept, b.rules)


def test_compiled_rules_score_like_numpy(spark):
    rows, labels = labelled(200)
    model = quality_model.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = model.score(np.array([quality_model.statistics(t) for _, t, _ in rows]))
    got = {r.doc_id: r.score for r in quality_model.scored(frame(spark, rows), model).collect()}
    assert np.allclose([got[k] for k, _, _ in rows], want, atol=1e-12)


def test_classifier_on_odd_rows(spark):
    rows = odd_rows()
    schema = "doc_id long, quality int, toxic int"
    none = quality_model.classifier_query(frame(spark, rows), spark.createDataFrame([], schema)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    strange = spark.createDataFrame([(None, 1, 0), (1, None, 0), (999, 0, 0)], schema)
    assert quality_model.classifier_query(frame(spark, rows), strange).count() == len(rows)
    assert quality_model.classifier_query(frame(spark, []), strange).count() == 0
    df = frame(spark, rows).withColumnRenamed("score", "statistics")
    kept = quality_model.keep_good(df, quality_model.Ensemble())
    assert kept.columns == df.columns and kept.count() == len(rows)


# --- language model --------------------------------------------------------------------------------------------------


def naive_lm(rows, vocab, weights):
    """(doc_id, tokens, score, unseen) by the definition: loops over words and plain arithmetic on the network's weights."""
    emb, hidden, hb, o, ob = (np.asarray(w, np.float64) for w in weights)
    texts = [(d, [w.encode() for w in re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]) for d, t, _ in rows]
    uses = collections.Counter(w for _, words in texts for w in words)
    key = lambda w: xxhash.xxh64_intdigest(w) - 2**63
    head = {h: k + 1 for k, h in enumerate(vocab.head.tolist())}
    mass, total, place = 0.0, sum(math.sqrt(n) for n in vocab.counts), []
    for n in vocab.counts:
        place.append(min(lm.HEADS - 1, int(mass * lm.HEADS / total)))
        mass += math.sqrt(n)
    rare = {w: zlib.crc32(w[-2:]) % lm.TAILS for w in uses if key(w) not in head}
    of_class = collections.Counter()
    for w, n in uses.items():
        of_class[lm.HEADS + rare[w] if w in rare else place[head[key(w)] - 1]] += n
    distinct = collections.Counter(rare.values())
    out = []
    for d, words in texts:
        own = collections.Counter(words)
        ids = [0, 0, *(1 + len(head) + rare[w] if w in rare else head[key(w)] for w in words), 0, 0]
        score = 0.0
        for k, w in enumerate(words):
            x = np.concatenate([emb[ids[k + 2 + j]] for j in (-2, -1, 1, 2)])
            z = np.tanh(x @ hidden + hb) @ o + ob
            c = lm.HEADS + rare[w] if w in rare else place[head[key(w)] - 1]
            score += z[c] - math.log(sum(math.exp(v) for v in z))
            if w in rare:
                score += math.log((uses[w] - own[w] + 0.05) / (of_class[c] + 0.05 * (distinct[rare[w]] + 1)))
            else:
                score += math.log(uses[w] / of_class[c])
        out.append((d, len(words), score, sum(uses[w] == own[w] and w in rare for w in words)))
    return out


def test_lm_scores_are_sums_of_conditional_log_probabilities(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 700)
    rows = odd_rows()
    rows += [(700 + k, rows[k][1] + " again", "s0") for k in range(12)]
    df = frame(spark, rows)
    counts = lm.cut(lm.word_counts(df))
    vocab = lm.vocabulary(counts)
    uses = collections.Counter(w for _, t, _ in rows for w in (t or "").encode().lower().split())
    assert sorted(vocab.counts.astype(int).tolist()) == sorted(n for n in uses.values() if n >= lm.LEAST) and len(vocab.head) > 5
    net = lm.trained(df, vocab, share=2)
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_unseen, r.score) for r in lm.scored(df, counts, vocab, net).collect()))
    want = sorted((str(d), n, unseen, score) for d, n, score, unseen in naive_lm(rows, vocab, net.weights))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-5, atol=1e-4)


def test_lm_predicts_held_out_texts_better_than_frequencies(spark):
    """Trained on some documents, the network tells the words of others from both sides."""
    rng = random.Random(6)
    line = lambda n: " ".join(x for _ in range(n) for x in (rng.choice(["red", "blue"]), "a b c".split()[rng.randrange(3)], "end"))
    df = frame(spark, [(k, line(60), "s") for k in range(200)])
    vocab = lm.vocabulary(lm.cut(lm.word_counts(df)))
    reader = lm.Reader(vocab)
    flat, at = lm.joined([reader.ids(line(60).encode().split()) for _ in range(20)])
    loss = lambda net: -net.score(net.tables(), flat, at).mean()
    assert loss(lm.trained(df, vocab, share=1)) < loss(lm.Network(vocab)) - 0.4


def test_every_document_trains_once(spark):
    rows = [(k, f"text {k % 50}") for k in range(300)] + [(None, "same"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rounds = [[r.text for r in part.collect()] for part in lm.dealt(df)]
    assert sorted(map(str, sum(rounds, []))) == sorted(str(t) for _, t in rows) and all(len(r) > 100 for r in rounds)


def lm_vocabulary(words):
    """Of words, each one of the head; the tail is empty."""
    heads = sorted(words)
    return lm.Vocabulary(np.array([lm.word_key(w) for w in heads], np.int64), np.full(len(heads), 60.0), np.zeros(lm.TAILS), np.zeros(lm.TAILS))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_lm_reads_words_as_arrays(monkeypatch, kind):
    """Keys and ids are those of each word by itself, and no word is hashed by itself but those of 32 bytes or more."""
    rng = random.Random(9)
    texts = [t for _, t, _ in odd_rows()] + [None, "", " ", "\x1c", "A\x0bb\x1cC\u00a0d\u0085\u00c4\tX\n\r\x0c", "x" * 31 + " " + "Y" * 32 + " " + "z" * 33]
    texts += [" " * rng.randrange(2) + " ".join("".join(rng.choice("abCÄ字\x00") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(9))) for _ in range(400)]
    words = [(t or "").encode().lower().split() for t in texts]
    head = {w for ws in words[::2] for w in ws}
    vocab = lm_vocabulary(head)
    place = {h: k for k, h in enumerate(vocab.head.tolist(), 1)}
    want = [(lm.word_key(w), place.get(lm.word_key(w)) or 1 + len(head) + lm.tail_class(w)) for ws in words for w in ws]
    lm.endings()
    alone = []
    monkeypatch.setattr(lm, "CHUNK", 60)
    monkeypatch.setattr(lm, "HASHED", 50)
    monkeypatch.setattr(lm, "word_key", lambda w: alone.append(w))
    monkeypatch.setattr(lm, "tail_class", lambda w: alone.append(w))
    for shift in (0, 3):
        column = pa.array([None, "no word of these", ""][:shift] + texts, kind).slice(shift)
        runs = list(lm.Reader(vocab).read(column))
        assert len(runs) > 20 and [n for sizes, _, _ in runs for n in sizes.tolist()] == [len(ws) for ws in words]
        assert [x for _, keys, ids in runs for x in zip(keys.tolist(), ids.tolist())] == want
    assert not alone and list(lm.Reader(lm_vocabulary([])).read(pa.array([], kind))) == []
    void = pa.Array.from_buffers(kind, 2, [pa.py_buffer(b"\x02"), pa.array(["ab cd", "ef"], kind).buffers()[1], pa.py_buffer(b"ab cdef")])
    assert [sizes.tolist() for sizes, _, _ in lm.Reader(lm_vocabulary([])).read(void)] == [[0, 1]]  # bytes of a null are no text


@pytest.mark.parametrize("scale", [1, 40])
def test_lm_step_follows_the_gradient(scale):
    """A step is that of plain sums over the batch in float64, for texts of any length and weights of any size."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 40, n).astype(np.int32) for n in (1, 1, 2, 70, 1, 3, 200)]
    net = lm.Network(lm_vocabulary([b"w%d" % k for k in range(8)]))
    net.weights = [(w * scale).astype(np.float32) for w in net.weights]
    emb, hidden, hb, o, ob = (w.astype(np.float64) for w in net.weights)
    flat, at = lm.joined(texts)
    here, (g_emb, g_hidden, g_hb, g_o, g_ob), want = at[:250], [np.zeros(w.shape) for w in net.weights], 0.0
    for p in here:
        near = [flat[p + k] for k in lm.PLACES]
        x = np.concatenate([emb[i] for i in near])
        h = np.tanh(x @ hidden + hb)
        z = h @ o + ob
        d = np.exp(z - z.max())
        d /= d.sum()
        want += math.log(d[net.classes[flat[p]]])
        d[net.classes[flat[p]]] -= 1
        dh = (o @ d) * (1 - h * h) / len(here)
        g_hidden, g_hb, g_o, g_ob = g_hidden + np.outer(x, dh), g_hb + dh, g_o + np.outer(h, d) / len(here), g_ob + d / len(here)
        for i, part in zip(near, (hidden @ dh).reshape(-1, lm.EMBEDDING)):
            g_emb[i] += part
    grown = [np.full_like(w, 0.01) for w in net.weights]
    assert math.isclose(float(net.score(net.tables(), flat, here).sum()), want, rel_tol=1e-4)
    assert math.isclose(net.step(flat, here, grown), want, rel_tol=1e-4)
    for new, old, g, sq in zip(net.weights, (emb, hidden, hb, o, ob), (g_emb, g_hidden, g_hb, g_o, g_ob), grown):
        assert np.allclose(sq, 0.01 + g * g, rtol=1e-3, atol=1e-6) and np.allclose(new, old - lm.RATE * g / np.sqrt(0.01 + g * g + 1e-6), rtol=1e-4, atol=1e-4)


def test_lm_knows_what_occurs_twice(spark):
    """Of texts of rare words those with a twin have no word that others lack, and score higher."""
    rng = random.Random(8)
    odd = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(40))
    once, twice = [odd() for _ in range(30)], [odd() for _ in range(10)]
    rows = [(k, t, "s") for k, t in enumerate(once + twice + twice)]
    got = {r.doc_id: r for r in lm.score_documents(frame(spark, rows)).collect()}
    assert all(got[k].n_unseen == 40 and got[k].unseen_share == 1.0 for k in range(30)) and all(got[k].n_unseen == 0 for k in range(30, 50))
    assert min(got[k].mean_score for k in range(30, 50)) > max(got[k].mean_score for k in range(30)) + 1


@pytest.mark.parametrize("held", [lm.HELD, 150, 1])
def test_lm_counts_every_word(monkeypatch, held):
    """However few words a task holds, and however often it sends them on."""
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "CHUNK", 100)
    texts = [t for _, t, _ in odd_rows()] * 3
    uses = collections.Counter(w for t in texts for w in (t or "").encode().lower().split())
    got = [pa.table({"text": pa.array(texts[k : k + 40], pa.string())}).to_batches()[0] for k in range(0, len(texts), 40)]
    sent = [r for batch in lm.counted(iter(got)) for r in batch.to_pylist()]
    sums = collections.Counter()
    for r in sent:
        sums[r["h"], r["tail"]] += r["n"]
    assert sums == {(lm.word_key(w), zlib.crc32(w[-2:]) % lm.TAILS): n for w, n in uses.items()}
    assert (len(sent) > len(sums)) == (held < 400_000)


def test_lm_on_an_empty_table(spark):
    assert lm.score_documents(frame(spark, [])).count() == 0


# --- quality rules ---------------------------------------------------------------------------------------------------


def naive_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    m = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated))
    return (*m, m[0] < 10 or 100 * m[4] > 20 * m[0])


def test_rules_against_naive_counts(spark):
    rows = odd_rows() + [(200, "a b c d e f g\nx\na b c d e f g\n\n \nx\nx # *", "s"), (201, "p q r s t u v w x y z " * 3, "s")]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.cascade(frame(spark, rows)).collect())
    assert got == sorted((str(d), *naive_rules(t)) for d, t, _ in rows)


def test_rule_order_changes_no_verdict(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    verdicts = [sorted((str(r.doc_id), r.kept) for r in rules.cascade(df, order).collect()) for order in (rules.RULES, rules.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    assert rules.cascade(frame(spark, [])).count() == 0


def test_rules_by_rejections_per_second():
    a, b, c = rules.RULES[:3]
    assert rules.ordered((a, b, c), [(0b001, 10, [0.9, 0.05, 0.01]), (0b010, 5, [0.1, 0.05, 0.0])]) == [b, a, c]
    # what b rejects, a rejects too: once a has run there is nothing left for b, and c comes next
    assert rules.ordered((a, b, c), [(0b011, 9, [0.1, 0.2, 0.0]), (0b100, 1, [0.0, 0.0, 0.3])]) == [a, c, b]


def test_rules_are_measured_on_texts_that_pass_the_base(spark):
    rows = [(k, "too short", "s") for k in range(300)] + [(1000 + k, " ".join(f"w{k}x{j}#" for j in range(20)), "s") for k in range(20)]
    measured = rules.costs(frame(spark, rows), rules.RULES, 400)
    assert sum(n for _, n, _ in measured) == 20 and all(mask & 1 for mask, *_ in measured)


# --- token counts ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, normalizers

    scores = tokens.vocabulary(tokens.default_path())
    least = min(scores.values())
    pieces = [("<unk>", least)] + [(f"<0x{b:02X}>", least) for b in range(256)] + list(scores.items())
    found = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    found.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return found


def test_counts_equal_the_tokenizers(unigram):
    own = tokens.counter(tokens.default_path())
    odd = ["a", "  two  spaces ", "日本語 x", "\n", "tab\tx", "ß" * 5, "▁a", "a\nb\n\nc", "🎉🎉", "\U00012000\U00012001 x", "a\x00b"]
    for text in odd + [(t or "")[:3000] for _, t, _ in odd_rows()]:
        assert own.count(text)[0] == len(unigram.encode(text).ids), text[:50]


def test_counts_against_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(40):
        scores = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 6)) for _ in range(12)}
        own = tokens.Counter(scores)
        text = "".join(rng.choice("abc d\n") for _ in range(rng.randint(1, 25)))
        marked = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [None] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(end):
                piece = marked[start:end]
                if piece in scores:
                    gain, n = scores[piece], 1
                elif end - start == 1:
                    gain, n = min(scores.values()) - 10, len(piece.encode())
                else:
                    continue
                if best[end] is None or best[start][0] + gain > best[end][0]:
                    best[end] = (best[start][0] + gain, best[start][1] + n)
        assert own.count(text) == (best[-1][1], best[-1][0])


def test_long_unbroken_texts_in_little_memory(monkeypatch):
    """Blocks, rings and long chunks change no count; memory doesn't grow with a text that has no break."""
    import tracemalloc

    rng, scores = random.Random(3), {}
    for _ in range(30):
        scores["".join(rng.choice("ab▁日") for _ in range(rng.randint(1, 5)))] = float(-rng.randint(1, 7))
    scores = {p: v for p, v in scores.items() if "▁" not in p[1:]}
    texts = ["".join(rng.choice("aab 日\nc") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    plain = [tokens.Counter(scores).count(t) for t in texts]
    monkeypatch.setattr(tokens, "BLOCK", 7)
    monkeypatch.setattr(tokens, "LONG", 3)
    assert [tokens.Counter(scores, 500).count(t) for t in texts] == plain
    own = tokens.counter(tokens.default_path())
    text = "日本語" * 300_000
    tracemalloc.start()
    n, _ = own.count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == own.count("日本語")[0] * 300_000 - 299_999 * (own.count("日本語")[0] - own.best("日本語")[0]) and peak < 8 * len(text)


def test_counts_on_odd_rows(spark):
    rows = odd_rows()
    own = tokens.counter(tokens.default_path())
    got = collections.Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(frame(spark, rows)).collect())
    assert got == collections.Counter((d, own.count(t or "")[0]) for d, t, _ in rows)
    assert tokens.count_tokens(frame(spark, [])).count() == 0


# --- media -----------------------------------------------------------------------------------------------------------


def test_payloads_come_back(spark):
    rows = odd_rows() + [(300, "é" * 31 + "ab", "s"), (301, "x" * 64, "s")]
    got = collections.Counter(map(tuple, media.store_and_sniff(frame(spark, rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes").collect()))
    want = collections.Counter()
    for d, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        want[(d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)] += 1
    assert got == want


def png(data=b"\0\xff\0\0"):
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_sniffing_confirms_structure(spark):
    wav = media.store(b"\1" * 64)
    bad_png = png()[:-5] + b"xxxxx"
    gif = b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    found = media.automaton()
    assert media.sniff(wav, found) == ("audio/wav", [])
    assert media.sniff(png(), found) == ("image/png", [])
    assert media.sniff(gif, found) == ("image/gif", [])
    assert media.sniff(bad_png, found)[0] == media.UNKNOWN
    assert media.sniff(wav[:-3], found)[0] == media.UNKNOWN
    assert media.sniff(b"", found) == (media.EMPTY, [])
    inside = media.store(b"ab" + png() + b"\0" * 7 + gif)
    assert media.sniff(inside, found) == ("audio/wav", [("image/png", 46, len(png())), ("image/gif", 46 + len(png()) + 7, len(gif))])
    rows = [(1, bytearray(png()), "image/gif"), (2, bytearray(b"abc"), "text/plain"), (3, None, None), (4, bytearray(inside), "audio/wav")]
    got = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows, "id long, body binary, said string"), "id", "body", "said").collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", True)
    assert (got[2].media_type, got[2].corrected) == ("text/plain", False)
    assert got[3].media_type == media.EMPTY
    assert [c.type for c in got[4].carved] == ["image/png", "image/gif"] and got[4].carved[0].sha256 == hashlib.sha256(png()).hexdigest()


def naive_feature(media_bytes, carved):
    return f"audio/wav;corrected=1;carved={len(carved)};bytes={sum(map(len, carved))}"


def test_features_and_stored_bytes_against_a_container_built_by_the_standard_library(spark):
    import io
    import wave

    gif = "GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    rows = [(1, "plain text", []), (2, "a {\\rtf1 b} c", ["{\\rtf1 b}"]), (3, f"x{gif}y", [gif]), (4, "%PDF-1 a %%EOF b %%EOF c", ["%PDF-1 a %%EOF b %%EOF"]), (5, None, []), (6, "{\\rtf open", [])]
    got = {r.doc_id: r for r in media.store_and_sniff(frame(spark, [(d, t, "s") for d, t, _ in rows])).collect()}
    for d, t, carved in rows:
        raw = (t or "").encode()
        payload, out = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64)), io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        assert got[d].media_sha256 == hashlib.sha256(out.getvalue()).hexdigest() and got[d].media_bytes == len(out.getvalue())
        assert got[d].feature == naive_feature(out.getvalue(), [c.encode() for c in carved])


def ole(sectors):
    """A compound file of one table sector and so many sectors of data."""
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + b"\x3e\0\3\0\xfe\xff\x09\0\6\0" + bytes(10) + (1).to_bytes(4, "little") + bytes(20)
    head += b"\xfe\xff\xff\xff" + bytes(4) + (0).to_bytes(4, "little") + b"\xff\xff\xff\xff" * 108
    table = b"\xfd\xff\xff\xff" + b"\xfe\xff\xff\xff" * sectors + b"\xff\xff\xff\xff" * (127 - sectors)
    return head + table + b"d" * 512 * sectors


def test_lengths_of_formats():
    import io
    import zipfile

    found, out, outer = media.automaton(), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 50)
    with zipfile.ZipFile(outer, "w") as z:  # stored, not compressed: its end record lies within
        z.writestr("in.zip", out.getvalue())
        z.writestr("b.txt", "y")
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2scan\xff\0\xff\xd0more\xff\xc4\0\6\xff\xd9zz\xff\xda\0\2again\xff\xd9"
    flac = b"fLaC\0\0\0\x22" + bytes(34) + b"\x84\0\0\5hello\xff\xf8frames"
    ogg = b"OggS\0" + bytes(21) + b"\2\3\4" + b"x" * 7 + b"OggS\0" + bytes(21) + b"\1\1" + b"y"
    pdf = b"%PDF-1.4 one %%EOF two %%EOF"
    rtf = b"{\\rtf1 {a} \\} \\{ b}"
    for kind, part in (("application/zip", outer.getvalue()), ("image/jpeg", jpeg), ("application/ogg", ogg), ("application/pdf", pdf), ("application/rtf", rtf), ("application/x-ole-storage", ole(3)), ("image/png", png())):
        assert media.sniff(b"--" + part + b"--tail", found)[1] == [(kind, 2, len(part))], kind
        assert media.sniff(part, found)[0] == kind
        if kind not in ("application/pdf", "application/ogg"):  # these are whole up to an earlier end
            assert 2 not in [start for _, start, _ in media.sniff(b"--" + part[:-1], found)[1]], kind
    assert media.sniff(b"--" + flac + png(), found)[1] == [("audio/flac", 2, len(flac)), ("image/png", 2 + len(flac), len(png()))]


@pytest.mark.parametrize("unit", [b"{\\rtf ", b"\xff\xd8\xff\xda\0\2", b"\xff\xd8\xff\xe0\0\2", b"%PDF-1", b"PK\3\4", b"GIF89a\1\0\1\0\0\0\0!\0\1", b"OggS\0" + bytes(22), b"fLaC\0\0\0\x22"])
def test_many_false_hits_cost_little(unit):
    import time

    found, took = media.automaton(), []
    for n in (1 << 18, 1 << 20):
        content = unit * (n // len(unit))
        start = time.perf_counter()
        media.sniff(content, found)
        took.append(time.perf_counter() - start)
    assert took[1] < max(2.0, 12 * took[0])


# --- mixing ----------------------------------------------------------------------------------------------------------


def naive_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_meets_its_targets(spark):
    rows = odd_rows() + [(400 + k, "w " * 50, "only") for k in range(5)]
    docs = mixing.mixing_query(frame(spark, rows))
    source = {d: s for d, _, s in rows}
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    want, taken, largest = naive_targets(dict(sizes)), collections.Counter(), collections.Counter()
    got = docs.collect()
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id] if r.doc_id != 7 else ("s0" if math.isclose(r.target, want["s0"]) else "s1")
        assert math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    again = mixing.mixing_query(frame(spark, rows[::-1]))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_stream_is_in_order_of_position(spark):
    rows = [r for r in odd_rows() if r[0] not in (0, 7)]
    df = frame(spark, rows)
    stream = mixing.mix(df)
    assert stream.columns == df.columns
    query = [r for r in mixing.mixing_query(df).collect() if r.copies]
    assert [r.position for r in query] == sorted(r.position for r in query)
    seen = [r.doc_id for r in stream.collect()]
    assert collections.Counter(seen) == {r.doc_id: r.copies for r in query}
    first = {d: k for k, d in reversed(list(enumerate(seen)))}
    assert sorted(first, key=first.get) == [r.doc_id for r in query]


def test_repeated_rows_are_dealt_one_by_one(spark, monkeypatch):
    """A third of all rows are one row; others share an id or have none. Words taken and targets hold, and rows are all there."""
    monkeypatch.setattr(mixing, "TOGETHER", 7)
    rng = random.Random(2)
    rows = [(1, "w " * 9, "hot")] * 60 + [(2, None, "hot")] * 5 + [(rng.choice([3, None]), "v " * rng.randint(1, 30), rng.choice(["a", "hot", None])) for _ in range(115)]
    df = frame(spark, rows).repartition(5)
    got = mixing.mixing_query(df).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, len((t or "").split())) for d, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, stream = naive_targets(dict(sizes)), mixing.mix(df).collect()
    taken = collections.Counter()
    for r in stream:
        taken[r.source] += len((r.text or "").split())
    assert all(abs(taken[s] - want[s]) <= 15 for s in want)
    assert sum(r.taken for r in got) == sum(taken.values())
    assert collections.Counter(len(r.text.split()) for r in stream) == collections.Counter(r.size for r in got for _ in range(r.copies))


def test_many_sources_are_ranked_like_few(spark):
    rows = [(k, "w " * (k % 11), None if k == 9 else f"s{k % 97:03d}é") for k in range(300)]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = naive_targets(dict(sizes))
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.rank)] == sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_positions_follow_the_schedule(spark):
    rows = [(k, "w " * 10, f"s{k % 3}") for k in range(300)]
    got = mixing.mixing_query(frame(spark, rows)).collect()
    first = {r.doc_id: r.position for r in got if r.position is not None}
    assert all(0 <= p <= 1 for p in first.values())
    early = lambda s: np.mean([p < 0.5 for d, p in first.items() if d % 3 == s])
    assert early(0) < early(1) + 0.3 and early(2) > early(0)


def test_mixing_nothing(spark):
    assert mixing.mixing_query(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixing_query(frame(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    assert mixing.mix(frame(spark, [])).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing_holds_every_token_once(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [r for r in odd_rows() if r[0] != 7] + [(500, "a <|endoftext|> b  c'll　x", "s")]
    rows = list({r[0]: r for r in rows}.values())
    ids = {d: np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t, _ in rows}
    got = packing.pack_documents(frame(spark, rows).repartition(2), with_ids=True).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        a = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(a.tobytes()) == r.ids_crc32 and r.ids == a.tolist()
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for found, sizes in ((sequences, None), (pieces, ids)):
        for key, parts in found.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == len(sizes[key]) if sizes else (at == 2048 or (at < 2048 and at & (at - 1) == 0))
    assert set(pieces) == set(ids)


def test_packing_in_the_order_of_files(spark, tmp_path, monkeypatch):
    """Sequences are numbered by the first of their documents; every token is there once."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    monkeypatch.setattr(packing, "BAND_SHARDS", 2)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["red", "blue", "green", "sky"]) + str(rng.randrange(99)) for _ in range(rng.randint(0, 900))), "s") for k in range(150)]
    frame(spark, rows).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/t")
    docs, order = packing.in_file_order(spark.read.parquet(f"{tmp_path}/t"))
    pieces = packing.pack_documents(docs, order=order).collect()
    enc = packing.encoder()
    assert sum(r.length for r in pieces) == sum(len(packing.token_ids(t, enc)) for _, t, _ in rows)
    first = {}
    for r in pieces:
        first[r.sequence_id] = min(first.get(r.sequence_id, r.doc_id), r.doc_id)
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    plain, place = packing.in_file_order(frame(spark, rows[:20]))
    assert {r.doc_id for r in packing.pack_documents(plain, order=place).collect()} == set(range(20))


def test_long_texts_encode_in_pieces():
    """Pieces are cut where the pattern always splits, so their ids are those of the whole."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own, enc, rng = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder(), random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b c", " ", "  ", "'s", "\n", " \n", "7", "é", "日", ".", "\x1c", "\u00a0", "<|endoftext|>"]) for _ in range(80))
        assert packing.token_ids(text, enc, 9).tolist() == own.encode(text, add_special_tokens=False).ids + [1]


def test_copies_and_like_documents_follow_each_other(spark):
    """Documents on one subject lie in one shard though thousands of others lie between them in the table."""
    enc = packing.encoder()
    a = "hydraulic turbines spin generators beneath reservoirs turbines hydraulic generators"
    key = packing.content_key(packing.token_ids(a, enc))
    assert packing.content_key(packing.token_ids(a + " again", enc)) == key
    assert packing.content_key(packing.token_ids("violins and cellos play slow quartets for violins", enc)) != key
    assert -(1 << 63) <= packing.content_key(np.array([1], np.uint32)) < 1 << 63


def test_neighbours_share_a_window():
    """Documents on one subject are packed together, though others stand between them."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * (k % 4), 1000 * (k % 4) + 40, 500).astype(np.uint32) for k in range(16)]
    sequences = packing.pack(docs, 2000)
    subjects = [{k % 4 for k, _, _ in s} for s in sequences]
    assert all(len(s) == 1 for s in subjects) and len(sequences) == 4


def test_bm25_against_its_formula():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 2, 3], [2, 3, 3], [5, 6], [1, 5, 5, 5, 2])]
    index = packing.Index(docs)
    mean = np.mean([len(d) for d in docs])
    for q in range(len(docs)):
        got = index.scores(q)
        for d in range(len(docs)):
            want = 0.0
            for t in set(docs[q].tolist()):
                df, tf = sum(t in x for x in docs), int((docs[d] == t).sum())
                want += math.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
            assert math.isclose(got[d], want, rel_tol=1e-9)


def test_packing_nothing(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
    assert [(r.length, r.doc_tokens) for r in packing.pack_documents(frame(spark, [(1, None, None)])).collect()] == [(1, 1)]
