"""The pipeline against its stages' own tests: what each keeps, drops and changes."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    docs, labels = [], []
    for k in range(240):
        text, good = prose(rng.randint(60, 160)), 1
        if k % 6 == 1:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif k % 6 == 2 and k > 12:
            text = docs[k - 12][1]
        elif k % 6 == 3:
            text = prose(80) + " " + passage + " " + prose(80)
        docs.append((k, text, "en", f"src{k % 4}", len(text)))
        labels.append((k, good, 0))
    docs.append((None, prose(100), None, None, None))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "lexical_packing":
            assert docs.columns == columns
    by_id = lambda name: {r.doc_id: r for r in seen[name]}
    good = by_id("quality_classifier")
    assert not [d for d in good if d is not None and d % 6 == 1]
    assert len([d for d in good if d is None or d % 6 != 1]) >= 198
    once = by_id("simhash_near_dedup")
    assert len(once) == len(seen["simhash_near_dedup"]) and not [d for d in once if d is not None and d % 6 == 2 and d > 12 and d - 12 in good]
    cut = by_id("suffix_array_dedup")
    assert set(cut) == set(once)
    carriers = sorted(d for d in cut if d is not None and d % 6 == 3)
    assert cut[carriers[0]].text == once[carriers[0]].text
    assert all(len(cut[d].text) < len(once[d].text) - 200 and cut[d].n_chars == len(cut[d].text) for d in carriers[1:])
    mixed = seen["mixing_sources"]
    sizes = {d: len(r.text.split()) for d, r in cut.items()}
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
    packed = seen["lexical_packing"]
    from triagelake.llm import packing

    enc = packing.encoder()
    total = sum(len(packing.token_ids(r.text or "", enc)) for r in mixed)
    assert sum(r.length for r in packed) == total
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_run_gives_what_the_stages_give(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(0 < r.length <= 2048 and 0 <= r.ids_crc32 < 1 << 32 for r in rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
