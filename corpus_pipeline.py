"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import common, mixing, packing, quality_model, similar, suffix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those that a similarity of 0.8 or more links, by the five-word shingles of whole texts.

    SimHash and BK-trees find the candidates, in shards that hold for that similarity; sets of shingles confirm them.
    """
    return similar.near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier too are cut out."""
    return suffix.remove_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet their source's target, in the order of training."""
    return mixing.mix(docs)


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of one length, a row a piece, numbered in the order of training, which is that of the mix's files."""
    docs, order = packing.in_file_order(docs)
    return packing.pack_documents(docs, order=order)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_sources", mixing_sources),
    ("lexical_packing", lexical_packing),
]

#: No stage's model, hash or tokenizer has a counterpart in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents.

    What each stage but the last returns is written to the shared folder and read again; a table goes once the next
    stage's is written. The last one stays, as the result reads it.
    """
    docs, before = common.documents(spark, sf_dir), None
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                common.drop_table(spark, before)
            before = f"{folder}/{name}"
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        common.drop_table(spark, folder)
        raise
