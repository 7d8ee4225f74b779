"""A corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` applies them to ``documents``, writing each
stage's result as Parquet in the shared folder and reading it back as the next one's input. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, mixing, quality, shingles, suffix
from pulsegrid.llm.common import drop, stored

#: Cut at which a document is rejected.
THRESHOLD = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier predicts as label 0. It learns from the labelled documents outside fold 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(quality.fold_of() != 0)
    model = quality.fit(docs, labels)
    return quality.score(docs, model, THRESHOLD).filter("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id: texts whose sets of five-word shingles have a similarity of 0.8 or more.

    Candidates come from the SimHash tables and from min-hash bands, as SimHash alone finds few pairs below 0.95; all are verified.
    """
    return shingles.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that a string of 200 bytes covers which also starts elsewhere. Every document stays as a row."""
    return suffix.deduped(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids."""
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocab, bpe.train_lexicon(docs, vocab))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]
#: A classifier and fingerprints have no SQL of the same meaning; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
        if before is not None:
            drop(before)  # what the stage has read is not read again
        before = docs
    return docs
