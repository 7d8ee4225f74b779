"""The registered queries of this subpackage: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, katz, media, mixing, order_minhash, quality, rangecoder, simhash, suffix, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.fold_of(folds=7) == 2
    scored = katz.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_wav(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = media.sniff(stored)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", F.size("carved").alias("n_carved"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(docs, vocab, bpe.train_lexicon(docs, vocab))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return rangecoder.read_tokens(rangecoder.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passage_classes(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(_table(spark, sf_dir, "documents")).drop("spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(quality.fold_of() != 0)
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (quality.fold_of() == 0).alias("held_out"), "score", "predicted")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = order_minhash.with_next(docs, order_minhash.fingerprints, ["text", "signature"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "signature", "next_signature", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("*", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"))
    rows = order_minhash.fingerprints(rows, "edited", "edited_signature").drop("edited")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        order_minhash.written(F.col("signature")).alias("fingerprint"),
        order_minhash.written(F.col("edited_signature")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        order_minhash.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


QUERIES = {f.__name__: f for f in (op1_katz_score, op2_media_columns, op3_simhash, op4_bpe, op5_token_files, op6_passages, op8_suffix_dedup, op9_quality, op7_mix_sources, op10_order_minhash)}
SQL = {"op7_mix_sources": mixing.SQL}
