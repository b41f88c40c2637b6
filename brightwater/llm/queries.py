"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, decontamination, embedding_dedup, extraction, license_scan, line_dedup, quality, repair, sharding, simhash_dedup, suffix_dedup, warc, whitening
from .shared import new_path

SHARDS = [f"shard-{i:02d}" for i in range(32)]
TABLE_SIZE = 5003
DIGESTS = {
    "n_tokens": (T.LongType(), lambda ids, text: len(ids)),
    "ids_sha256": (T.StringType(), lambda ids, text: hashlib.sha256(bpe.little_endian(ids)).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda ids, text: hashlib.sha256(text().encode()).hexdigest()),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with a license notice: how many windows matched, and the licenses."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"), license_scan.default_templates(spark))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_matches"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.round(F.max("containment"), 6).alias("best_containment"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
    # a response is measured by its payload; a revisit has none and gives what its headers say
    whole = F.col("payload").isNotNull()
    return records.select(
        "page_id", F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.assign_shards(docs, SHARDS, TABLE_SIZE).select("doc_id", "source", "slot", "shard_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    items = decontamination.question_and_answer(_table(spark, sf_dir, "benchmark"))
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), items)
    return found.where("n_items > 0").select("doc_id", F.explode("item_ids").alias("item_id"), "best_overlap")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer, outputs=DIGESTS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviation is null where 64 bits don't hold it."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    out = repair.repair(repair.damage(rows), rows.select(F.col("conv_id").alias("conv")))
    return out.withColumnRenamed("conv", "conv_id")


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"), extraction.default_model(), keep=["page_id", "url"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_license_scan, op3_embedding_dedup, op4_simhash_dedup, op5_warc, op6_sharding, op7_decontamination, op8_bpe, op9_suffix_dedup, op10_quality,
        op11_whitening, op12_repair, op13_extraction,
    )
}
