"""A training-corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
``documents`` (the last one: token counts and digests). What a stage returns is written as Parquet and read again
as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwater.llm import bpe, decontamination, line_dedup, quality, simhash_dedup
from brightwater.llm.queries import DIGESTS
from brightwater.llm.shared import discard, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from ``labels`` of rows that are not held out. Each row is judged by its own text, null as
    empty, whatever its id."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; ``n_chars`` follows the text. Every row stays, with its own other columns: those with a
    null id whole, those that repeat an id each without its own lines. Null texts become empty."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-copies: one row, even where rows repeat its id. Rows with a null id stay."""
    return simhash_dedup.first_of_groups(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item, each judged by its own text: a null or repeated id neither saves a row nor removes another."""
    items = decontamination.question_and_answer(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontamination.find_contamination(docs, items, carry=COLUMNS[1:]).where("n_items = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of its ids and of its decoded text; null texts count as empty, null and repeated ids each keep their row."""
    tokenizer = bpe.read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_decode(docs, tokenizer, outputs=DIGESTS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", shared_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again; a stage's files go when the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        discard(docs)
        docs = rows
    return docs
