"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, then token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents; the last
one returns digests of the encoded texts. run() writes each stage's result to the shared folder and reads it again. Null
and empty texts are handled as the operators state: without a word they are of low quality where the labels say so, and
are otherwise one group of near duplicates. An empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.llm import bpe, common, decontam, minhash, quality, queries, secretscan


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled documents, does not reject."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: candidates are the members of a SimHash component (fingerprints at most 2 bits apart, by op10's grid) and, as that radius misses about half of the copies of this similarity, of a MinHash cell; links are those with a 5-word similarity of 0.8 or more, counted exactly. The row is the one with the least doc_id, rows without an id after all others. Texts are told apart by themselves, not by their ids, so rows of one id with different texts are different documents."""
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secretscan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, common.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("bpe_encoding", encode),
]

#: Classifier, fingerprints and encoding are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}", last=True)
        if held is not None:
            common.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
