"""Bounded samples of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """text and label of at most most[v] documents for each label v, of rows where learn (over key) holds: those with the least hash of the key, so that the sample is the same at every run. Of several rows with one key, the one with the least hash of its text stands for it. Null keys, labels and texts are left out."""
    rows = labels.where(F.col(key).isNotNull() & learn).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    some = None
    for v, n in most.items():
        one = rows.where(F.col("label") == v).dropDuplicates(["_key"]).orderBy(F.xxhash64("_key"), "_key").limit(n)
        some = one if some is None else some.unionByName(one)
    # at most sum(most.values()) short rows, whatever the size of the tables
    found = docs.where(F.col(text).isNotNull()).join(F.broadcast(some), docs[key] == some["_key"]).select(F.col("_key").alias("key"), F.col(text).alias("text"), "label")
    first = found.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one"))
    return first.select("key", F.col("one.text").alias("text"), "label")
