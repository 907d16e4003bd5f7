"""Sparse term-frequency vectors: counts, norms, the inverted index and feature statistics.

A vector table has (collection, function_id, hash, tf); tf is a long, so all sums are exact and
do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection", "function_id"]


def term_frequencies(occurrences: DataFrame) -> DataFrame:
    """vec_tf from one row for each feature occurrence."""
    return occurrences.where("hash is not null").groupBy(*KEY, "hash").agg(F.count("*").alias("tf"))


def tf_lists(vec: DataFrame) -> DataFrame:
    """Each function's features as an array of (hash, tf), the most frequent first, then by hash."""
    item = F.struct((-F.col("tf")).alias("n"), "hash", "tf")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["hash"].alias("hash"), x["tf"].alias("tf")))
    return vec.groupBy(*KEY).agg(ordered.alias("features"))


def norms(vec: DataFrame) -> DataFrame:
    """n2 (squared norm) and total (sum of tf) stay integers; norm is n2's root."""
    return vec.groupBy(*KEY).agg(F.sum(F.col("tf") * F.col("tf")).alias("n2"), F.sum("tf").alias("total"), F.count("*").alias("unique_features")).withColumn("norm", F.sqrt(F.col("n2").cast("double")))


def document_frequency(vec: DataFrame) -> DataFrame:
    return vec.groupBy("collection", "hash").agg(F.count("*").alias("frequency"))


def feature_stats(vec: DataFrame) -> DataFrame:
    """frequency, tf_score (sum of tf squared) and total_tf (sum of tf) of each feature."""
    return vec.groupBy("collection", "hash").agg(F.count("*").alias("frequency"), F.sum(F.col("tf") * F.col("tf")).alias("tf_score"), F.sum("tf").alias("total_tf"))


def last_context(occurrences: DataFrame, position: str = "pos") -> DataFrame:
    """The last occurrence of each feature in each function."""
    w = Window.partitionBy(*KEY, "hash").orderBy(F.col(position).desc())
    return occurrences.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_context(contexts: DataFrame) -> DataFrame:
    """One context for each feature: that of the least function id."""
    w = Window.partitionBy("collection", "hash").orderBy("function_id")
    return contexts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
