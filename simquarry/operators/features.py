"""Feature search and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import page
from .vectors import feature_stats, first_context


def search_features(vec: DataFrame, prefix: str = "", sort: str = "tf", offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of features with frequency, tf_score and total_tf: by tf_score, then hash, both
    descending ("tf"), or by hash."""
    rows = vec.where(F.startswith("hash", F.lit(prefix))) if prefix else vec
    stats = feature_stats(rows)
    return page(stats, [F.col("tf_score").desc(), F.col("hash").desc()] if sort == "tf" else [F.col("hash")], offset, limit)


def with_context(features: DataFrame, contexts: DataFrame, tokens: DataFrame) -> DataFrame:
    """A page of features with the first context's function, type, operation and source line."""
    first = first_context(contexts.join(features.select("collection", "hash"), ["collection", "hash"], "left_semi"))
    first = first.select("collection", "hash", "function_id", "type", "pcode_op", F.try_element_at("line_idx", F.lit(1)).alias("line"))
    text = tokens.join(first.select("collection", "function_id", "line").distinct(), ["collection", "function_id", "line"], "left_semi")
    text = text.groupBy("collection", "function_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]), "").alias("line_text"))
    return features.join(first, ["collection", "hash"], "left").join(text, ["collection", "function_id", "line"], "left").withColumn("line_text", F.coalesce(F.nullif(F.trim("line_text"), F.lit("")), "pcode_op"))


def feature_details(vec: DataFrame, contexts: DataFrame, occurrences: DataFrame, hash_: str, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A page of one feature's functions, by function id: context, tf, and both totals. Fields
    that a context lacks come from the function's other occurrences of the feature."""
    own = vec.where(F.col("hash") == hash_)
    totals = own.agg(F.count("*").alias("occurrence_count"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_occurrences"))
    rows = page(own, [F.col("function_id")], offset, limit)
    fill = occurrences.where(F.col("hash") == hash_).groupBy("collection", "function_id").agg(*(F.min(c).alias(f"any_{c}") for c in ("pcode_op_full", "seq")))
    ctx = contexts.where(F.col("hash") == hash_).select("collection", "function_id", "type", "pcode_op", "pcode_op_full", "seq", "line_idx")
    out = rows.join(ctx, ["collection", "function_id"], "left").join(fill, ["collection", "function_id"], "left")
    out = out.withColumns({c: F.coalesce(c, f"any_{c}") for c in ("pcode_op_full", "seq")}).drop("any_pcode_op_full", "any_seq")
    return out.crossJoin(F.broadcast(totals))  # one row
