"""Tags: add, remove, metadata and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import strip, without_meta
from ..functions.values import DEFAULT_COLOUR, DEFAULT_PRIORITY, append_once, colour
from .similarity import upsert


def _hit(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    wanted = ids.select(without_meta(F.col("id")).alias("__id"), strip(F.col("tag")).alias("__tag")).where("__tag <> ''").distinct()
    wanted = wanted.groupBy("__id").agg(F.array_sort(F.collect_set("__tag")).alias("__tags"))
    return df.join(wanted, F.col(id_col) == F.col("__id"), "left").drop("__id")


def add_tags(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """`df` with the (id, tag) rows appended to user_tags where they aren't there yet."""
    rows = _hit(df, ids, id_col)
    have = F.coalesce("user_tags", F.array().cast("array<string>"))
    added = F.aggregate(F.coalesce("__tags", F.array().cast("array<string>")), have, lambda acc, t: append_once(acc, t))
    return rows.withColumn("user_tags", F.when(F.col("__tags").isNull(), F.col("user_tags")).otherwise(added)).drop("__tags")


def remove_tags(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    rows = _hit(df, ids, id_col)
    return rows.withColumn("user_tags", F.when(F.col("__tags").isNull() | F.col("user_tags").isNull(), F.col("user_tags")).otherwise(F.filter("user_tags", lambda t: ~F.array_contains(F.col("__tags"), t)))).drop("__tags")


def register(metadata: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag metadata with a row for each new tag of `tags` (collection, tag); known tags keep
    theirs, and tags that are no longer used stay."""
    new = tags.select("collection", "tag").distinct().join(metadata, ["collection", "tag"], "left_anti")
    return metadata.unionByName(new.select("collection", "tag", colour(F.col("tag")).alias("color"), F.lit(DEFAULT_PRIORITY).cast("long").alias("priority")))


def set_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """Upserts (collection, tag, color, priority); a null in a change keeps the old value or
    takes the default."""
    old = metadata.select("collection", "tag", F.col("color").alias("__c"), F.col("priority").alias("__p"))
    full = changes.join(old, ["collection", "tag"], "left").select("collection", "tag", F.coalesce("color", "__c", F.lit(DEFAULT_COLOUR)).alias("color"), F.coalesce("priority", "__p", F.lit(DEFAULT_PRIORITY)).cast("long").alias("priority"))
    return upsert(metadata, full, ["collection", "tag"])


def tag_counts(metadata: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Uses of each tag in tags and user_tags of the tables, without case: tags that differ in
    case only share a count; unused ones have 0."""
    used = None
    for df in tables.values():
        for col in ("tags", "user_tags"):
            if col in df.columns:
                rows = df.select("collection", F.explode(F.array_distinct(F.transform(col, F.lower))).alias("low"))
                used = rows if used is None else used.unionByName(rows)
    counts = used.groupBy("collection", "low").agg(F.count("*").alias("n"))
    out = metadata.join(counts, (metadata["collection"] == counts["collection"]) & (F.lower(metadata["tag"]) == counts["low"]), "left")
    return out.select(metadata["collection"], "tag", "color", "priority", F.coalesce("n", F.lit(0)).alias("count"))
