"""Status and storage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio


def progress(functions: DataFrame, done: DataFrame, by: list[str], word: str = "built") -> DataFrame:
    """total, done, open and percent per group; `done` has (collection, function_id). With
    by=["collection"], the collection's status; with batch_uuid or file_md5, the lists."""
    marked = functions.join(done.select("collection", "function_id", F.lit(1).alias("__d")).distinct(), ["collection", "function_id"], "left")
    n, d = F.count("*"), F.count("__d")
    out = marked.groupBy(*by).agg(n.alias("total"), d.alias(word), F.greatest(F.lit(0), n - d).alias(f"un{word}"))
    return out.withColumn("ratio", ratio(F.col(word), F.col("total"))).orderBy(*by)


def pair_counts(sims: DataFrame, algos: tuple[str, ...] = ("unweighted_cosine", "jaccard")) -> DataFrame:
    """One row per collection: the number of pairs of each algorithm, as sims_<algo>."""
    return sims.groupBy("collection").agg(*(F.count_if(F.col("algo") == a).alias(f"sims_{a}") for a in algos))


def index_summary(files: DataFrame, functions: DataFrame, indexed: DataFrame, vec: DataFrame, sims: DataFrame) -> DataFrame:
    """One row per collection: files, functions, indexed, missing, features, pairs, percent."""
    count = lambda df, name, col="*": df.groupBy("collection").agg((F.count("*") if col == "*" else F.countDistinct(col)).alias(name))
    out = count(files, "num_files")
    for df in (count(functions, "num_functions"), count(indexed, "num_indexed"), count(vec, "num_features", "hash"), count(sims, "num_sim_meta")):
        out = out.join(df, "collection", "left")
    out = out.fillna(0)
    return out.withColumns({"num_missing": F.greatest(F.lit(0), F.col("num_functions") - F.col("num_indexed")), "indexing_ratio": ratio(F.col("num_indexed"), F.col("num_functions"))})


def storage(tables: dict[str, DataFrame]) -> DataFrame:
    """count, avg_size and total_size in JSON bytes of each table's rows."""
    out = None
    for name, df in tables.items():
        size = F.octet_length(F.to_json(F.struct(*df.columns)))
        row = df.agg(F.count("*").alias("count"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_size"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size")).withColumn("component", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def postings(df: DataFrame, level: str, fields: list[str], id_col: str, lists: tuple[str, ...] = ("tags", "user_tags")) -> DataFrame:
    """(level, field, value, doc_id): the exact-match index; null and empty values aren't in."""
    out = None
    for f in fields:
        value = F.explode(f) if f in lists else F.col(f).cast("string")
        rows = df.select(F.lit(level).alias("level"), F.lit(f).alias("field"), value.alias("value"), F.col(id_col).alias("doc_id"))
        rows = rows.where("value is not null and value <> ''").withColumn("value", F.lower("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def registry(posted: DataFrame) -> DataFrame:
    """Per level and field: distinct values, postings per value, and the value with the most."""
    each = posted.groupBy("level", "field", "value").agg(F.count("*").alias("n"))
    return each.groupBy("level", "field").agg(F.count("*").alias("buckets"), F.sum("n").alias("postings"), (F.sum("n") / F.count("*")).alias("avg_postings"), F.max_by("value", F.struct("n", "value")).alias("example"))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """`n` rows by a hash of their key, the same for the same keys and seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
