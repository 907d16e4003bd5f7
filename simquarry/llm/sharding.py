"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their stratum (source); row r of n gets
the fractional rank (2r - 1) / 2n; the rows are sorted by that rank and cut into equal runs.
Every run then holds each stratum in its share of the whole.

No stratum is ranked in one task: ranks are a bucket's offset (prefix sums over counts per
hash bucket) plus a row number inside the bucket, and the sort is cut into rank buckets whose
sizes follow from the strata's counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, without

HASH_BITS = 60


def shuffle_hash(key: Column, seed: int) -> Column:
    """60 bits of md5("seed:key"), as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def interleave_shards(df: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """`df` with `shard` (int, 0 to n_shards - 1) and `slot` (long, gapless from 0 in a shard).

    Shard row counts differ by one at most. The assignment depends on the rows alone, not on
    partitioning. Null strata form a stratum of their own; a null key hashes as the empty
    string; rows that share a key are ordered by a hash of the whole row, and identical rows
    are interchangeable. Input columns named shard or slot are replaced. An empty input gives
    an empty output; fewer rows than shards leave some shards empty.
    """
    spark = df.sparkSession
    # Buckets follow the configured width of a shuffle; the result does not depend on them.
    bits = max(4, min(24, (8 * partitions(spark) - 1).bit_length()))
    ranks = 1 << bits
    df = without(df, "shard", "slot")
    base = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("r"),
        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("s"),
        F.col(f"`{stratum}`").isNull().alias("z"),
        shuffle_hash(F.col(f"`{key}`"), seed).alias("h"),
        F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("t"),
    ).withColumn("b", F.shiftright("h", HASH_BITS - bits))
    runs = base.groupBy("s", "z", "b").agg(F.count("*").alias("c"))
    by_hash = Window.partitionBy("s", "z").orderBy("b")
    runs = runs.select(
        "s", "z", "b",
        (F.sum("c").over(by_hash) - F.col("c")).alias("o"),
        F.sum("c").over(Window.partitionBy("s", "z")).alias("n"),
    )
    inside = Window.partitionBy("s", "z", "b").orderBy("h", "t")
    ranked = base.withColumn("i", F.row_number().over(inside)).join(runs, ["s", "z", "b"])
    twice = 2 * (F.col("o") + F.col("i")) - 1
    ranked = ranked.select("r", "s", "z", "h", "t", (twice / (2 * F.col("n"))).alias("f"), F.expr(f"((2 * (o + i) - 1) * {ranks}L) div (2 * n)").alias("k"))
    # Rows before rank bucket k: a stratum of n rows has floor(ceil(2nk / ranks) / 2) of them.
    sizes = base.groupBy("s", "z").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m"))
    starts = (
        sizes.select("n", "m", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("k"))
        .groupBy("k")
        .agg(F.expr(f"sum(m * (((2 * n * k + {ranks - 1}L) div {ranks}L) div 2))").alias("start"), F.sum(F.col("m") * F.col("n")).alias("total"))
        .select(F.col("k").cast("long").alias("k"), "start", "total")
    )
    order = Window.partitionBy("k").orderBy("f", "z", "s", "h", "t")
    placed = ranked.withColumn("p", F.row_number().over(order)).join(starts, "k").withColumn("p", F.col("start") + F.col("p") - 1)
    placed = placed.withColumn("shard", F.expr(f"(p * {n_shards}L) div total"))
    return placed.select("r.*", F.col("shard").cast("int").alias("shard"), F.expr(f"p - ((shard * total + {n_shards - 1}L) div {n_shards}L)").alias("slot"))
