"""Mixing sources to target weights with the cube method.

Each row may enter 0, 1 or 2 times. A source's target over its size is the expected
number of copies of each of its documents: the whole part is granted, the fraction is an
inclusion probability. The cube method's flight phase moves these fractions along directions
in the null space of two constraints (document total and token total), so both totals stay
exact while fractions become 0 or 1; at most two documents of a block stay undecided, besides a
few that are held back for the landing. Undecided documents meet again in fewer blocks until each
source has one; its last dozen is landed by the rounding nearest to the token total.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, row_keys

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a flight block.
BLOCK = 1024
#: Documents of a block that skip the flight, so that the landing has sizes to choose from.
RESERVE = 10
#: Sources whose plan is broadcast; with more the same join shuffles.
BROADCAST_SOURCES = 100_000
WEIGHTS = (5.0, 2.0, 1.0)
_EPS = 1e-9
KEYS = ("__mix1", "__mix2")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`sources` (source, size, n) with `target`: `share` of all sizes, split by the weights
    (repeating over the sources by code point, null last); what passes `cap` times a source's
    size is reshared by weight until none is above.

    The targets are least(cap * size, level * weight) with one level for all, which rises from
    round to round as more sources stop at their cap; the driver sees only sums. Sources are
    numbered by their place in a range of sorted ones, so there may be any number of them."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    sources = materialise(sources, "mix-sources")
    # A range for each 10,000 sources, so that few sources make one small file.
    ranges = max(1, min(partitions(spark), sources.count() // 10_000))
    spread = materialise(sources.repartitionByRange(ranges, *order).withColumn("place", F.spark_partition_id()), "mix-ranges")
    counts = sorted((r["place"], r["count"]) for r in spread.groupBy("place").count().collect())  # one row a range
    starts, before = [], 0
    for place, n in counts:
        starts.append((place, before))
        before += n
    starts = spark.createDataFrame(starts, "place int, before long")
    inside = F.row_number().over(Window.partitionBy("place").orderBy(*order))
    number = F.col("before") + inside - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    # `starts` has a row for each shuffle partition.
    table = spread.join(F.broadcast(starts), "place").withColumn("weight", weight)
    whole = table.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total, level, stopped = share * (whole["size"] or 0), 0.0, -1
    while whole["weight"]:
        over = F.lit(level) * F.col("weight") > cap * F.col("size")
        got = table.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if got["n"] == stopped:
            break
        stopped, level = got["n"], (total - cap * got["size"]) / got["weight"] if got["weight"] else math.inf
    return table.select("source", "size", "n", F.least(cap * F.col("size"), F.lit(level) * F.col("weight")).cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The flight phase over one block: `p` with all but at most two entries at 0 or 1; the
    sums of p and of p * size are those given. `u` are uniform draws, one per unit."""
    p = p.astype(float).copy()
    ps, zs, us = p.tolist(), size.astype(float).tolist(), u.tolist()
    live: list[int] = []
    for i in range(len(ps)):
        if not _EPS < ps[i] < 1 - _EPS:
            ps[i] = float(round(ps[i]))
            continue
        live.append(i)
        while len(live) >= 2:
            if len(live) == 2:
                a, b = live
                if zs[a] != zs[b]:
                    break
                way = (1.0, -1.0)
            else:
                a, b, c = live
                way = (zs[c] - zs[b], zs[a] - zs[c], zs[b] - zs[a])
                top = max(abs(x) for x in way)
                way = tuple(x / top for x in way) if top else (1.0, -1.0, 0.0)
            up = down = math.inf
            for j, d in zip(live, way, strict=True):
                if d > 0:
                    up, down = min(up, (1 - ps[j]) / d), min(down, ps[j] / d)
                elif d < 0:
                    up, down = min(up, -ps[j] / d), min(down, (ps[j] - 1) / d)
            step = up if us[live[-1]] * (up + down) < down else -down
            for j, d in zip(live, way, strict=True):
                ps[j] += step * d
                if ps[j] < _EPS:
                    ps[j] = 0.0
                elif ps[j] > 1 - _EPS:
                    ps[j] = 1.0
            live = [j for j in live if 0.0 < ps[j] < 1.0]
    return np.asarray(ps)


def reserve(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks up to RESERVE undecided units that skip the flight and wait for the landing: those
    whose sizes are nearest to a half, a quarter, an eighth ... of the largest."""
    out = np.zeros(len(p), bool)
    free = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS) & (size > 0))]
    aim = float(size[free].max()) if free else 0.0
    for _ in range(min(RESERVE, len(free) // 3)):
        aim /= 2
        i = min(free, key=lambda j: (abs(size[j] - aim), j))
        out[i] = True
        free.remove(i)
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing: of all roundings of the (at most RESERVE + 2) undecided entries, the one
    whose token total is nearest to the expected one; documents weigh as a few words each."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
        off = picks - p[open_]
        cost = np.abs(off @ size[open_]) + 0.02 * size.mean() * np.abs(off.sum(axis=1))
        p[open_] = picks[int(np.argmin(cost))]
    return p


def _fly(last: bool):
    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", *KEYS, "copy"], kind="stable")
        draw = (frame["h"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        size, p = frame["size"].to_numpy(), frame["p"].to_numpy().astype(float)
        fly = ~reserve(p, size)
        p[fly] = flight(p[fly], size[fly], draw[fly])
        return frame.assign(p=land(p, size) if last else p)

    return block


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights=WEIGHTS, seed: int = 11) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, size, source_size, target, copies, taken
    (= copies * size), and the two hashes of the whole row that apply_mix joins by.

    Size is the number of words of the whole text (null: 0). Sources sort by code point, null
    last, and weigh `weights`, repeating; there may be any number of them. Rows that share an id,
    or have none, are units of their own; equal rows are interchangeable. A document without words
    is taken 0 words. The same rows give the same mix under any partitioning. An empty input gives
    an empty mix; a source without words has target 0.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    units = row_keys(docs, *KEYS).select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), *KEYS)
    units = materialise(units.groupBy(*units.columns).agg(F.count("*").alias("rows")), "mix-units")
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("n"))
    plan = source_targets(found, weights, share, cap)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    whole = F.least(F.lit(cap), F.floor(rate + _EPS).cast("int"))
    plan = plan.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", whole.alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("p"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    plan = materialise(plan, "mix-plan")
    size = plan.agg(F.count("*").alias("n"), F.coalesce(F.max("blocks"), F.lit(1)).alias("width")).first()
    side = F.broadcast(plan) if size["n"] <= BROADCAST_SOURCES else plan  # its size has just been counted
    each = units.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")
    joined = each.join(side, each["source"].eqNullSafe(plan["of"])).drop("of").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", *KEYS, "copy"))
    level = joined.withColumn("block", F.pmod(F.shiftright("h", 16), F.col("blocks"))).drop("blocks")
    decided, width = [], size["width"]
    while True:
        last = width <= 1
        level = level.groupBy("source", "block").applyInPandas(_fly(last), level.schema)
        if last:
            decided.append(level)
            break
        level = materialise(level, "mix-flight")
        decided.append(level.where("p <= 0 or p >= 1"))
        # A block leaves RESERVE + 2 undecided documents at most: so many fewer blocks are next.
        width = math.ceil((RESERVE + 2) * width / BLOCK)
        level = level.where("p > 0 and p < 1").withColumn("block", F.pmod(F.shiftright("h", 8), F.lit(width).cast("long")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *KEYS)


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; equal rows together as often as it
    takes all of them."""
    taken = mixed.groupBy(*KEYS).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows"))
    taken = materialise(taken.where("__copies > 0"), "mix-taken")
    rows = row_keys(docs, *KEYS)
    again = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    out = rows.join(taken.where("__rows = 1"), [*KEYS]).select(*(F.col(f"`{c}`") for c in docs.columns), again)
    many = taken.where("__rows > 1")
    if not many.isEmpty():  # of equal rows, one stands for all
        one = rows.join(many, [*KEYS], "left_semi").dropDuplicates([*KEYS])
        out = out.unionByName(one.join(many, [*KEYS]).select(*(F.col(f"`{c}`") for c in docs.columns), again))
    return out.drop("__copy")
