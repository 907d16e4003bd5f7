"""Pairs by blocks of functions: no pair is ever shuffled.

The vectors are dealt to blocks by function and kept as files. A task takes two blocks, joins their
features in memory and adds up whole pairs, so the disk holds the vectors alone, however many
pairs they make."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import collect_garbage, drop, scratch

#: Rows of the vectors in a group of blocks, about; matches that a worker holds at a time; rows of a result batch.
GROUP_ROWS, HELD, SENT = 1_000_000, 1 << 20, 1 << 16


class _Side:
    """The vectors of some blocks: functions by number, with names and norms, and the rows
    (key, fn, tf) whose feature can be shared, by key: a number of the side's own for each feature."""

    def __init__(self, path: str, blocks: list[int]):
        fs, root = pafs.FileSystem.from_uri(path)
        files = [f.path for b in blocks for f in fs.get_file_info(pafs.FileSelector(f"{root}/block={b}")) if f.base_name.endswith(".parquet")]
        rows = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(["collection", "function_id", "hash", "tf"]) for f in files]).combine_chunks()
        coded = [rows[c].combine_chunks().dictionary_encode() for c in ("collection", "function_id", "hash")]
        # A feature without a collection or a hash is shared by none, but counts in the norms.
        known = np.logical_and(*(coded[k].indices.is_valid().to_numpy(zero_copy_only=False) for k in (0, 2)))
        code = [c.indices.fill_null(len(c.dictionary)).to_numpy().astype(np.int64) for c in coded]
        whole, fn = np.unique(code[0] * (len(coded[1].dictionary) + 1) + code[1], return_inverse=True)
        self.n = len(whole)
        take = [c.dictionary.cast(pa.string()) for c in coded]
        take = [pa.concat_arrays([t, pa.nulls(1, pa.string())]) for t in take]
        self.collection, self.ids = take[0].take(pa.array(whole // len(take[1]))), take[1].take(pa.array(whole % len(take[1])))
        tf = rows["tf"].to_numpy()
        self.n2, self.total = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        np.add.at(self.n2, fn, tf * tf)
        np.add.at(self.total, fn, tf)
        self.words, self.hashes = (coded[k].dictionary.cast(pa.string()) for k in (0, 2))
        self._sort(code[0][known] * (len(self.hashes) + 1) + code[2][known], fn[known], tf[known])

    def _sort(self, key: np.ndarray, fn: np.ndarray, tf: np.ndarray) -> None:
        by = np.argsort(key)
        self.key, self.fn, self.tf = key[by], fn[by], tf[by]

    def known_to(self, other: _Side) -> None:
        """Keeps the rows whose feature `other` has too, under its numbers."""
        words, hashes = (pc.index_in(mine, value_set=theirs).fill_null(-1).to_numpy().astype(np.int64) for mine, theirs in ((self.words, other.words), (self.hashes, other.hashes)))
        word, hash_ = words[self.key // (len(self.hashes) + 1)], hashes[self.key % (len(self.hashes) + 1)]
        both = (word >= 0) & (hash_ >= 0)
        self._sort((word * (len(other.hashes) + 1) + hash_)[both], self.fn[both], self.tf[both])


def _sums(a: _Side, b: _Side, same: bool, dot: bool):
    """(functions of a, functions of b, sum over shared features) of parts of the pairs, each pair
    once and whole; between a side and itself only pairs of a greater and a lesser number."""
    low, up = np.searchsorted(b.key, a.key, "left"), np.searchsorted(b.key, a.key, "right")
    by = np.flatnonzero(up > low)
    by = by[np.argsort(a.fn[by], kind="stable")]
    fn, tf, low, size = a.fn[by], a.tf[by], low[by], (up - low)[by]
    first = np.flatnonzero(np.diff(fn, prepend=-1))
    ends = np.append(first[1:], len(fn))
    done = np.concatenate(([0], np.cumsum(size)))

    def matches(x: int, y: int):
        n = size[x:y]
        row = np.repeat(np.arange(x, y), n)
        at = np.arange(len(row)) - np.repeat(done[x:y] - done[x], n) + np.repeat(low[x:y], n)
        shared = tf[row] * b.tf[at] if dot else np.minimum(tf[row], b.tf[at])
        fa, fb = fn[row], b.fn[at]
        return (fa[keep], fb[keep], shared[keep]) if same and (keep := fa > fb) is not None else (fa, fb, shared)

    k = 0
    while k < len(first):
        x = first[k]
        m = max(k + 1, int(np.searchsorted(done[ends], done[x] + HELD, "right")))
        y = ends[m - 1]
        k = m
        if done[y] - done[x] <= HELD:
            fa, fb, shared = matches(x, y)
            if len(fa):
                key = fa * b.n + fb
                order = np.argsort(key)
                key = key[order]
                cut = np.flatnonzero(np.diff(key, prepend=-1))
                yield key[cut] // b.n, key[cut] % b.n, np.add.reduceat(shared[order], cut)
            continue
        # One function with many matches: they are added up by b's functions, some features at a time.
        out, met = np.zeros(b.n, np.int64), np.zeros(b.n, bool)
        while x < y:
            z = max(x + 1, min(y, int(np.searchsorted(done, done[x] + HELD, "right")) - 1))
            _, fb, shared = matches(x, z)
            np.add.at(out, fb, shared)
            met[fb] = True
            x = z
        fb = np.flatnonzero(met)
        yield np.full(len(fb), fn[y - 1]), fb, out[fb]


def _score(dot: bool, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared / (np.sqrt(a.astype(float)) * np.sqrt(b.astype(float))) if dot else shared / np.maximum(a + b - shared, 1)


def dealt(vec: DataFrame) -> tuple[str, list[tuple[int, int]]]:
    """(path, [(block, rows)]): the vectors as files by block, a function whole in one of them.

    They are written as they come first: the shuffles that made them are gone before the blocks'
    begins. Features stay as they are and are compared in memory, so neither hashes of theirs nor a
    check of these take disk."""
    spark = vec.sparkSession
    cols = vec.select("collection", "function_id", "hash", F.col("tf").cast("long").alias("tf"))
    came, path = scratch(spark, "pair-vectors"), scratch(spark, "pair-blocks")
    cols.write.option("compression", "zstd").parquet(came)
    collect_garbage(spark)
    rows = spark.read.schema("collection string, function_id string, hash string, tf long").parquet(came)
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * rows.count() / GROUP_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("collection", "function_id"), F.lit(n)).cast("int")).repartition(n, "block")
    rows.sortWithinPartitions("block", "collection", "function_id").write.option("compression", "zstd").partitionBy("block").parquet(path)
    collect_garbage(spark)
    drop(spark, came)
    kept = spark.read.schema("collection string, function_id string, hash string, tf long, block int").parquet(path)
    return path, sorted(tuple(r) for r in kept.groupBy("block").count().collect())  # a row for each block


def block_pairs(vec: DataFrame | tuple[str, list[tuple[int, int]]], dot: bool, least: float = 0.0) -> DataFrame | None:
    """collection, id1, id2, n2_a, n2_b, total_a, total_b and `dot` (else `least_sum`) of every two
    functions of a collection that share a feature, but for pairs that are clearly below the
    score `least`; id1, the greater id, is a. `vec`: the vectors, or what dealt() made of them.
    None where a block has more rows than a worker can hold."""
    spark = SparkSession.active()
    path, sizes = dealt(vec) if isinstance(vec, DataFrame) else vec
    if sizes and max(c for _, c in sizes) > 16 * GROUP_ROWS:
        return None
    goal = min(GROUP_ROWS, math.ceil(sum(c for _, c in sizes) / math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    groups: list[list[int]] = []
    held = goal
    for block, count in sizes:
        if held + count > goal:
            groups.append([])
            held = 0
        groups[-1].append(block)
        held += count
    cells = [(i, j) for i in range(len(groups)) for j in range(i + 1)]
    name = "dot" if dot else "least_sum"
    names = ["collection", "id1", "id2", "n2_a", "n2_b", "total_a", "total_b", name]

    def run(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                i, j = cells[c]
                a = _Side(path, groups[i])
                b = a
                if i != j:
                    b = _Side(path, groups[j])
                    b.known_to(a)
                ids = pa.concat_arrays([a.ids, b.ids])
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                n2, total = np.concatenate((a.n2, b.n2)), np.concatenate((a.total, b.total))
                for fa, fb, shared in _sums(a, b, i == j, dot):
                    fb = fb + a.n
                    if least > 0:
                        norm = n2 if dot else total
                        keep = _score(dot, shared, norm[fa], norm[fb]) >= least * (1 - 1e-9)
                        fa, fb, shared = fa[keep], fb[keep], shared[keep]
                    swap = rank[fa] < rank[fb]
                    one, two = np.where(swap, fb, fa), np.where(swap, fa, fb)
                    for x in range(0, len(one), SENT):
                        p, q = one[x : x + SENT], two[x : x + SENT]
                        yield pa.RecordBatch.from_arrays(
                            [a.collection.take(pa.array(fa[x : x + SENT])), ids.take(pa.array(p)), ids.take(pa.array(q)), *(pa.array(v) for v in (n2[p], n2[q], total[p], total[q], shared[x : x + SENT]))], names)

    schema = "collection string, id1 string, id2 string, n2_a long, n2_b long, total_a long, total_b long, " + name + " long"
    return spark.range(0, len(cells), 1, max(1, min(len(cells), 4000))).mapInArrow(run, schema)
