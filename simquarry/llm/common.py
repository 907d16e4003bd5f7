"""Shared helpers: scratch tables in the cluster's shared folder, column hygiene, and
vectorised word hashing over Arrow string buffers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.scratch import drop as drop_path
from ..sources.scratch import freed
from ..sources.scratch import qualified as qualified
from ..sources.scratch import scratch as scratch_path
from ..sources.scratch import written as materialise  # noqa: F401  (for the operators)

# ---------------------------------------------------------------- scratch


class Scratch:
    """Tables that an operator needs until its result is written; `clear` deletes them. The shuffle
    files of a table go as soon as it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "scratch")
        self.paths: dict[str, list[str]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(path)
        with freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, which nothing reads any more."""
        for name in names:
            for path in self.paths.pop(name, []):
                drop_path(self.spark, path)

    def clear(self) -> None:
        drop_path(self.spark, self.folder)
        self.paths.clear()


#: Bytes of an Arrow batch in small_batches; Spark's own bound is 64 MB.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, which a task's JVM and Python
    each hold several times; results don't depend on it. It is read when a plan runs, so it
    stays set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf._jconf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def own_text(df: DataFrame) -> int | None:
    """Where `df` has its `text`, if that is a string and needs no cast."""
    at = [i for i, f in enumerate(df.schema.fields) if f.name.lower() == "text"]
    return at[0] if len(at) == 1 and df.schema.fields[at[0]].dataType == StringType() else None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that clash (in any case) with the names an operator adds."""
    lost = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in lost]
    return df if len(keep) == len(df.columns) else df.select(*(F.col(f"`{c}`") for c in keep))


def row_keys(df: DataFrame, *names: str) -> DataFrame:
    """`df` with two 64-bit hashes of the whole row (nulls told from absent values) under `names`."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    value = lambda c: F.to_json(F.col(f"`{c}`")) if kinds[c] in ("map", "variant") else F.col(f"`{c}`")
    whole = [*(value(c) for c in df.columns), *(F.col(f"`{c}`").isNull() for c in df.columns)]
    return df.withColumns({n: F.xxhash64(F.lit(i), *whole) for i, n in enumerate(names, 1)})


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# ---------------------------------------------------------------- bytes and words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text that are hashed at a time; bounds a worker's memory.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges (a, b) whose bytes stay near `limit`; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_KEYS = mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span raw[start:end] of bytes; `lane` (0 or 1) picks one of two
    independent ones.

    A span is read in blocks of 8 bytes. Each block goes through a keyed bijective mix, is shifted
    by a mix of its place and mixed again, so the sum over the blocks isn't linear in the bytes: no
    choice of letters, such as a word and its complement, makes two words alike by construction."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    one, two = _KEYS[2 * lane], _KEYS[2 * lane + 1]
    step = 1 << 17
    for a in range(0, len(start), step):
        s, n = start[a : a + step], end[a : a + step] - start[a : a + step]
        low, high = int(s[0]), int(s[-1] + n[-1])
        buffer = np.zeros(high - low + 8, np.uint8)
        buffer[: high - low] = raw[low:high]
        view = np.ndarray((high - low + 1,), "<u8", buffer, strides=(1,))
        s = s - low
        h = mix64((view[s] & _HEADS[np.minimum(n, 8)]) ^ one) + n.astype(np.uint64) * _KEYS[3]
        long = np.flatnonzero(n > 8)
        if len(long):
            blocks = (n[long] + 7 >> 3) - 1
            first = np.cumsum(blocks) - blocks
            k = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
            at = np.repeat(s[long], blocks) + 8 * k
            left = np.minimum(np.repeat(s[long] + n[long], blocks) - at, 8)
            mixed = mix64(mix64((view[at] & _HEADS[left]) ^ two) + mix64(k.astype(np.uint64)))
            h[long] += np.add.reduceat(mixed, first)
        out[a : a + step] = mix64(h ^ two)
    return out


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, lane: int = 0):
    """(hash, row, start, end) of each word of the rows in `raw`, words being runs of bytes
    that aren't in `gap` (by default white space, 0x20 and 0x09-0x0D).

    A-Z are lowered for the hash. A word's hash depends on its bytes alone, so the same word
    hashes alike in every row, batch and task. Beside the result a few times CHUNK bytes are
    held, however long a text is."""
    n = len(raw)
    starts, ends = [], []
    for a in range(0, n, CHUNK):
        b = min(a + CHUNK, n)
        # One byte more at either side; a row's edge ends a word as well.
        solid = np.zeros(b - a + 2, bool)
        low = max(a - 1, 0)
        solid[low - a + 1 : b - a + 1 + (b < n)] = ~gap[raw[low : b + (b < n)]]
        edge = np.zeros(b - a + 1, bool)
        i, j = np.searchsorted(offsets, (a, b + 1))
        edge[offsets[i:j] - a] = True
        own = solid[1:-1]
        starts.append(np.flatnonzero(own & (~solid[:-2] | edge[:-1])) + a)
        ends.append(np.flatnonzero(own & (~solid[2:] | edge[1:])) + a + 1)
    if not n or not (size := sum(map(len, starts))):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    start, end = np.concatenate(starts), np.concatenate(ends)
    starts.clear(), ends.clear()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    out = np.empty(size, np.uint64)
    step = max(1, int(size * CHUNK / max(1, n)))
    for a in range(0, size, step):
        b = min(a + step, size)
        part = LOWER[raw[start[a] : end[b - 1]]]
        out[a:b] = hash_spans(part, start[a:b] - start[a], end[a:b] - start[a], lane)
    return out, row, start, end


_STEP = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int):
    """(hash, row) of each k-word shingle; a row with fewer words gives its whole sequence."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            full += h[j : len(h) - k + 1 + j] * _STEP[j]
        keep = row[: len(h) - k + 1] == row[k - 1 :]
        out, rows = mix64(full[keep]), row[: len(h) - k + 1][keep]
    else:
        out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            short[has] += h[first[few[has]] + j] * _STEP[j + 8]
        short = mix64(short + count[few].astype(np.uint64))
        out, rows = np.concatenate((out, short)), np.concatenate((rows, few))
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows
