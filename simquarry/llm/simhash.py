"""SimHash fingerprints and a Hamming-radius search over permuted block tables.

A text's terms are its five-word shingles (fewer words: the whole sequence). Each occurrence
of a term votes with an integer weight, the bit length of its bytes, on every bit of the
term's 64-bit hash: plus where the bit is 1, minus where it is 0. A fingerprint bit is 1 where
the votes are positive. Word hashes come from bytes alone with A-Z lowered, so equal texts
have equal fingerprints; a text without words has fingerprint 0.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, partitions, shingles, text_buffer, text_or_empty, words

BITS = 64
TERM_WORDS = 5
#: Terms whose votes are spread out at a time (64 small integers each).
SLICE = 1 << 15
#: Keys sampled for each range of a table.
SAMPLE = 200


def simhash(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A uint64 fingerprint for each text."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in chunks(offsets, 1 << 19):
        part = raw[offsets[a] : offsets[b]]
        h, row, start, end = words(part, offsets[a : b + 1] - offsets[a])
        if not len(h):
            continue
        n = b - a
        term, where = shingles(h, row, n, TERM_WORDS)
        # A term reaches from its first word to its last.
        count = np.bincount(row, minlength=n)
        first = np.concatenate(([0], np.cumsum(count)))
        terms = np.bincount(where, minlength=n)
        begin = np.concatenate(([0], np.cumsum(terms)))
        k = np.arange(len(term)) - begin[where]
        i = first[where] + k
        last = np.minimum(i + TERM_WORDS, first[where + 1]) - 1
        weight = np.frexp((end[last] - start[i]).astype(float))[1].astype(np.int16)
        votes = np.zeros((n, BITS), np.int64)
        for x in range(0, len(term), SLICE):
            part_of = where[x : x + SLICE]
            signs = np.unpackbits(term[x : x + SLICE, None].view(np.uint8), axis=1, bitorder="little").astype(np.int16)
            signs += signs
            signs -= 1
            signs *= weight[x : x + SLICE, None]
            cut = np.flatnonzero(np.diff(part_of, prepend=-1))
            votes[part_of[cut]] += np.add.reduceat(signs, cut, axis=0, dtype=np.int64)
        bits = np.packbits(votes > 0, axis=1, bitorder="little")
        out[a:b] = bits.view(np.uint64)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - Hamming distance / bits."""
    return 1.0 - np.bitwise_count(a ^ b).astype(float) / BITS


def _hash_texts(texts: list[str]) -> np.ndarray:
    return simhash(*text_buffer(pa.array(texts, pa.large_string())))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `fingerprint` (long, the 64 bits); null texts count as empty. A column of that
    name in the input is replaced."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(_hash_texts(text.tolist()).view(np.int64))

    return docs.withColumn("fingerprint", fp(text_or_empty(f"`{text_col}`")))


# ---------------------------------------------------------------- edited texts


def edit(text: str, following: str) -> str:
    """`text` with its last floor(n/2) code points replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents go in ascending doc_id order (null first, equal ids by a hash of the text, then by the
    text); the one after the last is the first. One range shuffle brings each text to its
    neighbours: a range's first document also goes to the range before it. Ranges are cut by id and
    hash, so one id, or null, that many rows share is cut as well; only equal rows stay together.
    Null texts count as empty; one document alone is its own next; an empty table gives an empty
    result."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    n = max(2, partitions(spark))
    # The ranges' first rows come from a bounded sample of keys, which only shapes the ranges.
    key = F.struct(F.col("doc_id").isNotNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h")
    whole = rows.agg(F.count("*").alias("n"), F.min(key).alias("least")).first()
    drawn = rows.where(F.rand(17) < min(1.0, SAMPLE * n / max(1, whole["n"]))).select(key.alias("k")).select("k.*").collect()
    least = whole["least"]
    kind = np.dtype([("z", "?"), ("i", "<i8"), ("h", "<i8")])
    drawn = np.sort(np.array([tuple(r) for r in drawn], kind))
    start = np.unique(drawn[[len(drawn) * i // n for i in range(1, n)]]) if len(drawn) else drawn
    first = np.array([tuple(least)] if least else [], kind)
    start = start[start != first] if len(first) else start
    ranges = len(start) + 1

    def deal(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            key = np.empty(len(ids), kind)
            key["z"], key["i"], key["h"] = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.asarray(batch.column(2))
            place = np.searchsorted(start, key, side="right")
            opens = key == first if len(first) else np.zeros(len(key), bool)
            opens[place > 0] |= start[place[place > 0] - 1] == key[place > 0]
            more = np.flatnonzero(opens)
            take = pa.array(np.concatenate((np.arange(len(ids)), more)))
            to = np.concatenate((place, (place[more] - 1) % ranges)).astype(np.int32)
            extra = np.zeros(len(to), bool)
            extra[len(ids) :] = True
            # Long texts: a few MB a batch.
            size = np.concatenate(([0], np.cumsum(pc.binary_length(texts.take(take)).to_numpy())))
            for a, b in chunks(size, 4 << 20):
                part = take[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(to[a:b]), pa.array(extra[a:b]), ids.take(part), texts.take(part).cast(pa.string()), batch.column(2).take(part)], ["place", "extra", "doc_id", "text", "h"])

    def scan(batches):
        held: list[tuple] = []  # the last row, which waits for the next text
        done = False

        def batch_of(rows, nexts):
            texts, edited = [r[1] for r in rows], [edit(r[1], x) for r, x in zip(rows, nexts, strict=True)]
            own, other = _hash_texts([*texts, nexts[-1]]), _hash_texts(edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                    pa.array([f"{x:016x}" for x in own[:-1].tolist()], pa.string()), pa.array([f"{x:016x}" for x in other.tolist()], pa.string()),
                    pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            if done:
                continue
            extra = batch.column(1).to_pylist()
            ids, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, x in enumerate(extra):
                held.append((ids[i], texts[i]))
                if x:
                    done = True
                    break
            if len(held) > 1:
                sizes = np.concatenate(([0], np.cumsum([len(t) for _, t in held])))
                for a, b in chunks(sizes[:-1], CHARS):
                    yield batch_of(held[a:b], [t for _, t in held[a + 1 : b + 1]])
                held = held[-1:]

    CHARS = 2 << 20
    dealt = rows.mapInArrow(deal, "place int, extra boolean, doc_id long, text string, h long")
    sorted_ = dealt.repartitionById(ranges, F.col("place")).sortWithinPartitions("extra", "doc_id", "h", "text")
    return sorted_.mapInArrow(scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


# ---------------------------------------------------------------- search


def table_blocks(n: int, radius: int) -> int:
    """Blocks whose tables have keys of 4 bits more than n fingerprints need to be told apart, so
    that chance matches of a query stay few however many fingerprints there are."""
    blocks = radius + 1
    while blocks < BITS and BITS * (blocks - radius) // blocks < n.bit_length() + 4:
        blocks += 1
    return blocks


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(query, fingerprint, distance) for every distinct fingerprint (long column
    `fingerprint`) of `fps` within `radius` bits of a distinct one of `queries`; exact.

    The 64 bits are cut into `blocks` blocks (by default as many as the number of fingerprints
    asks for); at most `radius` of them can differ, so two fingerprints within the radius agree on
    some `blocks - radius` of them. Each such choice of blocks is a table, keyed by the chosen
    blocks; a match in any table is then measured."""
    if blocks is None:
        blocks = table_blocks(fps.count(), radius)
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = 0
        for c in chosen:
            m |= (1 << edges[c + 1]) - (1 << edges[c])
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    tables = F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("table", "mask")
    key = F.col("fp").bitwiseAND(F.col("mask"))
    side = lambda df, name: df.select(F.col("fingerprint").alias("fp")).where("fp is not null").distinct().select("fp", tables).select(F.col("fp").alias(name), "table", key.alias("key"))
    hits = side(fps, "fingerprint").join(side(queries, "query"), ["table", "key"])
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("query")))
    return hits.withColumn("distance", distance.cast("int")).where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()
