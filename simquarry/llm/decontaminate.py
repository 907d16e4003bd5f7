"""Benchmark decontamination with BM25 and block-max WAND.

The test items are the indexed documents. Every training passage, a window of a document's
words that slides by half its length, is a query. A score is the share of an item's own BM25
weight that the passage's words cover, so one threshold fits short and long items. For each
passage all items at or above the threshold are retrieved; none are cut off by rank:

* words that are so common among the items that they can never reach the threshold on their own
  are non-essential; a passage without an essential word has no hit;
* of the other passages, those whose block-max bounds (per block of items, the sum over the
  passage's words of the block's largest weight) stay below the threshold have none either; the
  bounds are sums over the two half passages first, then over the distinct words;
* for the rest, the posting lists skip to the blocks whose bound reaches the threshold, and only
  their items are scored.

The bounds never fall below a score, so the retrieval is exact.

Items are indexed by length class, each with passages of its own length (a half passage is the
least HALF * 2^k words that an item fits in), so one item never widens another's passages. A class
of many items is cut into several indexes; document frequencies, the number of items and their
mean length are counted over all items before, so the cut doesn't change a score. Indexes are
built by tasks and kept as files in the shared folder; a task that reads documents holds a few of
them at a time, and the driver only their names.

A hit counts as a leak where the passage holds the item's question and its answer: word trigrams
of either part must recur in it. An item's answer is its last sentence or, in an item of one
sentence, the last third of its words.

Retrieval and verification cut words alike: runs of letters, digits and combining marks of any
script, in lower case; every other character (no-break spaces, dashes, quotes, underscores) parts
words, but zero-width and soft-hyphen characters are dropped. Each Han or kana character is a word.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, own_text, scratch_path, text_buffer, words

THRESHOLD = 0.6
QUESTION, ANSWER, WHOLE = 0.6, 0.5, 0.75
K1, BB = 1.2, 0.75
#: Items of a block, and words of a half passage, at least.
BLOCK, HALF = 4, 32
#: Bytes of items that one index may hold, and indexes that a worker holds at a time.
INDEX_BYTES, HELD = 4 << 20, 4
#: Entries of an index's table of block maxima, and of the tables that a search fills.
TABLE, DENSE = 1 << 22, 1 << 25
#: Half passages that are bounded at a time.
STEP = 8192
#: Bytes that part words: ASCII but for letters and digits. Other marks become spaces before.
GAPS = np.ones(256, dtype=bool)
GAPS[0x80:] = False
GAPS[[*range(48, 58), *range(97, 123), *range(65, 91)]] = False
_TO_SPACE = bytes(32 if GAPS[b] else b for b in range(256))
_JOINERS = r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
_MARKS = r"[^\p{L}\p{N}\p{M}\x00-\x7f]+"
_SINGLE = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-case texts in which only GAPS part words; nulls stay null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    out = pc.utf8_lower(texts.cast(pa.large_string()))
    raw, _ = text_buffer(out)
    if len(raw) and raw.max() >= 0x80:
        out = pc.replace_substring_regex(out, _JOINERS, "")
        out = pc.replace_substring_regex(out, _MARKS, " ")
        out = pc.replace_substring_regex(out, _SINGLE, r" \0 ")
    return out


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_SPACE).split()


def tokens(text: str) -> list[bytes]:
    return split_words(normalised(pa.array([text], pa.large_string()))[0].as_py().encode())


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words in its question and its answer: the last sentence is the answer; of a
    single sentence, the last third of the words."""
    parts = [w for s in _SENTENCE.split(text) if (w := tokens(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    cut = len(whole) - len(whole) // 3
    return whole[:cut], whole[cut:]


def grams(w: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    """The word n-grams; of fewer words, the whole sequence."""
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def half_of(n_words: int) -> int:
    """The half passage of an item's length class."""
    half = HALF
    while half < n_words:
        half *= 2
    return half


def hashed_words(texts: pa.Array):
    """(raw, hashes, rows, starts, ends) of the normalised texts' words."""
    raw, offsets = text_buffer(normalised(texts))
    return (raw, *words(raw, offsets, GAPS))


class Index:
    """The BM25 inverted index of test items, with largest weights per term and block.

    `items`: (item id, text, {word hash: times}); `df`: in how many of all items each word is;
    `n_items` and `mean`: the number of all items and their mean length in words."""

    def __init__(self, items: list[tuple], df: dict[int, int], n_items: int, mean: float, half: int, threshold: float = THRESHOLD):
        items = sorted(items, key=lambda x: (sum(x[2].values()), x[0] is not None, x[0] or 0, x[1]))
        self.threshold, self.half, self.ids, self.n = threshold, half, [i[0] for i in items], len(items)
        self.parts = [(*map(grams, question_answer(t)), grams(tokens(t))) for _, t, _ in items]
        self.vocab = np.unique(np.array([h for _, _, tf in items for h in tf], np.uint64))
        seen = np.array([df[h] for h in self.vocab.tolist()], float)
        idf = np.log(1 + (n_items - seen + 0.5) / (seen + 0.5))
        term, item, weight = [], [], []
        for k, (_, _, tf) in enumerate(items):
            u, times = np.array(sorted(tf), np.uint64), np.array([tf[h] for h in sorted(tf)], float)
            t = np.searchsorted(self.vocab, u)
            w = idf[t] * times * (K1 + 1) / (times + K1 * (1 - BB + BB * times.sum() / mean))
            term.append(t)
            item.append(np.full(len(t), k))
            weight.append(w / w.sum())
        self.term, self.item, self.weight = (np.concatenate(x) for x in (term, item, weight))
        by = np.lexsort((self.item, self.term))
        self.term, self.item, self.weight = self.term[by], self.item[by], self.weight[by]
        self.post = np.searchsorted(self.term, np.arange(len(self.vocab) + 1))
        # Non-essential terms: the most common ones, while no item gets the threshold from them.
        covered, self.essential = np.zeros(self.n), np.ones(len(self.vocab), bool)
        for t in np.argsort(-seen, kind="stable"):
            a, b = self.post[t], self.post[t + 1]
            covered[self.item[a:b]] += self.weight[a:b]
            if covered[self.item[a:b]].max() >= threshold * 0.999:
                break
            self.essential[t] = False
        # Dense block maxima, in blocks large enough to keep the table bounded.
        self.block = max(BLOCK, math.ceil(len(self.vocab) * self.n / TABLE))
        self.blocks = -(-self.n // self.block)
        self.maxima = np.zeros((len(self.vocab), self.blocks), np.float32)
        np.maximum.at(self.maxima, (self.term, self.item // self.block), self.weight.astype(np.float32))
        # Where each posting list enters each block.
        keys = self.term * (self.blocks + 1) + self.item // self.block
        self.skip = np.searchsorted(keys, np.arange(len(self.vocab) * (self.blocks + 1) + 1)).astype(np.int32)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.vocab & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes; -1 for words of no item."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.hint[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
            hit = self.vocab[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """Every (item number, score) at or above the threshold in the given blocks, those
        whose summed block maxima reach it; the posting lists skip all other blocks."""
        out = []
        for block in blocks.tolist():
            low = block * self.block
            at, end = self.skip[terms * (self.blocks + 1) + block], self.skip[terms * (self.blocks + 1) + block + 1]
            size = end - at
            take = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
            score = np.bincount(self.item[take] - low, weights=self.weight[take], minlength=1)
            out += [(low + k, float(score[k])) for k in np.flatnonzero(score >= self.threshold - 1e-9).tolist()]
        return out

    def passages(self, h: np.ndarray, row: np.ndarray, n_rows: int):
        """(row, first word, last word, hits) of each passage that reaches the threshold, of the
        words with hashes `h` of rows `row`."""
        half = self.half
        count = np.bincount(row, minlength=n_rows)
        first = np.concatenate(([0], np.cumsum(count)))
        # A row of m words has max(1, ceil(m / half) - 1) passages of two half passages each.
        halves = -(-count // half)
        base = np.concatenate(([0], np.cumsum(halves)))
        term = self.lookup(h)
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return
        part, term = base[row[known]] + (known - first[row[known]]) // half, term[known]
        total, size = int(base[-1]), len(self.vocab)
        owner = np.repeat(np.arange(n_rows), halves)
        begin = np.searchsorted(part, np.arange(total + 1))
        for low in range(0, total, STEP):
            up = min(low + STEP + 1, total)  # the passage of the last half reaches into the next
            a, b = begin[low], begin[up]
            if a == b:
                continue
            for p, held, blocks in self._reaching(part[a:b] - low, term[a:b], up - low, owner[low:up], min(STEP, total - low), size):
                hits = self.search(held, blocks)
                if hits:
                    r = int(owner[low + p])
                    x = int(first[r] + (low + p - base[r]) * half)
                    yield r, x, int(min(x + 2 * half, first[r + 1])) - 1, hits

    def _reaching(self, part: np.ndarray, term: np.ndarray, total: int, owner: np.ndarray, wanted: int, size: int):
        """(half passage, its passage's distinct terms, blocks) of the first `wanted` passages
        whose bounds reach the threshold in some block."""
        if total * size <= DENSE:  # a table of marks where it is small, else a sort
            marks = np.zeros(total * size, bool)
            marks[part * size + term] = True
            key = np.flatnonzero(marks)
        else:
            marks, key = None, np.unique(part * np.int64(size) + term)
        part, term = key // size, key % size
        begin = np.searchsorted(part, np.arange(total + 1))
        some = np.flatnonzero(np.diff(begin))
        bound = np.zeros((total + 1, self.blocks), np.float32)
        for g in np.array_split(some, max(1, len(key) * self.blocks // (1 << 22))):
            if len(g):
                a, b = begin[g[0]], begin[g[-1] + 1]
                bound[g] = np.add.reduceat(self.maxima[term[a:b]], begin[g] - a, axis=0)
        vital = np.zeros(total + 1, bool)
        vital[part[self.essential[term]]] = True
        # Passage p spans the half passages p and p + 1 of one row; both bounds add up.
        pair = np.zeros(total, bool)
        pair[:-1] = owner[1:] == owner[:-1]
        whole = bound[:-1].copy()
        whole[pair] += bound[1:][pair]
        sure = self.threshold - 1e-5
        vital = vital[:-1] | (vital[1:] & pair)
        # Words of both halves count once.
        maybe = vital & pair & (whole >= sure).any(axis=1)
        at = np.flatnonzero(maybe[part])
        twice = at[marks[key[at] + size]] if marks is not None else at[np.isin(key[at] + size, key)]
        if len(twice):
            cut = np.flatnonzero(np.diff(part[twice], prepend=-1))
            whole[part[twice[cut]]] -= np.add.reduceat(self.maxima[term[twice]], cut, axis=0)
        sure -= 1e-4
        reach = vital & (whole >= sure).any(axis=1)
        for p in np.flatnonzero(reach[:wanted]).tolist():
            held = term[begin[p] : begin[p + 1 + int(pair[p])]]
            yield p, np.unique(held) if pair[p] else held, np.flatnonzero(whole[p] >= sure)

    def leaks(self, passage: bytes, hits: list[tuple[int, float]]):
        """Of a normalised passage's hits, (item id, score, question and answer overlap) of the
        leaks."""
        w = split_words(passage)
        held = grams(w)
        for k, score in hits:
            shares = []
            for part in self.parts[k]:
                if any(len(g) < 3 for g in part):
                    shares.append(sum(_holds(w, g) for g in part) / len(part))
                else:
                    shares.append(len(part & held) / len(part) if part else 1.0)
            question, answer, whole = shares
            if question >= QUESTION and answer >= ANSWER or whole >= WHOLE:
                yield self.ids[k], score, question, answer


def _holds(w: list[bytes], gram: tuple[bytes, ...]) -> bool:
    n = len(gram)
    return any(tuple(w[i : i + n]) == gram for i in range(len(w) - n + 1))


# ---------------------------------------------------------------- building


def _listed(batches):
    """uid, item_id, text, half, n_words, hashes and times of each item that has words."""
    for batch in batches:
        ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        _, h, row, _, _ = hashed_words(batch.column(2))
        own = [Counter(x.view(np.int64).tolist()) for x in np.split(h, np.cumsum(np.bincount(row, minlength=len(ids)))[:-1])] if len(ids) else []
        keep = [i for i, c in enumerate(own) if c]
        size = [sum(own[i].values()) for i in keep]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array([ids[i] for i in keep], pa.int64()), pa.array([texts[i] for i in keep], pa.string()), pa.array([half_of(n) for n in size], pa.int64()), pa.array(size, pa.int64()),
                pa.array([list(own[i]) for i in keep], pa.list_(pa.int64())), pa.array([list(own[i].values()) for i in keep], pa.list_(pa.int64())),
            ],
            ["uid", "item_id", "text", "half", "n_words", "hashes", "times"])


def build_indexes(benchmark: DataFrame, threshold: float = THRESHOLD) -> list[str]:
    """Builds the indexes of (item_id, text) rows as files in the shared folder and returns
    their paths. Equal rows count once; items without words are left out."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    items = items.select(F.sha2(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("none")), "text"), 256).alias("uid"), "item_id", "text")
    listed = materialise(items.mapInArrow(_listed, "uid string, item_id long, text string, half long, n_words long, hashes array<long>, times array<long>"), "benchmark")
    # A row for each length class, of which there are a few dozen at most.
    classes = listed.groupBy("half").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not classes:
        return []
    n_items = sum(r["n"] for r in classes)
    mean = sum(r["words"] for r in classes) / n_items
    cuts = F.element_at(F.create_map(*(F.lit(x).cast("long") for r in classes for x in (r["half"], -(-r["bytes"] // INDEX_BYTES)))), F.col("half"))
    parted = listed.withColumn("part", F.pmod(F.xxhash64("uid"), cuts))
    found = parted.select("uid", "half", "part", F.explode("hashes").alias("h"))
    df = found.groupBy("h").agg(F.count("*").alias("df"))
    df = found.select("half", "part", "h").distinct().join(df, "h").groupBy("half", "part").agg(F.collect_list(F.struct("h", "df")).alias("df"))
    df = df.withColumnsRenamed({"half": "of_half", "part": "of_part"})
    folder = scratch_path(spark, "leak-index")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table({"path": pa.array([], pa.string())})
        unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
        seen = {unsigned(x["h"]): x["df"] for r in right.to_pylist() for x in r["df"]}
        own = [(r["item_id"], r["text"], dict(zip(map(unsigned, r["hashes"]), r["times"], strict=True))) for r in rows]
        index = Index(own, seen, n_items, mean, rows[0]["half"], threshold)
        path = f"{folder}/index-{uuid.uuid4().hex}"
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(root) as f:
            f.write(pickle.dumps(index, protocol=5))
        return pa.table({"path": [path]})

    built = parted.groupBy("half", "part").cogroup(df.groupBy("of_half", "of_part")).applyInArrow(build, "path string")
    return sorted(r["path"] for r in built.collect())  # a short path for each INDEX_BYTES of items


_held: dict[str, Index] = {}


def _load(paths: list[str]) -> list[Index]:
    """The indexes of at most HELD paths; a worker keeps the last ones it used."""
    for p in [p for p in _held if p not in paths]:
        del _held[p]
    for p in paths:
        if p not in _held:
            fs, root = pafs.FileSystem.from_uri(p)
            with fs.open_input_stream(root) as f:
                _held[p] = pickle.loads(f.read())
    return [_held[p] for p in paths]


# ---------------------------------------------------------------- searching


def search_texts(paths: list[str], texts: pa.Array) -> dict[tuple, tuple]:
    """{(row, item id): (score, question overlap, answer overlap)}: the best of each leak."""
    best: dict[tuple, tuple] = {}
    raw, offsets = text_buffer(normalised(texts))
    for low in range(0, len(paths), HELD):
        indexes = _load(paths[low : low + HELD])
        for a, b in chunks(offsets):
            part = raw[offsets[a] : offsets[b]]
            h, row, start, end = words(part, offsets[a : b + 1] - offsets[a], GAPS)
            for ix in indexes if len(h) else ():
                for r, x, y, hits in ix.passages(h, row, b - a):
                    for item, *found in ix.leaks(part[start[x] : end[y]].tobytes(), hits):
                        key = (a + r, item)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), tuple(found))
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each leaked test item in
    each row of `docs`; of an item's passages, and of items that share an id, the best counts.
    Whole texts are searched. Documents and items without words have no leaks; rows with a null id
    are reported with it; repeated rows are reported each. Empty tables give an empty result."""
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    paths = build_indexes(benchmark, threshold)

    def run(batches):
        for batch in batches:
            best = search_texts(paths, batch.column(1))
            order = sorted(best, key=lambda k: (k[0], k[1] is not None, k[1]))
            cols = [[best[k][j] for k in order] for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k[0] for k in order], pa.int64())), pa.array([k[1] for k in order], pa.int64()), *(pa.array(c, pa.float64()) for c in cols)],
                ["row_id", "item_id", "score", "question_overlap", "answer_overlap"])

    kind = rows.schema["row_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"row_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
    return found.withColumnRenamed("row_id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose text leaks a test item, in one pass and without a join."""
    paths = build_indexes(benchmark, threshold)
    at = own_text(docs)
    rows = docs if at is not None else docs.withColumn("__text", F.col("text").cast("string"))

    def clean(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for r, _ in search_texts(paths, batch.column(batch.num_columns - 1 if at is None else at)):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(clean, rows.schema).drop("__text")
