"""Token ids as flat binary files with 64-bit document offsets.

A data set is a folder of part files, one pair per range of document ids:

* `part-NNNNN.bin`: the token ids of the part's documents one after the other, little-endian
  unsigned integers of 2 bytes (4 when the vocabulary needs them), nothing else;
* `part-NNNNN.idx`: an 8-byte magic, then as little-endian int64 the number of documents n, the
  bytes per id, n + 1 offsets in ids from the part's start and n document ids, then n bytes
  that are 1 where the document id is null.

`manifest.json` lists the parts in ascending document order with the base of each: the prefix
sum of the ids before it. A document's place in the whole is its part's base plus its offset.
Parts are written under a temporary name and renamed, so a repeated task attempt leaves one
whole part. Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hash_spans, partitions, qualified, scratch_path, text_or_empty

MAGIC = b"SQTOK\x00\x00\x01"
#: Distinct pre-tokens whose ids a worker keeps (about 50 bytes each), and characters of them; the
#: table is emptied when it is full.
CACHE, CACHE_CHARS = 2_000_000, 16 << 20
#: Characters that are encoded at a time.
CHARS = 1 << 18

# Classes of U+0000-U+024F, where letters, numbers and white space are the same in every
# Unicode version: 0 other, 1 letter, 2 number, 3 white space.
LIMIT = 0x250
_BEYOND = re.compile(r"[^\u0000-\u024f]")
_CLASS = np.zeros(LIMIT, np.uint8)
for _low, _high, _kind in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xAA, 0xAA, 1), (0xB5, 0xB5, 1), (0xBA, 0xBA, 1), (0xC0, 0xD6, 1), (0xD8, 0xF6, 1), (0xF8, 0x24F, 1), (0x30, 0x39, 2), (0xB2, 0xB3, 2), (0xB9, 0xB9, 2), (0xBC, 0xBE, 2), (0x09, 0x0D, 3), (0x20, 0x20, 3), (0x85, 0x85, 3), (0xA0, 0xA0, 3)):
    _CLASS[_low : _high + 1] = _kind


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where it is printable, else
    the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def location(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def piece_starts(cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE start in `cp`, code points below LIMIT of texts one
    after the other; `begins` are the places where a text begins.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+ with s white space,
    L letters, N numbers: a run of one class is a piece, with the one space before it; of more
    white space before it, the last character stands apart."""
    n = len(cp)
    kind = _CLASS[cp]
    head = np.zeros(n + 1, bool)
    head[begins] = True
    head[n] = True
    fresh = head[:n].copy()  # the first character of a text
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[fresh] = 9
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 9, kind[1:]
    after[head[1:]] = 9
    blank = kind == 3
    spaced = np.zeros(n, bool)  # the character before is U+0020
    spaced[1:] = cp[:-1] == 0x20
    spaced[fresh] = False
    start = np.where(blank, (before != 3) | ((after != 3) & (after != 9)), (kind != before) & ~spaced)
    # Contractions: a run of other characters that begins with an apostrophe.
    quote = np.flatnonzero((cp == 0x27) & start & (after == 1))
    for i in quote.tolist():
        tail = cp[i + 1 : i + 3].tolist()
        if tail[0] in (0x73, 0x74, 0x6D, 0x64):
            size = 2
        elif len(tail) == 2 and not head[i + 2] and tuple(tail) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            size = 3
        else:
            continue
        start[i + 1 : i + size] = False
        if i + size < n:
            start[i + size] = True if not head[i + size] and kind[i + size] == 1 else start[i + size]
    return np.flatnonzero(start)


class Encoder:
    """Encodes texts exactly as `Tokenizer.encode(text, add_special_tokens=False)` does.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are those of its
    pre-tokens. These are cut and looked up with array operations; each distinct one goes through
    the library's model once and is kept with its characters. A lookup goes by hash and then
    compares the characters of every piece, so a collision never gives another piece's ids: texts
    with one go through the library whole. So do texts with characters beyond U+024F or with an
    added token, and all texts of a tokenizer that isn't plain byte-level BPE."""

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or ())
        )
        self._empty()

    def _empty(self):
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, self.dtype)
        self.text_at, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, key: np.ndarray, pieces: list[str]) -> None:
        letters = self.letters.__getitem__
        ids = [[t.id for t in self.model.tokenize("".join(map(letters, p.encode())))] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.dtype, int(size.sum()))
        rows = np.arange(len(self.at) - 1, len(self.at) - 1 + len(ids))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
        self.flat = np.concatenate((self.flat, flat))
        self.text_at = np.concatenate((self.text_at, self.text_at[-1] + np.cumsum([len(p) for p in pieces])))
        self.text = np.concatenate((self.text, np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.uint16)))
        place = np.searchsorted(self.key, key)
        self.key, self.row = np.insert(self.key, place, key), np.insert(self.row, place, rows)

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts of known characters."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint16)
        edge = np.cumsum([0, *map(len, texts)])
        start = piece_starts(cp, edge[:-1][np.diff(edge) > 0])
        end = np.append(start[1:], len(cp))
        h = hash_spans(cp.view(np.uint8), 2 * start, 2 * end)
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.key) > CACHE or len(self.text) > CACHE_CHARS:
            self._empty()
        place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        new = self.key[place] != key if len(self.key) else np.ones(len(key), bool)
        if new.any():
            at = first[new]
            self._learn(key[new], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place = np.searchsorted(self.key, key)
        row = self.row[place][back]
        if not self._same(row, cp, start, end):
            parts = [self._whole(t) for t in texts]
            return np.concatenate(parts), np.asarray(list(map(len, parts)), np.int64)
        size = self.at[row + 1] - self.at[row]
        to = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[row] - (to - size), size) + np.arange(to[-1])]
        reach = np.concatenate(([0], to))[np.searchsorted(start, edge)]
        return ids, np.diff(reach)

    def _same(self, row: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether the characters kept for each piece's row are the piece's own."""
        size = end - start
        if not np.array_equal(self.text_at[row + 1] - self.text_at[row], size):
            return False
        return np.array_equal(self.text[np.repeat(self.text_at[row] - start, size) + np.arange(len(cp))], cp)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's count."""
        joined = "".join(texts)
        if self.plain and not _BEYOND.search(joined) and not any(x in joined for x in self.added):
            return self._many(texts)
        known = [self.plain and not _BEYOND.search(t) and not any(x in t for x in self.added) for t in texts]
        ids, counts = self._many([t for k, t in zip(known, texts, strict=True) if k])
        cuts, parts, sizes = iter(np.split(ids, np.cumsum(counts)[:-1])), [], []
        for k, t in zip(known, texts, strict=True):
            parts.append(next(cuts) if k else self._whole(t))
            sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.asarray(sizes, np.int64)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    """One encoder for each worker process, whose table later tasks find filled."""
    if (path, dtype) not in _encoders:
        _encoders.clear()
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def _writer(folder: str, tokenizer: str, end_id: int, dtype: str):
    def write(batches):
        part = TaskContext.get().partitionId()
        fs, root = location(folder)
        encode = encoder(tokenizer, dtype)
        name, mark = f"{root}/part-{part:05d}", f".{uuid.uuid4().hex}.tmp"
        out, ids, null, counts = None, [], [], []
        for batch in batches:
            if not len(batch):
                continue
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            ids.append(np.asarray(keys.fill_null(0), "<i8"))
            null.append(np.asarray(keys.is_null(), np.uint8))
            if out is None:
                out = fs.open_output_stream(f"{name}.bin{mark}")
            for a, b in chunks(np.cumsum([0, *map(len, texts)]), CHARS):
                data, count = encode(texts[a:b])
                out.write(np.insert(data, np.cumsum(count), end_id).tobytes())
                counts.append(count + 1)
        if out is None:
            return
        out.close()
        ids, null, counts = np.concatenate(ids), np.concatenate(null), np.concatenate(counts)
        with fs.open_output_stream(f"{name}.idx{mark}") as f:
            f.write(MAGIC + np.asarray([len(ids), np.dtype(dtype).itemsize, 0], "<i8").tobytes())
            f.write(np.cumsum(counts).astype("<i8").tobytes() + ids.tobytes() + null.tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{name}.{kind}{mark}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids)], "n_tokens": [int(counts.sum())]})

    return write


def largest_id(tokenizer: str) -> int:
    """The largest token id that a tokenizer file gives."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every row's whole text (null: empty), append `end_id`, and write the rows in
    ascending `id_col` order (null first; equal ids by their text's bytes, then its hash) as token
    files under `folder`. Returns the manifest's parts. An empty table gives no parts. Ids take 2
    bytes where the tokenizer's largest id and `end_id` fit, else 4."""
    spark, folder = docs.sparkSession, qualified(docs.sparkSession, folder)
    dtype = "<u2" if max(largest_id(tokenizer), end_id) < 1 << 16 else "<u4"
    fs, root = location(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    # Length and hash split the rows of one id, or those without an id, over ranges too.
    order = ["id", F.octet_length("text"), F.xxhash64("text")]
    rows = rows.repartitionByRange(max(2, partitions(spark)), *order).sortWithinPartitions(*order, "text")
    found = rows.mapInArrow(_writer(folder, tokenizer, end_id, dtype), "part long, n_docs long, n_tokens long").collect()  # a row for each part
    base, parts = 0, []
    for r in sorted(found, key=lambda r: r["part"]):
        parts.append({"part": f"part-{r['part']:05d}", "base": base, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        base += r["n_tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"id_bytes": int(dtype[-1]), "end_id": end_id, "n_tokens": base, "parts": parts}).encode())
    return parts


def open_part(folder: str, part: str):
    """(document ids, offsets, token ids) of a part, mapped into memory where it is local."""
    fs, root = location(folder)

    def view(name: str):
        if isinstance(fs, pafs.LocalFileSystem):
            return pa.memory_map(f"{root}/{name}").read_buffer()
        with fs.open_input_file(f"{root}/{name}") as f:
            return f.read_buffer()

    index = view(f"{part}.idx")
    if bytes(index[:8]) != MAGIC:
        raise ValueError(f"{part}.idx is not a token index")
    n, width = np.frombuffer(index, "<i8", 2, 8)
    offsets = np.frombuffer(index, "<i8", n + 1, 24)
    ids = np.frombuffer(index, "<i8", n, 24 + 8 * (n + 1))
    null = np.frombuffer(index, np.uint8, n, 24 + 8 * (2 * n + 1)).astype(bool)
    tokens = np.frombuffer(view(f"{part}.bin"), f"<u{width}") if offsets[-1] else np.zeros(0, f"<u{width}")
    if len(tokens) != offsets[-1]:
        raise ValueError(f"{part}.bin holds {len(tokens)} ids, its index {offsets[-1]}")
    return pa.array(ids, mask=null), offsets, tokens


def _reader(folder: str):
    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, tokens = open_part(folder, part)
                for a in range(0, len(ids), 10_000):
                    b = min(a + 10_000, len(ids))
                    sums = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [ids[a:b], pa.array(offsets[a:b] + base), pa.array(np.diff(offsets[a : b + 1])), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    folder = qualified(spark, folder)
    fs, root = location(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    rows = spark.createDataFrame([(p["part"], p["base"]) for p in parts], "part string, base long")
    return rows.repartition(max(1, len(parts))).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
