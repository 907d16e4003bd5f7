"""Quality classifier by co-training.

Two logistic classifiers see a document through separate views: its text content (hashed words and
character trigrams, character classes, word shapes, repetition; nothing of its length) and its page
metadata (language, source and the length that the table states; nothing of its text). Both start
from the labelled documents and are calibrated on some kept aside (Platt scaling). In each round,
either one judges every unlabelled document and hands some of its confident cases to the other as
pseudo-labels, and both are fitted and calibrated again. Last, the calibrated log-odds are combined
by weights fitted on the documents kept aside, and the combination scores every document.

The fits use a bounded sample: at most about LABELLED labelled rows, and in each round HANDED
pseudo-labelled rows a view, dealt to the classes as the labels are. Both samples go by a hash of
the id, the same under any partitioning; the documents that a view is confident of are looked for
in the whole table, whatever its size. Scoring reads every text whole.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, chunks, materialise, mix64, own_text, text_buffer, words

#: Labelled rows that the fit uses, about and at most.
LABELLED = 6_000
#: Rounds of exchange, rows that a view hands over in each, and how sure it must be of them.
ROUNDS, HANDED, CONFIDENT = 3, 300, 0.97
KEEP_FROM = 0.5
#: Rows whose features are held at a time, at most.
ROWS = 1024
_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 mark, 4 beyond ASCII, 5 white space
_KIND[:128] = 3
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KINDS = 6
_MARKS = np.frombuffer(b"|!?.,;:*#%$&<>{}[]()/\\=_-@\"'+~^", np.uint8)
_SHAPES = _KINDS * _KINDS * 4
#: Buckets of hashed words and of hashed character trigrams (a power of two).
BUCKETS = 128
_AT_MARKS, _AT_SHAPES, _AT_WORDS = _KINDS, _KINDS + len(_MARKS), _KINDS + len(_MARKS) + _SHAPES
_AT_GRAMS, _AT_REST = _AT_WORDS + BUCKETS, _AT_WORDS + 2 * BUCKETS
TEXT_WIDTH = _AT_REST + 4
_LANGS, _SOURCES = 16, 32
META_WIDTH = _LANGS + _SOURCES + 4


def gram_buckets(low: np.ndarray) -> np.ndarray:
    """The bucket of each three bytes in a row: a multiplicative hash of their number."""
    x = low.astype(np.uint32)
    x = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def text_view(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text-content features of each row, and its number of words."""
    n = len(offsets) - 1
    out = np.zeros((n, TEXT_WIDTH))
    size = np.maximum(np.diff(offsets), 1)[:, None]
    bytes_, grams = np.zeros((n, 256)), np.zeros((n, BUCKETS))
    for x in range(0, len(raw), CHUNK):  # a long text passes in pieces
        y = min(x + CHUNK, len(raw))
        i, j = np.searchsorted(offsets, x, side="right") - 1, np.searchsorted(offsets, y)
        row = np.repeat(np.arange(i, j), np.diff(np.clip(offsets[i : j + 1], x, y)))
        bytes_[i:j] += np.bincount((row - i) * 256 + raw[x:y], minlength=(j - i) * 256).reshape(-1, 256)
        two = min(y + 2, len(raw))
        bucket, first = gram_buckets(LOWER[raw[x:two]]), row[: max(0, two - x - 2)]
        last = np.searchsorted(offsets, np.arange(x, x + len(first)) + 2, side="right") - 1
        own = first == last  # trigrams don't reach into the next text
        grams[i:j] += np.bincount((first[own] - i) * BUCKETS + bucket[own], minlength=(j - i) * BUCKETS).reshape(-1, BUCKETS)
    for k in range(_KINDS):
        out[:, k] = bytes_[:, _KIND == k].sum(axis=1)
    out[:, :_KINDS] /= size
    out[:, _AT_MARKS:_AT_SHAPES] = np.sqrt(bytes_[:, _MARKS] / size)
    out[:, _AT_GRAMS:_AT_REST] = np.sqrt(grams / size)
    h, at, start, end = words(raw, offsets)
    count = np.bincount(at, minlength=n)
    per = np.maximum(count, 1)
    if len(h):
        length = np.minimum(np.frexp((end - start).astype(float))[1] - 1, 3)
        shape = (_KIND[raw[start]].astype(np.int64) * _KINDS + _KIND[raw[end - 1]]) * 4 + length
        out[:, _AT_SHAPES:_AT_WORDS] = np.sqrt(np.bincount(at * _SHAPES + shape, minlength=n * _SHAPES).reshape(n, _SHAPES) / per[:, None])
        bucket = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        out[:, _AT_WORDS:_AT_GRAMS] = np.sqrt(np.bincount(at * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / per[:, None])
        again = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        distinct = np.unique(h ^ mix64(at.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        out[:, -4] = np.bincount(at[1:][again], minlength=n) / per
        out[:, -3] = np.bincount(at[distinct], minlength=n) / per
        out[:, -2] = np.bincount(at, weights=end - start, minlength=n) / per
        out[:, -1] = np.bincount(at[_KIND[raw[start]] == 1], minlength=n) / per
    return out, count


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """The page-metadata features: language, source and stated length."""
    n = len(lang)
    out = np.zeros((n, META_WIDTH))
    known: dict = {}
    for i, (a, b) in enumerate(zip(lang, source, strict=True)):
        for value, low, width in ((a, 0, _LANGS), (b, _LANGS, _SOURCES)):
            if value is not None:
                k = known.get((value, low))
                if k is None:
                    k = known[value, low] = low + zlib.crc32(str(value).encode()) % width
                out[i, k] = 1.0
    size = np.array([np.nan if c is None else max(0, c) for c in n_chars], float)
    out[:, -4], out[:, -3] = np.log1p(np.nan_to_num(size)), np.isnan(size)
    out[:, -2], out[:, -1] = size < 200, size > 20_000
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = np.inf
        z = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        w, keep = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
        keep[-1, -1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Two views, trained on each other's confident pseudo-labels, calibrated and combined."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, aside: np.ndarray):
        """`views`: the labelled rows in either view; `aside` marks those kept for calibration."""
        y = y.astype(float)
        self.xs, self.ys = [v[~aside] for v in views], [y[~aside], y[~aside]]
        kept = aside if aside.any() else np.ones(len(y), bool)
        self.held, self.truth, self.handed = [v[kept] for v in views], y[kept], 0
        #: How many rows of class 0 and 1 a view hands over in a round.
        self.want = [max(1, round(HANDED * (y == good).mean())) for good in (0, 1)]
        self.fit()

    def fit(self) -> None:
        self.parts = [Logistic(x, t) for x, t in zip(self.xs, self.ys, strict=True)]
        odds = [m.odds(x)[:, None] for m, x in zip(self.parts, self.held, strict=True)]
        self.platt = [Logistic(o, self.truth, 0.1) for o in odds] if 0 < self.truth.mean() < 1 else None

    def odds(self, view: int, x: np.ndarray) -> np.ndarray:
        """A view's log-odds, calibrated on the rows kept aside."""
        raw = self.parts[view].odds(x)
        return self.platt[view].odds(raw[:, None]) if self.platt else raw

    def sure(self, view: int, x: np.ndarray) -> np.ndarray:
        """The class that a view is confident of for each row; -1 where it isn't. Confidence is
        calibrated, so a view that knows little is sure of nothing."""
        p = sigmoid(self.odds(view, x))
        return np.where(np.maximum(p, 1 - p) >= CONFIDENT, p >= 0.5, -1)

    def hand(self, view: int, good: int, x: np.ndarray) -> None:
        """Gives `view` rows that the other one is sure to be of class `good`."""
        self.xs[view] = np.concatenate((self.xs[view], x))
        self.ys[view] = np.concatenate((self.ys[view], np.full(len(x), float(good))))
        self.handed += len(x)

    def bare(self) -> CoTrained:
        """The model without its training rows: all that judging a document needs."""
        out = copy.copy(self)
        out.xs = out.ys = out.held = None
        return out

    def finish(self) -> CoTrained:
        """Combines the calibrated views; the training rows are let go."""
        if self.platt:
            self.mix = Logistic(np.column_stack([self.odds(k, x) for k, x in enumerate(self.held)]), self.truth, 1.0)
        return self.bare()

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined probability of good quality, and each view's."""
        calm = [self.odds(k, x) for k, x in enumerate((text, meta))]
        both = self.mix.odds(np.column_stack(calm)) if self.platt else calm[0]
        return sigmoid(both), sigmoid(calm[0]), sigmoid(calm[1])


#: The columns that the views read, behind a batch's own.
_READ = ("text", "lang", "source", "n_chars")


def _views(columns: list[pa.Array]):
    """(first row, last row, text features, meta features, words) of parts of a batch."""
    raw, offsets = text_buffer(columns[0])
    lang, source, n_chars = (c.to_pylist() for c in columns[1:])
    for low, high in chunks(offsets):
        for a in range(low, high, ROWS):  # short texts: many rows of features
            b = min(a + ROWS, high)
            text, count = text_view(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield a, b, text, meta_view(lang[a:b], source[a:b], n_chars[a:b]), count


def _features(batches):
    for batch in batches:
        for a, b, text, meta, _ in _views(batch.columns[1:]):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "text", "meta"])


def _columns(docs: DataFrame) -> list:
    have = {c.lower() for c in docs.columns}
    kinds = {"n_chars": "long"}
    return [(F.col(c).try_cast(kinds.get(c, "string")) if c in have else F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in _READ]


def _rows_of(docs: DataFrame, ids: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{doc_id: (text features, meta features)} of the wanted ids (column id; a bounded number);
    of rows that share an id, the least counts."""
    # A bounded broadcast and a bounded collect: callers ask for LABELLED or a few HANDED ids.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*_columns(docs)).alias("r")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi")
    rows = chosen.groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.*").mapInArrow(_features, "doc_id long, text binary, meta binary").collect()
    return {r[0]: (np.frombuffer(r[1]), np.frombuffer(r[2])) for r in rows}


def _confident(docs: DataFrame, model: CoTrained, seed: int) -> DataFrame:
    """(view, good, rank, id): every document with an id that a view is sure of, and a hash of
    the id."""
    held = docs.sparkSession.sparkContext.broadcast(model.bare())
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.lit(seed), "doc_id").alias("rank"), *_columns(docs))

    def run(batches):
        for batch in batches:
            for a, b, *views, _ in _views(batch.columns[2:]):
                for view in (0, 1):
                    said = held.value.sure(view, views[view])
                    mine = np.flatnonzero(said >= 0)
                    at = pa.array(mine + a)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), view, np.int32)), pa.array(said[mine].astype(np.int32)), batch.column(1).take(at), batch.column(0).take(at)], ["view", "good", "rank", "id"])

    return rows.mapInArrow(run, "view int, good int, rank long, id long")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, target: str = "quality", seed: int = 5) -> CoTrained | None:
    """The co-trained model, or None where the labelled rows hold fewer than two classes.

    Of a document with several labels the least counts; labels without a document are unused."""
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 2)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))
    share = int(min(1.0, labelled / max(1, known.count())) * 2**62)
    sample = {r["id"]: r["y"] for r in known.where(rank < F.lit(share)).select(F.col("doc_id").cast("long").alias("id"), "y").collect()}
    if len(set(sample.values())) < 2:
        return None
    rows = _rows_of(docs, docs.sparkSession.createDataFrame([(i,) for i in sample], "id long"))
    ids = sorted(rows)
    y = np.array([sample[i] for i in ids])
    if len(set(y.tolist())) < 2:
        return None
    model = CoTrained(tuple(np.array([rows[i][k] for i in ids]) for k in (0, 1)), y, np.arange(len(y)) % 4 == 3)
    given: set[tuple[int, int]] = set()
    all_known = known.select(F.col("doc_id").cast("long").alias("id"))
    for number in range(rounds):
        # Four numbers for a document; labelled documents keep their labels.
        found = materialise(_confident(docs, model, seed + 1 + number).join(all_known, "id", "left_anti"), "quality-sure")
        picks = {}
        for view in (0, 1):
            for good in (0, 1):
                mine = found.where((F.col("view") == view) & (F.col("good") == good)).select("rank", "id").distinct().orderBy("rank", "id").limit(HANDED + len(given)).collect()
                picks[view, good] = [i for i in (r["id"] for r in mine) if (1 - view, i) not in given][: model.want[good]]
        wanted = sorted({i for p in picks.values() for i in p})
        if not wanted:
            break
        rows = _rows_of(docs, docs.sparkSession.createDataFrame([(i,) for i in wanted], "id long"))
        for (view, good), own in picks.items():
            other = 1 - view
            given |= {(other, i) for i in own}
            if own:
                model.hand(other, good, np.array([rows[i][other] for i in own]))
        model.fit()
    return model.finish()


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, score, text_score, meta_score and keep for every row of `docs`.

    A document without words has score 0 and isn't kept. Where the labels don't hold two
    classes, nothing can be learnt: scores are null and every document is kept. Null language,
    source or length counts as no value; rows with a null id are scored; repeated rows, and rows
    that tie on every feature, score alike; a score of exactly KEEP_FROM is kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def run(batches):
        for batch in batches:
            for a, b, text, meta, count in _views(batch.columns[1:]):
                scores = _scores(model.value, text, meta, count)
                keep = pa.array([True] * (b - a)) if scores is None else pa.array(scores[0] >= KEEP_FROM)
                cols = [pa.nulls(b - a, pa.float64())] * 3 if scores is None else [pa.array(s) for s in scores]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *cols, keep], ["doc_id", "score", "text_score", "meta_score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *_columns(docs)).mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double, keep boolean")


def _scores(model: CoTrained | None, text: np.ndarray, meta: np.ndarray, count: np.ndarray):
    if model is None:
        return None
    scores = model.score(text, meta)
    scores[0][count == 0] = 0.0
    return scores


def keep_good(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of `docs` that the classifier keeps, in one pass and without a join."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    columns, at = docs.columns, own_text(docs)
    extra = _columns(docs) if at is None else _columns(docs)[1:]
    wide = docs.select(*(F.col(f"`{c}`") for c in columns), *(c.alias(f"__{i}") for i, c in enumerate(extra)))

    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            read = batch.columns[len(columns) :]
            for a, b, text, meta, count in _views(read if at is None else [batch.column(at), *read]):
                scores = _scores(model.value, text, meta, count)
                if scores is not None:
                    keep[a:b] = scores[0] >= KEEP_FROM
            yield batch.filter(pa.array(keep))

    return wide.mapInArrow(run, wide.schema).select(*(F.col(f"`{c}`") for c in columns))
