import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from simquarry.llm import quality
from simquarry.llm.common import text_buffer, words
from simquarry.llm.queries import op3_quality


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    test = labels.where("doc_id % 3 = 0")
    scores = quality.score_documents(docs, labels.where("doc_id % 3 <> 0"))
    rows = scores.join(test, "doc_id").select("keep", "quality").collect()
    right = sum(r.keep == bool(r.quality) for r in rows)
    assert len(rows) > 100 and right / len(rows) >= 0.97
    assert sum(not r.keep and r.quality == 1 for r in rows) <= 2


def test_views_exchange_labels():
    rng = np.random.Generator(np.random.PCG64(3))
    y = rng.integers(0, 2, 400)
    views = tuple(rng.normal(size=(400, 3)) + y[:, None] * shift for shift in (4.0, 1.0))
    pool_y = rng.integers(0, 2, 500)
    pool = tuple(rng.normal(size=(500, 3)) + pool_y[:, None] * shift for shift in (4.0, 1.0))
    model = quality.CoTrained(views, y, np.arange(400) % 4 == 3)
    for _ in range(2):
        for view in (0, 1):
            said = model.sure(view, pool[view])
            for good in (0, 1):
                model.hand(1 - view, good, pool[1 - view][said == good])
        model.fit()
    score = model.finish().score(*pool)[0]
    assert model.handed > 0 and ((score > 0.5) == pool_y).mean() > 0.98


# ---------------------------------------------------------------- the method, plainly


def plain_text(text):
    """The text-content features of one text, one byte and one word after the other."""
    raw = (text or "").encode()
    out = np.zeros(quality.TEXT_WIDTH)
    kind = lambda b: 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 5 if b in (9, 10, 11, 12, 13, 32) else 4 if b >= 128 else 3
    marks, n = list(b"|!?.,;:*#%$&<>{}[]()/\\=_-@\"'+~^"), max(1, len(raw))
    low = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    for b in raw:
        out[kind(b)] += 1 / n
    at = 6
    for m in marks:
        out[at] = (raw.count(m) / n) ** 0.5
        at += 1
    found = raw.split()
    per = max(1, len(found))
    shapes, buckets, grams = Counter(), Counter(), Counter()
    hashes = words(*text_buffer(pa.array([text or ""])))[0].tolist()
    for w in found:
        shapes[(kind(w[0]) * 6 + kind(w[-1])) * 4 + min(len(w).bit_length() - 1, 3)] += 1
    for h in hashes:
        buckets[h >> 57] += 1
    for i in range(len(low) - 2):
        grams[(int.from_bytes(low[i : i + 3], "big") * 0x9E3779B1 % 2**32) >> 25] += 1
    for width, counts, total in ((144, shapes, per), (128, buckets, per), (128, grams, n)):
        for k, c in counts.items():
            out[at + k] = (c / total) ** 0.5
        at += width
    lower = low.split()
    out[at] = sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / per
    out[at + 1] = len(set(lower)) / per
    out[at + 2] = sum(map(len, found)) / per
    out[at + 3] = sum(kind(w[0]) == 1 for w in found) / per
    return out


def plain_meta(lang, source, n_chars):
    out = np.zeros(quality.META_WIDTH)
    if lang is not None:
        out[zlib.crc32(lang.encode()) % 16] = 1
    if source is not None:
        out[16 + zlib.crc32(source.encode()) % 32] = 1
    out[48:] = [math.log1p(n_chars or 0), n_chars is None, n_chars is not None and n_chars < 200, n_chars is not None and n_chars > 20_000]
    return out


class Plain:
    """Ridge logistic regression by plain Newton steps."""

    def __init__(self, x, y, ridge=1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.use = self.scale >= 1e-9
        z = np.column_stack((((x - self.mean)[:, self.use] / self.scale[self.use]), np.ones(len(x))))
        pull = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.inv(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + pull) @ (z.T @ (p - y) + pull @ w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def odds(self, x):
        return np.clip((x - self.mean)[:, self.use] / self.scale[self.use] @ self.w[:-1] + self.w[-1], -30, 30)


def test_equals_the_plain_method(spark, data, monkeypatch):
    monkeypatch.setattr(quality, "HANDED", 20)
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    ids = sorted(rows)
    views = [{i: plain_text(rows[i].text) for i in ids}, {i: plain_meta(rows[i].lang, rows[i].source, rows[i].n_chars) for i in ids}]
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known = sorted(i for i in truth if i in rows)
    train, aside = [i for k, i in enumerate(known) if k % 4 != 3], [i for k, i in enumerate(known) if k % 4 == 3]
    sets = [{i: truth[i] for i in train}, {i: truth[i] for i in train}]
    want = [max(1, round(20 * sum(truth[i] == good for i in known) / len(known))) for good in (0, 1)]
    fit = lambda k: Plain(np.array([views[k][i] for i in sets[k]]), np.array(list(sets[k].values()), float))
    y, handed = np.array([truth[i] for i in aside], float), 0

    class View:
        def __init__(self, k):
            self.k, self.model = k, fit(k)
            self.platt = Plain(self.model.odds(np.array([views[k][i] for i in aside]))[:, None], y, 0.1)

        def __call__(self, ids):
            return self.platt.odds(self.model.odds(np.array([views[self.k][i] for i in ids]))[:, None])

    models = [View(0), View(1)]
    for number in range(quality.ROUNDS):
        rank = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(6 + number), "doc_id").alias("h")).collect()}
        picks = {}
        for view in (0, 1):
            p = dict(zip(ids, 1 / (1 + np.exp(-models[view](ids))), strict=True))
            for good in (0, 1):
                sure = sorted((i for i in ids if max(p[i], 1 - p[i]) >= quality.CONFIDENT and (p[i] >= 0.5) == good and i not in truth), key=lambda i: rank[i])
                picks[view, good] = [i for i in sure if i not in sets[1 - view]][: want[good]]
        for (view, good), own in picks.items():
            sets[1 - view] |= dict.fromkeys(own, good)
            handed += len(own)
        models = [View(0), View(1)]
    mix = Plain(np.column_stack([m(aside) for m in models]), y)
    score = 1 / (1 + np.exp(-mix.odds(np.column_stack([m(ids) for m in models]))))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert handed > 10
    for i, x in zip(ids, score.tolist(), strict=True):
        assert abs(got[i] - (x if (rows[i].text or "").split() else 0.0)) < 1e-3, i


def test_views_equal_the_plain_ones(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 50)
    rng = random.Random(2)
    for _ in range(100):
        texts = ["".join(rng.choice("aB 9é.!\n  xyz") for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(1, 6))]
        text, count = quality.text_view(*text_buffer(pa.array(texts)))
        assert np.allclose(text, np.array([plain_text(t) for t in texts])) and count.tolist() == [len(t.encode().split()) for t in texts]


def test_edge_cases(spark):
    schema, marks = "doc_id long, text string, lang string, source string, Keep int", "doc_id long, quality int, toxic int"
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("the of and to quiet river stone".split()) for _ in range(60)), "en", "a" if i % 2 else None, 0) for i in range(60)]
    bad = [(i, "THE!! " * 60, "en", "a" if i % 2 else None, 0) for i in range(60, 120)]
    odd = [(None, good[0][1], None, None, 0), (200, None, "en", "a", 0), (201, "", "en", "a", 0), (202, "the river " * 20_000, "en", "a", 0), (1, good[1][1], "en", "a", 0)]
    docs = spark.createDataFrame(good + bad + odd, schema)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120) if i % 3] + [(None, 1, 0), (5, None, 0), (9999, 0, 0), (0, 1, 1)], marks)
    rows = quality.score_documents(docs, labels).collect()
    got = {r.doc_id: r.keep for r in rows}
    assert len(rows) == 125 and all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 120))
    assert got[None] and not got[200] and not got[201]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert all(r.keep and r.score is None for r in none)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    lean = docs.select("doc_id", "text")
    assert quality.score_documents(lean, labels).count() == 125


def test_query(spark, data):
    assert op3_quality(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
