import math
import random
import re

import numpy as np
import pytest

from simquarry.llm import mixing
from simquarry.llm.queries import op10_mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets of (source, size) by the rule: stop what is above, reshare, until none is."""
    sizes = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    size, stopped = dict(sizes), {}
    while True:
        free = [s for s in size if s not in stopped]
        left = share * sum(size.values()) - sum(stopped.values())
        out = stopped | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if out[s] > cap * size[s]]
        if not over:
            return out
        stopped |= {s: cap * size[s] for s in over}


def targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, size long, n long").repartition(3)
    return {r.source: r.target for r in mixing.source_targets(df).collect()}


def test_targets(spark):
    # 450 by 5, 2, 1 gives 281.25 to the first; its excess over 200 goes to the others, 2 to 1.
    assert targets(spark, [("a", 100), ("b", 100), ("c", 100)]) == pytest.approx({"a": 200, "b": 500 / 3, "c": 250 / 3})
    t = targets(spark, [("a", 100), ("b", 100), ("c", 100), (None, 0)])
    assert t["a"] == 200 and abs(sum(t.values()) - 450) < 1e-9 and t[None] == 0 and max(t.values()) <= 200
    assert targets(spark, []) == {}
    assert targets(spark, [("a", 0), (None, 0)]) == {"a": 0, None: 0}


def test_targets_of_many_sources(spark, monkeypatch):
    rng = random.Random(6)
    sizes = [(f"s{rng.random()}é" if i % 3 else f"S{rng.random()}", int(rng.paretovariate(0.8) * 10)) for i in range(3000)] + [(None, 500)]
    assert targets(spark, sizes) == pytest.approx(plain_targets(sizes))
    rows = [(i, "w " * rng.randrange(1, 30), f"src{i % 400}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect()) == one and len(one) == 2000


def plain_flight(p, z, u):
    """The cube's flight by cross products: while two units (of one size) or three are open, move
    along the null space of (1, z) to a face."""
    p, open_ = [float(x) for x in p], []
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        while len(open_) > 2 or len(open_) == 2 and z[open_[0]] == z[open_[1]]:
            if len(open_) == 2:
                way = np.array([1.0, -1.0])
            else:
                way = np.cross([1.0, 1.0, 1.0], [float(z[j]) for j in open_])
                way = way / np.abs(way).max() if np.abs(way).max() else np.array([1.0, -1.0, 0.0])
            now = np.array([p[j] for j in open_])
            up = min([(1 - x) / d if d > 0 else -x / d for x, d in zip(now, way, strict=True) if d])
            down = min([x / d if d > 0 else (x - 1) / d for x, d in zip(now, way, strict=True) if d])
            now = now + way * (up if u[open_[-1]] * (up + down) < down else -down)
            for j, x in zip(open_, now, strict=True):
                p[j] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else float(x)
            open_ = [j for j in open_ if 0 < p[j] < 1]
    return p


@pytest.mark.parametrize("n", [300, 2500])
def test_taken_equals_the_plain_method(spark, n):
    rng = random.Random(n)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a", "a", "b", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    from simquarry.llm.common import row_keys

    keyed = row_keys(df, *mixing.KEYS).withColumn("h", F.xxhash64(F.lit(11), "doc_id", *mixing.KEYS, F.lit(1).cast("long")))
    draws = {r.doc_id: r.h for r in keyed.collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    out = mixing.mix(df).collect()
    aims, want = {r.source: r.target for r in out}, {}
    assert aims == pytest.approx(plain_targets([(s, sum(size[i] for i, _, x in rows if x == s)) for s in aims]))
    for s, aim in aims.items():
        own = [i for i, _, x in rows if x == s]
        rate = aim / sum(size[i] for i in own)
        whole = min(2, math.floor(rate + 1e-9))
        open_ = dict.fromkeys(own, max(0.0, rate - whole))
        blocks, shift = math.ceil(len(own) / mixing.BLOCK), 16
        width = max(math.ceil(sum(x == t for _, _, x in rows) / mixing.BLOCK) for t in aims)
        while True:
            for b in range(blocks):
                block = sorted((i for i in open_ if 0 < open_[i] < 1 and (draws[i] >> shift) % blocks == b), key=lambda i: draws[i])
                if not block:
                    continue
                p, z = np.array([open_[i] for i in block]), np.array([size[i] for i in block])
                fly = ~mixing.reserve(p, z)
                u = [((draws[i] & (1 << 64) - 1) >> 11) / 2.0**53 for i in block]
                p[fly] = plain_flight(p[fly], z[fly], [x for x, f in zip(u, fly, strict=True) if f])
                left = [k for k in range(len(block)) if 0 < p[k] < 1]
                if width <= 1 and left:
                    # The landing, by trying every rounding; the first one counts as 1, 2, 4 ... do.
                    tries = [[c >> k & 1 for k in range(len(left))] for c in range(1 << len(left))]
                    off = np.array(tries, float) - p[left]
                    cost = np.abs(off @ z[left]) + 0.02 * z.mean() * np.abs(off.sum(axis=1))
                    best = tries[int(np.argmin(cost))]
                    for k, x in enumerate(left):
                        p[x] = best[k]
                open_ |= dict(zip(block, p.tolist(), strict=True))
            if width <= 1:
                break
            width = blocks = math.ceil((mixing.RESERVE + 2) * width / mixing.BLOCK)
            shift = 8
        want |= {i: (whole + int(open_[i])) * size[i] for i in own}
    assert {r.doc_id: r.taken for r in out} == want


def test_flight_keeps_totals():
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(50):
        n = int(rng.integers(3, 200))
        p, size = rng.random(n), rng.integers(0, 1000, n)
        q = mixing.flight(p, size, rng.random(n))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3


def test_flight_is_unbiased():
    rng = np.random.Generator(np.random.PCG64(2))
    p, size = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([5, 1, 9, 3, 4, 8])
    mean = np.mean([mixing.flight(p, size, rng.random(6)) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.05


@pytest.mark.parametrize("block", [1024, 40])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), rng.choice(["hot", "hot", "b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    assert {r.doc_id: r["size"] for r in out} == size
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 300
    assert abs(sum({r.source: r.target for r in out}.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(r.taken <= 2 * r["size"] for r in out)
    again = mixing.mix(df.repartition(9)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.apply_mix(df, mixing.mix(df)).count() == sum(r.copies for r in out)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, copies int"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a", 1), (1, None, "a", 1), (1, "x", "a", 1), (2, "", None, 1), (None, "x y", "a", 1), (None, "z", "a", 1), (3, "w " * 50_000, "b", 1)]
    df = spark.createDataFrame(rows, schema)
    got = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r.source, r["size"]) for r in got if r.source) == [("1", "a", 0), ("1", "a", 0), ("1", "a", 1), ("3", "b", 50_000), ("None", "a", 1), ("None", "a", 2)]
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    same = spark.createDataFrame([(5, "p q r", "a", 1)] * 40 + [(6, "s", "b", 1)], schema)
    mixed = mixing.mix(same)
    assert mixed.count() == 41
    out = mixing.apply_mix(same, mixed)
    assert out.columns == same.columns and out.where("doc_id = 5").count() == mixed.where("doc_id = 5").groupBy().sum("copies").first()[0]


def test_query(spark, data):
    out = op10_mixing(spark, data)
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
