import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from simquarry.llm import simhash as sh
from simquarry.llm.common import shingles, text_buffer, words
from simquarry.llm.queries import op8_fingerprints


def votes(text):
    """The fingerprint by the definition, one vote after the other."""
    h, row, start, end = words(*text_buffer(pa.array([text])))
    if not len(h):
        return 0
    term, _ = shingles(h, row, 1, sh.TERM_WORDS)
    total = [0] * 64
    for k, t in enumerate(term.tolist()):
        w = int(end[min(k + sh.TERM_WORDS, len(h)) - 1] - start[k]).bit_length()
        for b in range(64):
            total[b] += w if t >> b & 1 else -w
    return sum(1 << b for b in range(64) if total[b] > 0)


def test_votes():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("alpha beta Gamma é x yy".split()) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    assert sh._hash_texts(texts).tolist() == [votes(t) for t in texts]
    assert sh._hash_texts(["A b  C"])[0] == sh._hash_texts(["a B\nc"])[0]


def expected(docs):
    spark_hash = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() ^ 1 << 63) - (1 << 63)
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, spark_hash(d[1] or ""), d[1] or ""))
    texts = [t or "" for _, t in docs]
    fps = sh._hash_texts(texts)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        t, nxt = texts[i], (i + 1) % len(docs)
        e = t[: len(t) - len(t) // 2] + texts[nxt][: len(t) // 2]
        f = sh._hash_texts([e])
        out.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{fps[i]:016x}", f"{f[0]:016x}", 1 - (int(fps[i]) ^ int(f[0])).bit_count() / 64, 1 - (int(fps[i]) ^ int(fps[nxt])).bit_count() / 64))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


def test_query_on_the_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    out = op8_fingerprints(spark, data)
    want = expected(docs)
    assert rows(out) == want
    fps = np.array([int(w[3], 16) for w in want], np.uint64)
    ids = np.array([w[0] for w in want])
    asked = out.where("near_found is not null").collect()
    assert sorted(r.doc_id for r in asked) == sorted(i for i in ids.tolist() if i % 50 == 0)
    for r in asked:
        near = (np.bitwise_count(fps ^ np.uint64(int(r.fingerprint, 16))) <= 3) & (ids != r.doc_id)
        assert r.near_found == near.sum() and r.near_fingerprints == sorted({f"{x:016x}" for x in fps[near].tolist()})


def test_edge_cases(spark):
    schema = "doc_id long, text string, place int"
    docs = [(5, "five five five"), (1, None), (9, ""), (3, "é𝒳ñ " * 20_000), (None, "b"), (None, "a"), (7, "x y z w"), (-4, "minus four is first")]
    for some in (docs, docs[:1], docs[:2], docs[3:4] + docs[6:]):
        df = spark.createDataFrame([(*d, 1) for d in some], schema).repartition(3)
        assert rows(sh.with_edits(df)) == expected(some)
    assert sh.with_edits(spark.createDataFrame([], schema)).count() == 0


def test_radius_search_is_exact(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(4)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in signed] + [(None,)], "fingerprint long")
    got = {(r["query"], r.fingerprint, r.distance) for r in sh.within_radius(df, df, 3).collect()}
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in signed for b in signed}
    assert got == {w for w in want if w[2] <= 3}


def test_rows_that_share_an_id(spark, monkeypatch):
    """Null and repeated ids, and equal rows, over many ranges."""
    monkeypatch.setattr(sh, "partitions", lambda spark: 9)
    docs = [(None, f"text number {i} here") for i in range(60)] + [(7, f"other {i % 20} text") for i in range(60)] + [(i, f"w{i} x y") for i in range(20)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, H int").repartition(5)
    assert rows(sh.with_edits(df)) == expected(docs)


@pytest.mark.parametrize("n,radius,blocks", [(0, 3, 4), (1000, 3, 4), (10**6, 3, 5), (2 * 10**10, 3, 8), (100, 0, 1)])
def test_table_blocks(n, radius, blocks):
    got = sh.table_blocks(n, radius)
    assert got == blocks and (64 * (got - radius) // got >= n.bit_length() + 4)


def test_memory_of_one_long_text():
    """Votes of a long text are gathered in slices."""
    import tracemalloc

    raw, offsets = text_buffer(pa.array([" ".join(f"w{i % 5000}" for i in range(1_500_000))]))
    tracemalloc.start()
    sh.simhash(raw, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(raw)
