from collections import Counter

from simquarry.llm.sharding import interleave_shards

SCHEMA = "doc_id long, text string, source string, Shard string, r int, f int"


def frame(spark, n=500):
    rows = [(i, f"t{i % 7}", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 5}", "x", 1, 2) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_slots_and_reruns(spark):
    df = frame(spark)
    out = interleave_shards(df, 7).collect()
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for k in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))
    whole = Counter(r.source for r in out)
    for k in sizes:
        for s, n in Counter(r.source for r in out if r["shard"] == k).items():
            assert abs(n - whole[s] / 7) <= len(whole)
    again = interleave_shards(df.repartition(13), 7).collect()
    assert {(r.doc_id, r["shard"], r["slot"]) for r in out} == {(r.doc_id, r["shard"], r["slot"]) for r in again}


def test_matches_a_plain_version(spark):
    import hashlib

    rows = [(i, "t", f"s{i % 3}", "", 0, 0) for i in range(100)]
    got = {r.doc_id: (r["shard"], r["slot"]) for r in interleave_shards(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    h = {r[0]: int(hashlib.md5(f"7:{r[0]}".encode()).hexdigest()[:15], 16) for r in rows}
    placed = []
    for s in ("s0", "s1", "s2"):
        own = sorted((r[0] for r in rows if r[2] == s), key=h.get)
        placed += [((2 * k + 1) / (2 * len(own)), s, h[i], i) for k, i in enumerate(own)]
    for p, (_, _, _, i) in enumerate(sorted(placed)):
        assert got[i] == (p // 25, p % 25)


def test_edge_cases(spark):
    assert interleave_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0
    rows = [(None, None, None, None, None, None)] * 3 + [(5, "a" * 100_000, "s", "", 1, 1)] * 2
    out = interleave_shards(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert len(out) == 5 and all(r["slot"] == 0 for r in out)
