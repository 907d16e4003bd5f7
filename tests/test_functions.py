"""Expressions and small operators on hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from simquarry.functions import ids, values
from simquarry.operators import ingest, jobs, search, similarity, state, stats


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_ids(spark):
    a, b = "idx:main:func:m1:00a", "idx:main:func:m2:00b"
    sid = ids.pair_id(F.lit("main"), F.lit("jaccard"), F.lit(a), F.lit(b))
    x, y = ids.pair_ends(sid, F.lit("main"))
    r = one(spark, sid=sid, x=x, y=y, md5=ids.md5_of(F.lit(a), F.lit("main")), odd=ids.md5_of(F.lit("x:y"), F.lit("main")), meta=ids.without_meta(F.lit(a + ":meta")), addr=ids.address_of(F.lit("m:#m::f:@1::g:@2")), none=ids.address_of(F.lit("m")), hex=ids.hex32(F.lit(-1)), small=ids.hex32(F.lit(171)))
    assert r.sid == f"idx:main:sim:jaccard:{b}:{a}" and (r.x, r.y) == (b, a)
    assert (r.md5, r.odd, r.meta, r.addr, r.none, r.hex, r.small) == ("m1", "unknown", a, "2", "unknown_addr", "ffffffff", "ab")
    r = one(spark, legacy=ids.legacy_function_id(F.lit("c:#m::f::g:@1")), tags=ids.split_tags(F.lit(" a ,\tb,, ")), blank=ids.split_tags(F.lit(None).cast("string")), kind=ids.token_type(F.lit("ClangOpToken")), text=ids.token_type(F.lit("?")), size=ids.fmt_bytes(F.lit(1536)), tiny=ids.fmt_bytes(F.lit(5)))
    assert (r.legacy, r.tags, r.blank, r.kind, r["text"], r["size"], r.tiny) == ("c:function:m:1", ["a", "b"], [], "op", "text", "1.5 KB", "5.0 B")


def test_values(spark):
    r = one(
        spark, none=values.millis(F.lit(None)), zero=values.millis(F.lit(0)), sec=values.millis(F.lit(1.5)), ms=values.millis(F.lit(1_700_000_000_123)), iso=values.millis_text(F.lit("2024-01-02T03:04:05Z")), bad=values.millis_text(F.lit("soon")),
        r0=values.ratio(F.lit(1), F.lit(0)), r1=values.ratio(F.lit(1), F.lit(4)), c=values.clamp(F.lit(9), 1, 5), once=values.append_once(values.append_once(F.lit(None).cast("array<string>"), F.lit("a")), F.lit("a")),
        arr=values.as_array(F.lit("[1, 2]")), scalar=values.as_array(F.lit("7")), junk=values.as_array(F.lit("x")))
    assert (r.none, r.zero, r.sec, r.ms, r.iso, r.bad) == (0, 0, 1500, 1_700_000_000_123, 1_704_164_645_000, 0)
    assert (r.r0, r.r1, r.c, r.once, r.arr, r.scalar, r.junk) == (0.0, 25.0, 5, ["a"], [1, 2], [7], [None])
    assert one(spark, c=values.colour(F.lit("x"))).c in values.PALETTE
    m = lambda d: F.create_map(*(F.lit(x) for k, v in d.items() for x in (k, v))).cast("map<string,bigint>")
    r = one(spark, dot=values.map_dot(m({"a": 2, "b": 1}), m({"a": 3, "c": 1})), low=values.map_min_sum(m({"a": 2, "b": 1}), m({"a": 3, "b": 5})))
    assert (r.dot, r.low) == (6, 3)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(6)
    rows = {(f"idx:main:func:m{i % 4}:{i}", rng.choice("abcdefgh")): rng.randrange(1, 5) for i in range(25) for _ in range(4)}
    return spark.createDataFrame([("main", f, h, n) for (f, h), n in rows.items()], "collection string, function_id string, hash string, tf long"), rows


def test_scores_equal_the_formula(spark, vectors):
    df, rows = vectors
    funcs = sorted({f for f, _ in rows})
    raw = similarity.raw_pairs(df)
    for algo in similarity.ALGOS:
        got = {(r.id1, r.id2): r.score for r in similarity.scored(raw, algo).collect()}
        want = {}
        for a in funcs:
            for b in funcs:
                u, v = ({h: n for (f, h), n in rows.items() if f == x} for x in (a, b))
                both = u.keys() & v.keys()
                if a > b and both:
                    dot, low = sum(u[h] * v[h] for h in both), sum(min(u[h], v[h]) for h in both)
                    want[a, b] = dot / (sum(n * n for n in u.values()) ** 0.5 * sum(n * n for n in v.values()) ** 0.5) if algo == similarity.ALGOS[0] else low / (sum(u.values()) + sum(v.values()) - low)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.50001e-4 for k in want)
    assert similarity.raw_pairs(df, max_df=1).count() == 0


def test_targets_form_only_their_pairs(vectors, spark):
    df, rows = vectors
    some = spark.createDataFrame([("main", f) for f in sorted({f for f, _ in rows})[:6]], "collection string, function_id string")
    hit = {r.function_id for r in some.collect()}
    full = {(r.id1, r.id2, r.dot) for r in similarity.raw_pairs(df).collect()}
    assert {(r.id1, r.id2, r.dot) for r in similarity.raw_pairs(df, some).collect()} == {p for p in full if p[0] in hit or p[1] in hit}


def test_upsert_and_delete(spark, vectors):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v) for r in similarity.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    df, rows = vectors
    funcs = df.select("collection", "function_id", F.split_part("function_id", F.lit(":"), F.lit(4)).alias("file_md5")).distinct()
    sims = similarity.build_pairs(df, funcs, min_score=0.0)
    left = state.delete_file({"functions": funcs, "vec": df, "sims": sims}, "m1", "main")
    assert left["functions"].where("file_md5 = 'm1'").count() == left["vec"].where("function_id like '%:m1:%'").count() == left["sims"].where("md5_1 = 'm1' or md5_2 = 'm1'").count() == 0
    assert left["sims"].count() == sims.where("md5_1 <> 'm1' and md5_2 <> 'm1'").count() > 0
    assert state.delete_prefix(funcs, "function_id", "idx:").count() == 0
    assert stats.sample_rows(funcs, 5, "function_id", 1).collect() == stats.sample_rows(funcs.repartition(7), 5, "function_id", 1).collect()
    vec, indexed = state.clear_features(df, funcs, state.targets_of(funcs, md5="m2"))
    assert vec.where("function_id like '%:m2:%'").count() == indexed.where("file_md5 = 'm2'").count() == 0


def test_empty_tables(spark):
    vec = spark.createDataFrame([], "collection string, function_id string, hash string, tf long")
    funcs = spark.createDataFrame([], "collection string, function_id string, file_md5 string")
    assert similarity.build_pairs(vec, funcs).count() == 0
    assert jobs.job_stats(spark.createDataFrame([], "status string, speed double, total_items long, processed_items long")).first().global_eta == 0.0
    assert ingest.collections(spark.createDataFrame([], "collection string, n_functions long, entry_date long")).count() == 0


def test_queue_order(spark):
    rows = [("b", "pending", 2), ("a", "pending", 2), ("c", "cancelled", 1), ("d", "pending", 1)]
    got = jobs.runnable(spark.createDataFrame(rows, "id string, status string, created_at long")).collect()
    assert [r.id for r in got] == ["d", "a", "b"]


def plain_pairs(rows, algo, least):
    """Scores of all pairs by definition."""
    vec = {}
    for _, fid, h, tf in rows:
        vec.setdefault(fid, {})[h] = tf
    out = {}
    for a in vec:
        for b in vec:
            if a > b and set(vec[a]) & set(vec[b]):
                dot, low = sum(vec[a][h] * vec[b].get(h, 0) for h in vec[a]), sum(min(vec[a][h], vec[b].get(h, 0)) for h in vec[a])
                n2 = [math.sqrt(sum(x * x for x in vec[i].values())) for i in (a, b)]
                value = dot / (n2[0] * n2[1]) if algo == "unweighted_cosine" else low / (sum(vec[a].values()) + sum(vec[b].values()) - low)
                if value >= least:
                    out[a, b] = round(value, 4)
    return out


@pytest.mark.parametrize("algo,least", [("unweighted_cosine", 0.1), ("unweighted_cosine", 0.3), ("unweighted_cosine", 0.8), ("jaccard", 0.3), ("jaccard", 0.6)])
def test_cut_vectors_and_hot_features_lose_no_pair(spark, monkeypatch, algo, least):
    rng = random.Random(int(least * 10))
    monkeypatch.setattr(similarity, "HOT", 7)
    monkeypatch.setattr(similarity, "CUT_FROM", 0)
    rows = []
    for i in range(40):
        for h in {*rng.sample(["hot1", "hot2", "hot3"], 2), *(f"h{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 25)))}:
            rows.append(("main", f"f{i:02}", h, rng.choice([1, 1, 1, 2, 5])))
    df = spark.createDataFrame(rows, "collection string, function_id string, hash string, tf long")
    want = plain_pairs(rows, algo, least)
    got = {(r.id1, r.id2): r.score for r in similarity.scored_pairs(df, algo, least).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    targets = df.where("function_id < 'f10'").select("collection", "function_id").distinct()
    some = {(r.id1, r.id2) for r in similarity.scored_pairs(df, algo, least, targets).collect()}
    assert some == {k for k in want if min(k) < "f10"}


@pytest.mark.parametrize("algo,cut_from", [("unweighted_cosine", 0), ("unweighted_cosine", 10**9), ("jaccard", 10**9)])
def test_pairs_by_parts_lose_no_pair(spark, monkeypatch, algo, cut_from):
    """Matches of many functions are added up for some functions at a time."""
    rng, seen, by_parts = random.Random(7), [], similarity._by_parts
    for name, value in (("HOT", 7), ("CUT_FROM", cut_from), ("MATCHED", 150), ("PER_ROW", 0)):
        monkeypatch.setattr(similarity, name, value)
    monkeypatch.setattr(similarity, "_by_parts", lambda *a: seen.append((a[3], a[4] if len(a) > 4 else 1)) or by_parts(*a))
    rows = [("main", f"f{i:02}", h, rng.choice([1, 1, 2, 5])) for i in range(24) for h in sorted({*rng.sample(["hot1", "hot2", "hot3"], 2), *(f"h{rng.randrange(30)}" for _ in range(6))})]
    df = spark.createDataFrame(rows, "collection string, function_id string, hash string, tf long")
    want = plain_pairs(rows, algo, 0.3)
    got = {(r.id1, r.id2): r.score for r in similarity.scored_pairs(df, algo, 0.3).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-4 for k in want)
    assert dict(seen)["pair-candidates"] > 1
    targets = df.where("function_id < 'f10'").select("collection", "function_id").distinct()
    assert {(r.id1, r.id2) for r in similarity.scored_pairs(df, algo, 0.3, targets).collect()} == {k for k in want if min(k) < "f10"}


def test_shared_numbers_fall_back_to_names(spark, monkeypatch):
    monkeypatch.setattr(similarity.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [("main", f"f{i}", f"h{j}", 1) for i in range(4) for j in range(i + 1)]
    df = spark.createDataFrame(rows, "collection string, function_id string, hash string, tf long")
    got = {(r.id1, r.id2): r.score for r in similarity.scored_pairs(df).collect()}
    assert got.keys() == plain_pairs(rows, "unweighted_cosine", 0.0).keys()


def test_values_without_sql(spark):
    import time

    r = one(spark, now=values.now_ms(), id=values.new_id(), day=values.shown_time(F.lit(86_400_000).cast("long")), short=values.shortened(F.lit("abcdef"), 3))
    assert abs(r.now - time.time() * 1000) < 600_000 and len(r.id) == 36 and r.day == "1970-01-02 00:00:00" and r.short == "abc"
    bad = one(spark, year=values.millis_text(F.lit("2026")), month=values.millis_text(F.lit("2026-05")), day=values.millis_text(F.lit("2026-05-01")), full=values.millis_text(F.lit("2026-03-26T11:48:07.851317Z")))
    assert (bad.year, bad.month) == (0, 0) and bad.day == 1_777_593_600_000 and bad.full == 1_774_525_687_851


def test_pipeline_stages(spark):
    rows = [("a", "p", 1, "completed"), ("b", "p", 2, "pending"), ("c", "p", 3, "pending"), ("d", "q", 1, "failed"), ("e", "q", 2, "pending"), ("f", "r", 1, "running"), ("g", "r", 2, "pending")]
    tasks = spark.createDataFrame(rows, "id string, parent_id string, stage long, status string")
    assert [r.id for r in jobs.next_stages(tasks).collect()] == ["b"]
    results = spark.createDataFrame([("f", True), ("f", False), ("b", True)], "id string, ok boolean")
    assert {r.id: r.status for r in jobs.finished(tasks, results).collect()} == {**{r[0]: r[3] for r in rows}, "f": "failed"}


def test_enrich_without_metadata(spark):
    """A pair whose functions or pair document are gone gets defaults."""
    pairs = spark.createDataFrame([("s1", "main", "idx:main:func:m:aa", "idx:main:func:m:bb", 0.5)], "sid string, collection string, id1 string, id2 string, score double")
    funcs = spark.createDataFrame([("main", "idx:main:func:m:aa", "one", "f.bin", ["t"])], "collection string, function_id string, function_name string, file_name string, tags array<string>")
    r = search.enrich(pairs, funcs).first()
    assert (r.name1, r.name2) == ("one", "bb") and r.meta1.tags == ["t"] and r.meta2.tags == [] and r.meta2.file_name == r.meta1.language_id == "N/A"
    assert search.enrich(pairs.limit(0), funcs).count() == 0


def test_search_totals(spark):
    sims = spark.createDataFrame([("main", "unweighted_cosine", f"s{i}", i / 10) for i in range(8)], "collection string, algo string, sid string, score double")
    r = search.pool_status(sims, "main", min_score=0.2, pool_limit=6).first()
    assert (r.pool, r.candidates, r.pool_truncated) == (6, 6, True)
    r = search.pool_status(sims, "main", min_score=0.2, pool_limit=10**9).first()
    assert (r.pool, r.candidates, r.pool_truncated) == (1_000_000, 6, False)
    page = search.with_total(search.page(sims, [sims.sid], 6, 5), sims).collect()
    assert [(x.sid, x.total) for x in page] == [("s6", 8), ("s7", 8)]


def test_scratch_folders(spark):
    from types import SimpleNamespace

    from simquarry.sources import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.scratch(cluster, "x")
    assert scratch.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch.qualified(spark, "/tmp/x").startswith("file:///tmp/x") and scratch.qualified(spark, "s3a://b/x") == "s3a://b/x"
