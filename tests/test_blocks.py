"""The pair build by blocks against plain sums."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest

from simquarry.operators import blocks, similarity
from simquarry.plans import catalog, ingest_queries  # noqa: F401  (registers its queries)
from simquarry.sources import tables
from simquarry.sources.scratch import shared_dir

SCHEMA = "collection string, function_id string, hash string, tf long"


def plain(rows):
    """{(collection, greater id, lesser id): (dot, least sum, greater's n2, lesser's total)}"""
    vec = defaultdict(Counter)
    for c, f, h, tf in rows:
        vec[c, f][h] += tf
    out = {}
    for (c, x), a in vec.items():
        for (d, y), b in vec.items():
            both = [h for h in a if h in b and h is not None]
            if c == d and x > y and both:
                out[c, x, y] = (sum(a[h] * b[h] for h in both), sum(min(a[h], b[h]) for h in both), sum(v * v for v in a.values()), sum(b.values()))
    return out


@pytest.mark.parametrize("held", [3, 40, 1 << 20])
def test_block_pairs(spark, monkeypatch, held):
    """Collections that share ids and features, a feature of every function, a feature that is null
    and functions with more matches than are held at a time."""
    rows = [(c, f"f{k}", h, 1 + k % 3) for c in ("x", "y") for k in range(23) for h in ["all", f"m{k % 4}", f"own{k}", f"p{k % 9}"]] + [("x", "f1", None, 5), ("x", "f2", None, 5)]
    monkeypatch.setattr(blocks, "GROUP_ROWS", 30)
    vec = spark.createDataFrame(rows, SCHEMA)
    a = blocks._Side  # the parts of a side are held to `held` matches
    for dot in (True, False):
        got = blocks.block_pairs(vec, dot)
        found = {(r.collection, r.id1, r.id2): (r[7], r.n2_a, r.total_b) for r in got.collect()}
        assert got.count() == len(found)
        assert found == {k: (v[0] if dot else v[1], v[2], v[3]) for k, v in plain(rows).items()}
    path = f"{similarity.written(vec.where('hash is not null').selectExpr('*', 'xxhash64(collection, hash) key', '0 block'), 'side').inputFiles()[0].rsplit('/', 1)[0]}"
    spark.read.parquet(path).write.partitionBy("block").parquet(path + "-parted")
    side = a(path + "-parted", [0])
    monkeypatch.setattr(blocks, "HELD", held)
    sums = [(x, y, int(n)) for fa, fb, shared in blocks._sums(side, side, True, True) for x, y, n in zip(fa, fb, shared)]
    name = lambda k: (side.collection[int(k)].as_py(), side.ids[int(k)].as_py())
    assert Counter((name(x)[0], frozenset((name(x)[1], name(y)[1])), n) for x, y, n in sums) == Counter((c, frozenset((x, y)), v[0]) for (c, x, y), v in plain(rows).items())


def test_no_vectors(spark):
    assert blocks.block_pairs(spark.createDataFrame([], SCHEMA), True).count() == 0


@pytest.mark.parametrize("name", ["pair_cosine", "pair_jaccard"])
def test_pairs_are_not_shuffled(spark, data, name):
    assert "Exchange hash" not in catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_hashes_that_meet(spark, monkeypatch):
    """Then the join on the features themselves builds the pairs."""
    vec = spark.createDataFrame([("x", "f1", "a", 1), ("x", "f2", "a", 1)], SCHEMA)
    monkeypatch.setattr(similarity, "block_pairs", lambda *_: None)
    assert [tuple(r) for r in similarity.scored_pairs(vec).select("id1", "id2", "score").collect()] == [("f2", "f1", 1.0)]


def test_vectors_are_dealt_by_customer_once(spark, data):
    """Lineitems, orders, the customer's rows and customers: the count shares the join's deal."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.customer_vectors(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 4


def test_files_hold_vectors_alone(spark):
    """No key beside the feature, and nothing but the blocks stays; a block that is too large for a
    worker is left to the join."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    path, sizes = blocks.dealt(spark.createDataFrame([("x", f"f{k}", "a", 1) for k in range(9)], SCHEMA))
    assert sum(n for _, n in sizes) == 9
    assert set(spark.read.parquet(path).columns) == {"collection", "function_id", "hash", "tf", "block"}
    assert [p.name for p in set(shared.iterdir()) - before] == [path.rsplit("/", 1)[1]]
    assert blocks.block_pairs((path, [(0, 16 * blocks.GROUP_ROWS + 1)]), True) is None


def test_builds_share_their_blocks(spark, data):
    """Two builds deal the vectors once and leave only their tables, as equal as two builds apart."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    catalog.QUERIES["index_status_algos"](spark, data).collect()
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before) == ["pairs-jaccard", "pairs-unweighted_cosine"]
    v, f = tables.customer_vectors(spark, data), tables.customer_functions(spark, data)
    apart = [similarity.build_pairs(v, f, a, min_score=0.02) for a in similarity.ALGOS]
    both = similarity.build_algos(v, f, min_score=0.02)
    assert sorted(both.collect()) == sorted(apart[0].unionByName(apart[1]).collect()) != []


@pytest.mark.parametrize("algo", similarity.ALGOS)
def test_shared_features_alone_are_joined_as_one(spark, monkeypatch, algo):
    """A copied passage's features become one row of each function, features of one function none;
    scores are as before."""
    rows = [("x", f"f{k}", h, t) for k in range(12) for h, t in [*((f"p{k // 3}-{i}", 1 + k % 2) for i in range(5)), *((f"own{k}-{i}", 1) for i in range(3)), ("all", 1), (f"m{k % 4}", 2)]]
    vec = spark.createDataFrame([*rows, ("x", "f1", None, 1), ("x", "f2", None, 1)], SCHEMA)
    whole = {(r.id1, r.id2): r.score for r in similarity.scored(similarity.raw_pairs(vec), algo, 0.3).collect()}
    monkeypatch.setattr(similarity, "COUNTED", 40)
    shared = similarity._shared(similarity._sides(vec)[0]).collect()
    assert Counter(r.w for r in shared) == {5: 12, 1: 24}
    for cut_from in (0, 10**9):
        monkeypatch.setattr(similarity, "HOT", 5)
        monkeypatch.setattr(similarity, "CUT_FROM", cut_from)
        assert {(r.id1, r.id2): r.score for r in similarity.scored_pairs(vec, algo, 0.3).collect()} == whole != {}
