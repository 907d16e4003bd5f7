"""Hand-computed results over the golden corpus: ingest, pairs, clearing, diff, streaming."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from simquarry.operators import align, features, ingest, search, similarity, state, stats, tags, vectors
from simquarry.sources import upload
from simquarry.streaming import pipeline
from tests import golden


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = golden.write(tmp_path_factory.mktemp("uploads"))
    uploads = upload.read_uploads(spark, folder)
    funcs = ingest.functions(uploads).cache()
    return {"folder": folder, "uploads": uploads, "funcs": funcs, "files": ingest.files(uploads), "vec": ingest.vectors(funcs).cache()}


def short(fid):
    return next(k for k, v in golden.VECTORS.items() if v[1] == fid.rsplit(":", 1)[1])


def scores(corpus, algo, **how):
    out = similarity.build_pairs(corpus["vec"], corpus["funcs"], algo, **{"min_score": 0.0, **how})
    return {frozenset((short(r.id1), short(r.id2))): (r.score, r.is_cross_binary) for r in out.collect()}


def test_ingest(corpus):
    files = {r.file_md5: r for r in corpus["files"].collect()}
    assert {k: v.n_functions for k, v in files.items()} == {"A": 2, "B": 2, "C": 4}
    assert files["A"].file_id == "idx:main:file:A"
    assert corpus["funcs"].where("function_id = 'idx:main:func:A:00401000'").count() == 1
    assert ingest.functions(corpus["uploads"], skip_thunks=True).count() == 7
    batch = {r.batch_uuid: (r.total_files, r.total_functions) for r in ingest.batches(corpus["files"]).collect()}
    assert batch == {"b1": (2, 4), "b2": (1, 4)}
    assert ingest.collections(corpus["files"]).first().total_functions == 8
    assert ingest.global_batches(corpus["files"]).count() == 2
    occ = ingest.feature_occurrences(corpus["funcs"]).where("function_id like '%00401000'").orderBy("pos").collect()
    assert [o.addr_to_token_idx for o in occ] == [[3], [3, 4], [3, 4]]
    assert occ[0].pcode_block is None and occ[1].pcode_block == {"q": "COPY"} and occ[1].addr is None


def test_upload_dump_round_trip(spark, corpus, tmp_path):
    upload.write_uploads(corpus["uploads"], str(tmp_path / "dump"))
    again = spark.read.schema(upload.UPLOAD).json(f"{tmp_path}/dump")
    assert ingest.vectors(ingest.functions(again)).exceptAll(corpus["vec"]).count() == 0
    assert upload.replay(spark, corpus["folder"], 2).count() == 2


def test_statistics(corpus):
    got = {r.hash: (r.tf_score, r.total_tf, r.frequency) for r in vectors.feature_stats(corpus["vec"]).collect()}
    assert got["a"] == (11, 7, 5) and got["b"] == (12, 6, 4) and got["z"][0] == 25
    occ = ingest.feature_occurrences(corpus["funcs"])
    assert vectors.term_frequencies(occ).select("function_id", "hash", "tf").exceptAll(corpus["vec"].select("function_id", "hash", "tf")).count() == 0


def test_scores(corpus):
    cos, jac = scores(corpus, "unweighted_cosine"), scores(corpus, "jaccard")
    assert cos[frozenset(("f1", "f2"))] == (1.0, "false")
    assert cos[frozenset(("f1", "f3"))] == (round(3 / math.sqrt(10), 4), "true") and jac[frozenset(("f1", "f3"))][0] == 0.6667
    assert cos[frozenset(("f1", "f4"))][0] == 0.4472 and jac[frozenset(("f1", "f4"))][0] == 0.2
    assert cos[frozenset(("f1", "f7"))][0] == 0.8944 and jac[frozenset(("f1", "f7"))][0] == 0.3333
    assert not any(p & {"f5", "f6"} for p in cos)
    assert scores(corpus, "nonsense") == {}
    assert all(0 < s <= 1 for s, _ in cos.values())


def test_ties_at_the_boundary_go_by_id(corpus):
    top = similarity.top_k(similarity.scored(similarity.raw_pairs(corpus["vec"]), "unweighted_cosine"), 1)
    best = {short(r.target): short(r.candidate) for r in top.collect()}
    assert best["f7"] == "f8" and best["f8"] == "f7" and best["f4"] == "f3"


def test_incremental_equals_full(spark, corpus):
    v, f = corpus["vec"], corpus["funcs"]
    half = f.where("file_md5 < 'C'")
    none = f.select("collection", "function_id").limit(0)
    first = similarity.build_pairs(v.join(half, ["collection", "function_id"], "left_semi"), half, min_score=0.0)
    pairs, built = similarity.incremental_build(v, f, first, half.select("collection", "function_id"), min_score=0.0)
    full = similarity.build_pairs(v, f, min_score=0.0)
    assert pairs.select("sid", "score").exceptAll(full.select("sid", "score")).count() == 0 and pairs.count() == full.count()
    assert built.count() == 8
    assert similarity.unbuilt(f, none).count() == 8


def test_clear_is_idempotent(corpus):
    sims = similarity.build_pairs(corpus["vec"], corpus["funcs"], min_score=0.0)
    t = state.targets_of(corpus["funcs"], md5="A")
    once = similarity.clear_pairs(sims, t)
    assert once.where("md5_1 = 'A' or md5_2 = 'A'").count() == 0
    assert similarity.clear_pairs(once, t).count() == once.count()
    assert state.delete_collection({"sims": sims}, "main")["sims"].count() == 0


def test_exact_score(corpus, spark):
    ids = {n: f"idx:main:func:{v[0]}:{v[1]}" for n, v in golden.VECTORS.items()}
    wanted = spark.createDataFrame([("main", ids["f1"], ids["f3"]), ("main", ids["f3"], ids["f1"]), ("main", ids["f1"], ids["f5"]), ("main", ids["f1"], ids["f6"])], "collection string, id1 string, id2 string")
    got = {(short(r.id1), short(r.id2)): r for r in similarity.pair_score(corpus["vec"], wanted).collect()}
    assert got["f1", "f3"].unweighted_cosine == got["f3", "f1"].unweighted_cosine == 3 / (math.sqrt(5) * math.sqrt(2))
    assert got["f1", "f5"].jaccard == 0.0 and got["f1", "f6"].jaccard is None
    sims = similarity.build_pairs(corpus["vec"], corpus["funcs"], min_score=0.0)
    assert similarity.cached_pair(sims, wanted, "unweighted_cosine").count() == 1


def test_status_and_tags(spark, corpus):
    f = corpus["funcs"].select("collection", "function_id", "file_md5", "tags").withColumn("user_tags", F.lit(None).cast("array<string>"))
    got = stats.progress(f, f.where("file_md5 = 'C'"), ["collection"]).first()
    assert (got.total, got.built, got.unbuilt, got.ratio) == (8, 4, 4, 50.0)
    wanted = f.where("file_md5 = 'A'").select(F.concat("function_id", F.lit(":meta")).alias("id"), F.lit(" New ").alias("tag"))
    tagged = tags.add_tags(tags.add_tags(f, wanted, "function_id"), wanted, "function_id")
    assert {tuple(r.user_tags) for r in tagged.where("file_md5 = 'A'").collect()} == {("New",)}
    assert tagged.where("file_md5 = 'B' and user_tags is not null").count() == 0
    assert search.query_documents(tagged, tags=["new", "T"]).count() == 2
    empty = spark.createDataFrame([], "collection string, tag string, color string, priority long")
    meta = tags.register(empty, tagged.select("collection", F.explode("user_tags").alias("tag")))
    meta = tags.set_metadata(meta, spark.createDataFrame([("main", "New", "#000000", None), ("main", "idle", None, None)], "collection string, tag string, color string, priority long"))
    counts = {r.tag: (r["count"], r.color, r.priority) for r in tags.tag_counts(meta, {"func": tagged}).collect()}
    assert counts == {"New": (2, "#000000", 0), "idle": (0, "#66d9ef", 0)}
    gone = tags.remove_tags(tagged, wanted, "function_id")
    assert gone.where("size(user_tags) > 0").count() == 0


def test_diff_of_many_pairs_and_sides(spark):
    """Many pairs share a batch, whatever lines they have; a side without lines is all insert or
    delete, and no pair has a group of its own."""
    lines = spark.createDataFrame([("main", f"f{n}", line, f"x{line % 3}") for n in range(40) for line in reversed(range(n % 7))], "collection string, function_id string, line long, identity string")
    wanted = spark.createDataFrame([("main", f"f{n}", "main", f"f{n + 3}") for n in range(37)], "collection1 string, id1 string, collection2 string, id2 string")
    found = align.aligned_diff(lines, wanted)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in found.orderBy("pair_id", "row_idx").collect():
        rows.setdefault(r.pair_id, []).append((r.tag, r.chunk_id, r.l_line, r.r_line))
    text = lambda n: [f"x{line % 3}" for line in range(n % 7)]
    assert rows == {f"f{n}|f{n + 3}": align.opcodes(text(n), text(n + 3)) for n in range(37) if text(n) or text(n + 3)}


def test_diff(spark, corpus):
    tokens, occ = ingest.tokens(corpus["funcs"]), ingest.feature_occurrences(corpus["funcs"])
    hashes = align.token_features(occ)
    lines = align.line_identities(tokens, hashes)
    f1 = [r.identity for r in lines.where("function_id like '%00401000'").orderBy("line").collect()]
    assert f1 == ["TEXT:int x", "FEATURES:a,b", "TEXT:", "TEXT:returnx"]
    wanted = spark.createDataFrame([("main", "idx:main:func:A:00401000", "main", "idx:main:func:A:00401100")], "collection1 string, id1 string, collection2 string, id2 string")
    rows = [(r.tag, r.l_line, r.r_line) for r in align.aligned_diff(lines, wanted).orderBy("row_idx").collect()]
    assert rows == [("equal", 1, 1), ("equal", 2, 2), ("delete", 3, None), ("equal", 4, 3)]
    common = align.common_hashes(corpus["vec"], wanted)
    assert common.first().hashes == ["a", "b"]
    other = common.select(F.col("collection1").alias("collection"), F.col("id1").alias("function_id"), "hashes")
    cls = {r.idx: r.diff_class for r in align.token_classes(tokens, hashes, other).where("function_id like '%00401000'").collect()}
    assert cls[3] == "match" and cls[0] == ""
    view = align.code_view(tokens, hashes, align.line_addresses(corpus["funcs"])).where("function_id like '%00401000' and line = 1").first()
    assert view.line_idx == 2 and view.address == "00401000L1" and view.tokens[0].diff_class == "diff-unique"
    feats = align.feature_view(occ, tokens).where("function_id like '%00401000' and hash = 'a' and type = 'DATA_FLOW'").first()
    assert [x.text for x in feats.lines] == ["x=1"]
    page = features.with_context(features.search_features(corpus["vec"]), vectors.last_context(occ), tokens)
    assert page.where("hash = 'a'").first().line_text in ("x=1", "y=2")
    det = features.feature_details(corpus["vec"], vectors.last_context(occ), occ, "a").orderBy("function_id").collect()
    assert len(det) == 5 and det[0].total_occurrences == 7


def test_opcodes_follow_difflib():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        rows = align.opcodes(a, b)
        assert [r[2] for r in rows if r[2]] == list(range(1, len(a) + 1)) and [r[3] for r in rows if r[3]] == list(range(1, len(b) + 1))
        assert len({r[1] for r in rows}) == len(difflib.SequenceMatcher(None, a, b).get_opcodes())
        assert all(a[r[2] - 1] == b[r[3] - 1] for r in rows if r[0] == "equal")


@pytest.mark.parametrize("compact", [16, 2])
def test_stream_equals_batch(spark, corpus, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(pipeline, "COMPACT", compact)
    root = f"file://{tmp_path}/state"
    for _ in range(2):  # the second run finds nothing new
        pipeline.run_stream(spark, corpus["folder"], root, f"{tmp_path}/cp", files_per_batch=1, min_score=0.0)
    got = pipeline.read_state(spark, root, "sims").select("sid", "score")
    full = similarity.build_pairs(corpus["vec"], corpus["funcs"], min_score=0.0).select("sid", "score")
    assert got.exceptAll(full).count() == 0 and got.count() == full.count()
    assert pipeline.read_state(spark, root, "built").count() == 8
    assert (tmp_path / "state" / "sims-snapshots").exists() == (compact == 2)
    assert pipeline.read_state(spark, root, "vec_tf", 1).count() < pipeline.read_state(spark, root, "vec_tf").count() == corpus["vec"].count()
