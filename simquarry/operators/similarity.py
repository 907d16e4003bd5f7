"""Similarity pairs: the inverted-index self-join, top-K builds, exact scores, status, clearing.

`unweighted_cosine` is TF cosine without IDF; `jaccard` is the generalised Jaccard coefficient of
the tf multisets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import pair_id
from ..sources.scratch import collect_garbage, drop, freed, scratch, written
from .blocks import block_pairs, dealt
from .vectors import norms

ALGOS = ("unweighted_cosine", "jaccard")
TOP_K, MIN_SCORE = 1000, 0.3
#: Functions of a feature from which on its pairs are dealt to several tasks.
HOT = 20_000
#: Rows of the vectors whose features are counted at a time, about.
COUNTED = 16_000_000
#: Matches of features that are shuffled at a time: MATCHED, or PER_ROW for each row of the vectors if that is more.
MATCHED, PER_ROW = 8_000_000, 4
#: Vectors are cut into head and tail for scores from TAIL_FROM on (below it, tails are all but
#: empty) where the features make CUT_FROM pairs or more for each row of the vectors.
TAIL_FROM, CUT_FROM = 0.25, 20
#: What either score is worked out from.
_NEEDS = {"unweighted_cosine": ("dot", "n2"), "jaccard": ("least_sum", "total")}


def score(algo: str, dot: Column, least: Column, n2_a: Column, n2_b: Column, total_a: Column, total_b: Column) -> Column:
    if algo == "unweighted_cosine":
        return dot / (F.sqrt(n2_a.cast("double")) * F.sqrt(n2_b.cast("double")))
    if algo == "jaccard":
        union = total_a + total_b - least
        return F.when(union > 0, least / union).otherwise(F.lit(0.0))
    return F.lit(0.0)


def _sides(vec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the vectors as a table (collection, hash, fn, tf, n2, total), in which a
    number stands for each function and every feature carries its function's norms, and the
    functions' names (fn, collection, function_id, n2, total).

    The norms come from a window over a function's rows, which spills, so no row holds a whole
    vector. The numbers are hashes; that no two functions share one is checked, and names stand
    in for numbers where some do."""
    w = Window.partitionBy("collection", "function_id")
    wide = vec.select("collection", "function_id", "hash", "tf", F.sum(F.col("tf") * F.col("tf")).over(w).alias("n2"), F.sum("tf").over(w).alias("total"), F.xxhash64("collection", "function_id").alias("fn"))
    wide = written(wide, "pair-sides")
    collect_garbage(vec.sparkSession)
    names = written(wide.select("fn", "collection", "function_id", "n2", "total").distinct(), "pair-names")
    if not names.groupBy("fn").count().where("count > 1").isEmpty():
        name = F.concat_ws("\x00", "collection", "function_id")
        wide, names = wide.withColumn("fn", name), names.withColumn("fn", name)
    return wide.drop("function_id"), names


def _dealt(rows: DataFrame, hot: DataFrame | None, first: bool) -> DataFrame:
    """Rows with the cells of a grid (i, j) that their feature's pairs are dealt to: a row of block
    x goes to all cells (x, *) as the first side, to all (*, x) as the second, so two rows meet in
    one cell. Features that aren't hot have the one cell (0, 0)."""
    if hot is None:
        return rows.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    rows = rows.join(hot, ["collection", "hash"], "left").withColumn("block", F.pmod(F.xxhash64("fn"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    i, j = ("block", "other") if first else ("other", "block")
    return rows.withColumns({"i": F.col(i), "j": F.col(j)}).drop("block", "other", "blocks")


def _by_parts(rows: DataFrame, number: Column, step, name: str, parts: int | None = None) -> DataFrame:
    """step(part) for `parts` parts (of about COUNTED rows if not given) by `number`, one after
    another: each part's shuffle is gone before the next."""
    spark = rows.sparkSession
    parts = parts or max(1, math.ceil(rows.count() / COUNTED))
    path = scratch(spark, name)
    for k in range(parts):
        out = step(rows.where(F.pmod(number, F.lit(parts)) == k))
        with freed(spark):
            out.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _shared(side: DataFrame) -> DataFrame:
    """The rows whose feature another function of the collection has too, with `df`, the number of
    functions that have it, and `w`, the number of features that a row stands for. Norms are in the
    rows already, so features of one function, most of them in texts, go no further.

    Features that the same functions have, each as often (the shingles of a copied passage), become
    one. They are told by a hash over functions and counts, which is checked: where each function of
    a hash has w rows of one count, and there are df of them, it has all w features."""
    w = Window.partitionBy("collection", "hash")
    count = lambda part: part.withColumns({"df": F.count("*").over(w), "sig": F.bit_xor(F.xxhash64("fn", "tf")).over(w)}).where("df > 1")
    side = side.where("collection is not null and hash is not null")
    rows = _by_parts(side, F.xxhash64("collection", "hash"), count, "pair-shared")
    merge = lambda part: part.groupBy("collection", "sig", "fn").agg(*(F.max(c).alias(c) for c in ("tf", "n2", "total", "df")), F.min("tf").alias("tf_"), F.min("df").alias("df_"), F.count("*").alias("w"))
    merged = _by_parts(rows, F.col("sig"), merge, "pair-merged")
    each = merged.groupBy("collection", "sig").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{k}") for c in ("df", "w") for k, f in (("least", F.min), ("most", F.max))), F.max(F.col("tf") - F.col("tf_") + F.col("df") - F.col("df_")).alias("off"))
    if not each.where("n <> df_least or df_least <> df_most or w_least <> w_most or off <> 0").isEmpty():
        return rows.drop("sig").withColumn("w", F.lit(1).cast("long"))
    return merged.withColumnRenamed("sig", "hash").drop("tf_", "df_")


def _cut(side: DataFrame, algo: str, least: float) -> DataFrame:
    """The sides with `tail` and `rest`. A function's tail is its most frequent features, as many
    as carry less than the share `least` of its length (cosine) or total (Jaccard); `rest` is what
    they carry. Two functions that share tail features alone score below `least` squared, or below
    `least`: such pairs are never wanted, and the most frequent features are in most tails."""
    carried, whole = (F.col("tf") * F.col("tf") * F.col("w"), least * least * F.col("n2")) if algo == ALGOS[0] else (F.col("tf") * F.col("w"), least * F.col("total"))
    w = Window.partitionBy("fn").orderBy(F.col("df").desc(), F.col("hash")).rowsBetween(Window.unboundedPreceding, 0)
    side = side.withColumn("sum", F.sum(carried).over(w))
    side = side.withColumn("tail", F.col("sum") < whole * (1 - 1e-12)).withColumn("rest", F.max(F.when(F.col("tail"), F.col("sum")).otherwise(0)).over(Window.partitionBy("fn")))
    return written(side.drop("df", "sum"), "pair-cut")


def _may_reach(algo: str, least: float) -> Column:
    """Whether a pair, whose sums lack what two tails share, may still reach the score."""
    if algo == ALGOS[0]:
        most = F.col("dot") + F.sqrt(F.col("rest_a").cast("double") * F.col("rest_b"))
        return most >= least * F.sqrt(F.col("n2_a").cast("double") * F.col("n2_b")) * (1 - 1e-9)
    most = F.col("least_sum") + F.least("rest_a", "rest_b")
    return most * (1 + least) >= least * (F.col("total_a") + F.col("total_b")) * (1 - 1e-9)


def _numbered_pairs(vec: DataFrame, targets: DataFrame | None, max_df: int | None, algo: str | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, names): raw_pairs by function number (a, b), each pair once. With `algo` and `least`,
    pairs that can't reach that score may be left out; the others' sums are exact."""
    side, names = _sides(vec)
    hot, cut, times, parts = None, False, F.lit(1), 1
    # A collection of HOT functions at most has no feature of more; only larger ones are measured.
    if max_df is not None or names.count() > HOT:
        side = _shared(side)
        times = F.col("w")
        if max_df is not None:
            side = side.where(F.col("df") <= max_df)
        load = side.agg(F.max("df").alias("most"), F.sum((F.col("df") - 1) / 2).alias("pairs"), F.count("*").alias("rows")).first()
        if (load["most"] or 0) > HOT:
            # At most a row for each HOT rows of the vectors; Spark broadcasts it where it is small.
            hot = side.where(F.col("df") > HOT).select("collection", "hash", F.ceil(F.col("df") / HOT).cast("long").alias("blocks")).distinct()
        parts = max(1, math.ceil((load["pairs"] or 0) / max(MATCHED, PER_ROW * (load["rows"] or 0))))
        cut = algo in ALGOS and least >= TAIL_FROM and (load["pairs"] or 0) >= CUT_FROM * (load["rows"] or 1)
        if cut:
            side = _cut(side, algo, least)
    needed = _NEEDS.get(algo, ("dot", "least_sum", "n2", "total"))
    kept = [c for c in ("n2", "total") if c in needed or cut] + (["tail", "rest"] if cut else [])
    own_cols = ["fn", "tf", *kept]
    cols = lambda k: ["collection", "hash", "i", "j", *(["w"] if k == "a" and "w" in side.columns else []), *(F.col(c).alias(f"{c}_{k}") for c in own_cols)]
    on = ["collection", "hash", "i", "j"] if hot is not None else ["collection", "hash"]
    own = other = side
    met = F.col("fn_a") > F.col("fn_b")
    if targets is not None:
        flag = names.join(targets.select("collection", "function_id").distinct(), ["collection", "function_id"], "left_semi").select("fn", F.lit(True).alias("t"))
        own, other = side.join(flag, "fn", "left_semi"), side.join(flag, "fn", "left")
        # A pair of two targets comes from its greater side only.
        met = (F.col("fn_a") != F.col("fn_b")) & (F.col("t").isNull() | met)
    sums = [x for name, x in (("dot", F.sum(F.col("tf_a") * F.col("tf_b") * times)), ("least_sum", F.sum(F.least("tf_a", "tf_b") * times))) for x in [x.alias(name)] if name in needed]
    norms_ = [F.max(f"{c}_{k}").alias(f"{c}_{k}") for c in kept if c != "tail" for k in ("a", "b")]

    def summed(own: DataFrame) -> DataFrame:
        both = _dealt(own, hot, True).select(*cols("a")).join(_dealt(other, hot, False).select(*cols("b"), *(["t"] if targets is not None else [])), on).where(met)
        if cut:
            both = both.where("not (tail_a and tail_b)")
            if algo == ALGOS[1]:  # totals that differ too much can't overlap enough
                both = both.where(F.least("total_a", "total_b") >= least * F.greatest("total_a", "total_b") * (1 - 1e-12))
        pairs = both.groupBy("fn_a", "fn_b").agg(*sums, *norms_)
        if cut:
            return pairs.where(_may_reach(algo, least)).drop("rest_a", "rest_b")
        return _reaching(pairs, algo, least) if algo in ALGOS and parts > 1 else pairs

    # The matches of many functions are shuffled for some functions at a time.
    pairs = _by_parts(own, F.xxhash64("fn"), summed, "pair-candidates", parts) if cut or parts > 1 else summed(own)
    if not cut:
        return pairs, names
    # The pairs that are left get what their tails share.
    tails = side.where("tail")
    tail = lambda k: tails.select(F.col("fn").alias(f"fn_{k}"), "hash", *(["w"] if k == "a" else []), F.col("tf").alias(f"tf_{k}"))
    total = needed[0]  # a cut has an algorithm, which needs one sum
    more = pairs.select("fn_a", "fn_b").join(tail("a"), "fn_a").join(tail("b"), ["fn_b", "hash"]).groupBy("fn_a", "fn_b").agg(*sums).withColumnRenamed(total, "more")
    out = pairs.join(more, ["fn_a", "fn_b"], "left").withColumn(total, F.col(total) + F.coalesce("more", F.lit(0)))
    return out.drop("more"), names


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with their functions' names and norms: id1 is the greater id, whose norms are those
    of a."""
    end = lambda k, *more: names.select(F.col("fn").alias(f"fn_{k}"), *more, F.struct("function_id", "n2", "total").alias(k))
    rest = [c for c in pairs.columns if c in ("dot", "least_sum", "raw")]
    out = pairs.select("fn_a", "fn_b", *rest).join(end("a", "collection"), "fn_a").join(end("b"), "fn_b")
    first = F.col("a.function_id") > F.col("b.function_id")
    one, two = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    out = out.select("collection", one.alias("a"), two.alias("b"), *rest)
    norms_ = [F.col(f"{k}.{c}").alias(f"{c}_{k}") for c in ("n2", "total") for k in ("a", "b")]
    return out.select("collection", F.col("a.function_id").alias("id1"), F.col("b.function_id").alias("id2"), *norms_, *rest)


def raw_pairs(vec: DataFrame, targets: DataFrame | None = None, max_df: int | None = None) -> DataFrame:
    """Every two functions of a collection that share a feature: dot product, sum of minima,
    norms and totals. id1 is the greater id.

    The sides carry their norms, so the pairs need no join after the one on the feature, and are
    added up under numbers, not names. The pairs of a feature that more than HOT functions have are
    dealt to a grid of cells. With `targets` (collection, function_id), pairs without a target are
    never formed: the target side is the small one. `max_df` drops features of more functions (off
    by default)."""
    return _named(*_numbered_pairs(vec, targets, max_df))


def _reaching(pairs: DataFrame, algo: str, min_score: float) -> DataFrame:
    """Pairs whose unrounded score is positive and at least `min_score`."""
    value = _raw(pairs, algo)
    return pairs.where((value >= min_score) & (value > 0))


def _raw(pairs: DataFrame, algo: str) -> Column:
    col = lambda c: F.col(c) if c in pairs.columns else F.lit(None)  # noqa: E731  (not needed by the algorithm)
    return score(algo, *(col(c) for c in ("dot", "least_sum", "n2_a", "n2_b", "total_a", "total_b")))


def _above(pairs: DataFrame, algo: str, min_score: float) -> DataFrame:
    """_reaching pairs with `raw`, the unrounded score."""
    return _reaching(pairs, algo, min_score).withColumn("raw", _raw(pairs, algo)).drop("dot", "least_sum")


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.select("collection", "id1", "id2", F.round("raw", 4).alias("score"), F.col("total_a").alias("feat_count1"), F.col("total_b").alias("feat_count2"), F.least("total_a", "total_b").alias("min_features"))


def scored(pairs: DataFrame, algo: str, min_score: float = 0.0) -> DataFrame:
    """collection, id1, id2, score (4 decimals), feat_count1, feat_count2, min_features of the
    pairs whose unrounded score is positive and at least `min_score`."""
    return _shown(_above(pairs, algo, min_score))


def scored_pairs(vec: DataFrame, algo: str = ALGOS[0], min_score: float = 0.0, targets: DataFrame | None = None, max_df: int | None = None, blocks: tuple | None = None) -> DataFrame:
    """scored(raw_pairs(...)), but for the work on pairs below the threshold: features that lie in
    both functions' tails aren't joined, and other pairs are dropped before the names are. Where no
    tails help and all functions are asked for, pairs are added up by blocks, without a shuffle;
    `blocks` is what dealt(vec) made before, if it did."""
    if targets is None and max_df is None and algo in ALGOS and min_score < TAIL_FROM:
        whole = block_pairs(blocks or vec, algo == ALGOS[0], min_score)
        if whole is not None:
            return _shown(_above(whole, algo, min_score))
    pairs, names = _numbered_pairs(vec, targets, max_df, algo, min_score)
    return _shown(_named(_above(pairs, algo, min_score), names))


def _ranked(pairs: DataFrame, k: int, targets: DataFrame | None) -> DataFrame:
    """The pairs once for each end, with target, candidate and rank, where the rank is k at most.
    One pass over the pairs: a row is turned into its two ends."""
    end = lambda t, c: F.struct(F.col(t).alias("target"), F.col(c).alias("candidate"))
    both = pairs.select("*", F.inline(F.array(end("id1", "id2"), end("id2", "id1"))))
    if targets is not None:
        both = both.join(targets.select("collection", F.col("function_id").alias("target")).distinct(), ["collection", "target"], "left_semi")
    w = Window.partitionBy("collection", "target").orderBy(F.col("score").desc(), F.col("candidate"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(pairs: DataFrame, k: int = TOP_K, targets: DataFrame | None = None) -> DataFrame:
    """(target, candidate, score, rank): each target's k best, ties by candidate id."""
    ranked = _ranked(pairs.select("collection", "id1", "id2", "score"), k, targets)
    return ranked.select("collection", "target", "score", "candidate", F.col("rank").cast("long").alias("rank"))


def build_pairs(vec: DataFrame, functions: DataFrame, algo: str = ALGOS[0], k: int = TOP_K, min_score: float = MIN_SCORE, targets: DataFrame | None = None, blocks: tuple | None = None) -> DataFrame:
    """The pair table of a build: the union of the targets' top-k lists, one row per pair.

    `targets` restricts the build (incremental builds pass the functions that aren't built);
    candidates are all functions. The rank uses the rounded score, the threshold the exact one."""
    found = scored_pairs(vec, algo, min_score, targets, blocks=blocks)
    # A pair that is in both ends' lists comes twice, with the same values.
    out = _ranked(found, k, targets).groupBy("collection", "id1", "id2").agg(*(F.max(c).alias(c) for c in ("score", "feat_count1", "feat_count2", "min_features")))
    md5 = functions.select("collection", "function_id", "file_md5")
    out = out.join(md5.select("collection", F.col("function_id").alias("id1"), F.col("file_md5").alias("md5_1")), ["collection", "id1"], "left")
    out = out.join(md5.select("collection", F.col("function_id").alias("id2"), F.col("file_md5").alias("md5_2")), ["collection", "id2"], "left")
    return out.select(
        pair_id(F.col("collection"), F.lit(algo), F.col("id1"), F.col("id2")).alias("sid"), "collection", F.lit(algo).alias("algo"), "id1", "id2", "score",
        F.coalesce("md5_1", F.lit("unknown")).alias("md5_1"), F.coalesce("md5_2", F.lit("unknown")).alias("md5_2"), "feat_count1", "feat_count2", "min_features",
        F.when(F.coalesce("md5_1", F.lit("unknown")) != F.coalesce("md5_2", F.lit("unknown")), "true").otherwise("false").alias("is_cross_binary"))


def build_algos(vec: DataFrame, functions: DataFrame, algos: tuple[str, ...] = ALGOS, k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """The pair tables of builds in several algorithms. The vectors are dealt to blocks once, and
    each table is written before the next is built, so one build's shuffles are on disk at a time."""
    blocks = dealt(vec) if min_score < TAIL_FROM else None
    out = None
    for algo in algos:
        built = written(build_pairs(vec, functions, algo, k, min_score, blocks=blocks), "pairs-" + algo)
        collect_garbage(vec.sparkSession)
        out = built if out is None else out.unionByName(built)
    if blocks:
        drop(vec.sparkSession, blocks[0])
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str | None = None) -> DataFrame:
    """Old and new rows, the new ones in place of old ones with the same keys."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    order = [F.col("__v").desc(), *([F.col(stamp).desc()] if stamp else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__v")


def unbuilt(functions: DataFrame, built: DataFrame) -> DataFrame:
    return functions.join(built.select("collection", "function_id"), ["collection", "function_id"], "left_anti")


def incremental_build(vec: DataFrame, functions: DataFrame, sims: DataFrame, built: DataFrame, algo: str = ALGOS[0], k: int = TOP_K, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(pairs, built) after building every function that isn't built; functions without
    features become built too."""
    todo = unbuilt(functions, built)
    pairs = upsert(sims, build_pairs(vec, functions, algo, k, min_score, todo), ["collection", "algo", "id1", "id2"])
    return pairs, built.select("collection", "function_id").unionByName(todo.select("collection", "function_id"))


def clear_pairs(sims: DataFrame, targets: DataFrame, algo: str | None = None) -> DataFrame:
    """`sims` without the pairs (of `algo`, or of all) that touch a target function; one pass, in
    which either end is looked up."""
    t = targets.select("collection", "function_id").distinct()
    out = sims
    for i in (1, 2):
        out = out.join(t.select("collection", F.col("function_id").alias(f"id{i}"), F.lit(True).alias(f"__t{i}")), ["collection", f"id{i}"], "left")
    touched = F.col("__t1").isNotNull() | F.col("__t2").isNotNull()
    if algo is not None:
        touched = touched & (F.col("algo") == algo)
    return out.where(~touched).select(*sims.columns)


def rebuild(vec: DataFrame, functions: DataFrame, sims: DataFrame, built: DataFrame, targets: DataFrame, algo: str = ALGOS[0], **how) -> tuple[DataFrame, DataFrame]:
    """Clear the targets, then build them again."""
    left = clear_pairs(sims, targets, algo)
    return incremental_build(vec, functions, left, unbuilt(built, targets), algo, **how)


def involves(sims: DataFrame) -> DataFrame:
    """The pair graph's edges: one row for each end of each pair."""
    end = lambda i: sims.select("collection", "algo", "sid", F.col(f"id{i}").alias("function_id"), F.col(f"md5_{i}").alias("file_md5"), "score")
    return end(1).unionByName(end(2))


def pair_score(vec: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact, unrounded scores in both algorithms of the (collection, id1, id2) in `wanted`,
    null where either vector is empty; the order of the ids does not matter."""
    n = norms(vec).select("collection", "function_id", "n2", "total")
    pick = lambda i: n.select("collection", F.col("function_id").alias(f"id{i}"), F.col("n2").alias(f"n2_{i}"), F.col("total").alias(f"total_{i}"))
    v = lambda i: vec.select("collection", F.col("function_id").alias(f"id{i}"), "hash", F.col("tf").alias(f"tf{i}"))
    keys = ["collection", "id1", "id2"]
    shared = wanted.select(*keys).distinct().join(v(1), ["collection", "id1"]).join(v(2), ["collection", "id2", "hash"])
    shared = shared.groupBy(*keys).agg(F.sum(F.col("tf1") * F.col("tf2")).alias("dot"), F.sum(F.least("tf1", "tf2")).alias("least_sum"))
    out = wanted.select(*keys).join(pick(1), ["collection", "id1"], "left").join(pick(2), ["collection", "id2"], "left").join(shared, keys, "left")
    dot, least = F.coalesce("dot", F.lit(0)), F.coalesce("least_sum", F.lit(0))
    each = [F.when(F.col("n2_1").isNotNull() & F.col("n2_2").isNotNull(), score(a, dot, least, F.col("n2_1"), F.col("n2_2"), F.col("total_1"), F.col("total_2"))).alias(a) for a in ALGOS]
    return out.select(*keys, *each)


def cached_pair(sims: DataFrame, wanted: DataFrame, algo: str) -> DataFrame:
    """Stored scores of wanted pairs in either orientation."""
    w = wanted.select("collection", F.greatest("id1", "id2").alias("id1"), F.least("id1", "id2").alias("id2")).distinct()
    return sims.where(F.col("algo") == algo).join(w, ["collection", "id1", "id2"], "left_semi").select("collection", "id1", "id2", "score")
