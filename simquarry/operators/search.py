"""Document search and faceted similarity search.

Filters resolve to flags on functions and files; a pair matches where either end has the flag.
Target sets are never collected, and all flags come in one join for each end. Sorting and paging
come before enrichment, so only a page's rows meet the metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, POOL = 100, 1_000_000
MIN_SCORE, MAX_SCORE = 0.95, 1.0
#: Facet -> (levels, fields), the filters of the search interface.
FACETS = {
    "language": (("func",), ("language_id",)),
    "name": (("func",), ("function_name", "file_name")),
    "tag": (("sim", "func", "file"), ("tags", "user_tags")),
    "static_tag": (("sim", "func", "file"), ("tags",)),
    "user_tag": (("func", "file"), ("user_tags",)),
    "sim_tag": (("sim",), ("tags", "user_tags")),
    "sim_static_tag": (("sim",), ("tags",)),
    "sim_user_tag": (("sim",), ("user_tags",)),
    "func_tag": (("func",), ("tags", "user_tags")),
    "func_static_tag": (("func",), ("tags",)),
    "func_user_tag": (("func",), ("user_tags",)),
}
WORDS = (("sim", "func", "file"), ("tags", "user_tags", "function_name", "file_name", "file_md5", "language_id"))
_LISTS = ("tags", "user_tags")


def same(field: str, value: str) -> Column:
    """Equality without case; `tags` looks in tags and user_tags."""
    if field in ("tag", "tags"):
        has = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.lower(t) == value.lower())
        return has("tags") | has("user_tags")
    if field == "user_tags":
        return F.exists(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda t: F.lower(t) == value.lower())
    return F.lower(F.col(field)) == value.lower()


def holds(df: DataFrame, field: str, value: str) -> Column:
    """Literal substring match without case; false where the field is absent or null."""
    if field not in df.columns:
        return F.lit(False)
    if field in _LISTS:
        return F.coalesce(F.exists(F.col(field), lambda t: F.contains(F.lower(t), F.lit(value.lower()))), F.lit(False))
    return F.coalesce(F.contains(F.lower(F.col(field)), F.lit(value.lower())), F.lit(False))


def all_tags(wanted: Sequence[str]) -> Column:
    """Every wanted tag is in tags or user_tags, without case."""
    empty = F.array().cast("array<string>")
    have = F.transform(F.concat(F.coalesce("tags", empty), F.coalesce("user_tags", empty)), F.lower)
    return F.size(F.array_except(F.array(*(F.lit(w.lower()) for w in wanted)), have)) == 0


def query_documents(docs: DataFrame, exact: dict[str, str | None] | None = None, ranges: dict[str, tuple[float, float]] | None = None, tags: Sequence[str] = (), prefix: dict[str, str] | None = None) -> DataFrame:
    """The documents that pass every filter. Null or empty filter values don't filter."""
    for field, value in (exact or {}).items():
        if value not in (None, ""):
            docs = docs.where(same(field, value))
    for field, (low, high) in (ranges or {}).items():
        docs = docs.where(F.col(field).between(low, high))
    for field, value in (prefix or {}).items():
        docs = docs.where(F.startswith(F.col(field), F.lit(value)))
    return docs.where(all_tags(tags)) if tags else docs


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = LIMIT) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def _any_of(df: DataFrame, fields, value: str) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | holds(df, f, value)
    return out


def _flagged(base: DataFrame, functions: DataFrame, files: DataFrame, asked: list[tuple]) -> DataFrame:
    """The pairs of `base` that match every (levels, fields, value) asked for, at one of its
    levels, on the pair or on either end.

    However many are asked for, each end is looked up once among the matching functions and once
    among the matching files, which carry a flag for each; all asked flags are then tested in
    one filter."""
    out, drop = base, []
    for level, table, key in (("func", functions, "function_id"), ("file", files, "file_md5")):
        wanted = [k for k, (levels, _, _) in enumerate(asked) if level in levels]
        if not wanted:
            continue
        flags = table.select("collection", F.col(key).alias("__key"), *(_any_of(table, asked[k][1], asked[k][2]).alias(f"f{k}") for k in wanted))
        some = F.lit(False)
        for k in wanted:
            some = some | F.col(f"f{k}")
        flags = flags.where(some).groupBy("collection", "__key").agg(*(F.max(f"f{k}").alias(f"f{k}") for k in wanted))
        for i in (1, 2):
            end = f"id{i}" if level == "func" else f"md5_{i}"
            own = flags.select("collection", F.col("__key").alias(end), F.struct(*(f"f{k}" for k in wanted)).alias(f"__{level}{i}"))
            out = out.join(own, ["collection", end], "left")
            drop.append(f"__{level}{i}")
    for k, (levels, fields, value) in enumerate(asked):
        hit = _any_of(base, fields, value) if "sim" in levels else F.lit(False)
        for level in ("func", "file"):
            if level in levels:
                for i in (1, 2):
                    hit = hit | F.coalesce(F.col(f"__{level}{i}.f{k}"), F.lit(False))
        out = out.where(hit)
    return out.select(*base.columns)


def pair_pool(sims: DataFrame, collection: str, algo: str, min_score: float, max_score: float, pool_limit: int | None = None) -> DataFrame:
    """The pairs of the score range that enter the filters: all, or the best-scored `pool_limit`
    (POOL at most, see pool_status) of them."""
    base = sims.where((F.col("collection") == collection) & (F.col("algo") == algo) & F.col("score").between(min_score, max_score))
    if pool_limit is not None:
        base = base.orderBy(F.col("score").desc(), F.col("sid")).limit(max(1, min(pool_limit, POOL)))
    return base


def search_pairs(sims: DataFrame, functions: DataFrame, files: DataFrame, collection: str, algo: str = "unweighted_cosine", min_score: float = MIN_SCORE, max_score: float = MAX_SCORE, facets: dict[str, str] | None = None, md5: Sequence[str] = (), q: str = "", min_features: int = 0, cross_binary: bool | None = None, pool_limit: int | None = None) -> DataFrame:
    """The matching pairs, unsorted. With `pool_limit` only the best-scored so many of the
    score range enter the filters; pool_status tells whether that left any out."""
    base = pair_pool(sims, collection, algo, min_score, max_score, pool_limit)
    if min_features:
        base = base.where(F.col("min_features") >= min_features)
    if cross_binary is not None:
        base = base.where(F.col("is_cross_binary") == ("true" if cross_binary else "false"))
    wanted = sorted({m.lower() for m in md5 if m})
    if wanted:
        hit = F.lit(False)
        for m in wanted:
            for i in (1, 2):
                hit = hit | F.contains(F.lower(F.col(f"md5_{i}")), F.lit(m))
        base = base.where(hit)
    asked = [(*FACETS[name], value) for name, value in (facets or {}).items() if value not in (None, "")]
    asked += [(*WORDS, word) for word in q.split()]
    return _flagged(base, functions, files, asked) if asked else base


def pool_status(sims: DataFrame, collection: str, algo: str = "unweighted_cosine", min_score: float = MIN_SCORE, max_score: float = MAX_SCORE, pool_limit: int = POOL) -> DataFrame:
    """One row: pool (the limit that counts, 1 to POOL), candidates (pairs of the score range that
    enter the filters) and pool_truncated (whether they reach the limit)."""
    limit = max(1, min(pool_limit, POOL))
    all_ = pair_pool(sims, collection, algo, min_score, max_score).agg(F.count("*").alias("n"))
    return all_.select(F.lit(limit).cast("long").alias("pool"), F.least("n", F.lit(limit)).cast("long").alias("candidates"), (F.col("n") >= limit).alias("pool_truncated"))


def with_total(rows: DataFrame, hits: DataFrame, name: str = "total") -> DataFrame:
    """A page with the number of all hits behind it, counted before paging."""
    return rows.crossJoin(F.broadcast(hits.agg(F.count("*").alias(name))))  # one row


def find(df: DataFrame, key: str, value: str) -> DataFrame:
    """The document of an id; the filter reaches the scan."""
    return df.where(F.col(key) == value)


def sort_metric(sort_by: str = "score") -> Column:
    return F.col("min_features") if sort_by in ("feat_count", "min_features") else F.col("score")


def pair_page(pairs: DataFrame, sort_by: str = "score", descending: bool = True, offset: int = 0, limit: int = LIMIT) -> DataFrame:
    """A page by the metric, ties by ascending pair id."""
    m = sort_metric(sort_by)
    return page(pairs, [m.desc() if descending else m.asc(), F.col("sid").asc()], offset, limit)


def enrich(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """A page of pairs with either function's metadata; defaults where it is missing."""
    empty = F.array().cast("array<string>")
    fields = ["function_name", "file_name", "file_md5", "language_id", "return_type", "batch_uuid", "tags", "user_tags"]
    have = [f for f in fields if f in functions.columns]
    for i in (1, 2):
        meta = functions.select("collection", F.col("function_id").alias(f"id{i}"), F.struct(*have).alias(f"m{i}"))
        rows = rows.join(meta, ["collection", f"id{i}"], "left")
    out = rows
    for i in (1, 2):
        got = lambda f, default, i=i: F.coalesce(F.col(f"m{i}.{f}"), default) if f in have else default
        out = out.withColumns({
            f"name{i}": got("function_name", F.substring_index(f"id{i}", ":", -1)),
            f"meta{i}": F.struct(*(got(f, empty if f in _LISTS else F.lit("N/A")).alias(f) for f in fields)),
        })
    return out.drop("m1", "m2")
