"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, values
from ..operators import align, features, ingest, jobs, search, similarity, state, stats, tags, vectors
from ..sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MIN = 0.1

#: Common table expressions of the SQL side.
FN = """fn AS (SELECT 'main' AS collection, 'idx:main:func:' || c_nationkey || ':' || c_custkey AS function_id, CAST(c_nationkey AS VARCHAR) AS file_md5,
  n_name AS file_name, CAST(n_regionkey AS VARCHAR) AS batch_uuid, c_mktsegment AS language_id, c_name AS function_name,
  CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'mid' END AS tag, CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS user_tag, c_acctbal, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
VEC = """vec AS (SELECT 'idx:main:func:' || c_nationkey || ':' || c_custkey AS function_id, CAST(l_partkey AS VARCHAR) AS hash, CAST(count(*) AS BIGINT) AS tf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
NORM = "nrm AS (SELECT function_id, CAST(sum(tf * tf) AS BIGINT) AS n2, CAST(sum(tf) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS u FROM vec GROUP BY 1)"
RAW = """raw AS (SELECT p.id1, p.id2, p.dot, p.least_sum, x.n2 AS n2_a, y.n2 AS n2_b, x.total AS ta, y.total AS tb FROM (SELECT a.function_id AS id1, b.function_id AS id2,
  CAST(sum(a.tf * b.tf) AS BIGINT) AS dot, CAST(sum(least(a.tf, b.tf)) AS BIGINT) AS least_sum FROM vec a JOIN vec b ON a.hash = b.hash AND a.function_id > b.function_id GROUP BY 1, 2) p
  JOIN nrm x ON x.function_id = p.id1 JOIN nrm y ON y.function_id = p.id2)"""
COS = "(dot / (sqrt(CAST(n2_a AS DOUBLE)) * sqrt(CAST(n2_b AS DOUBLE))))"
JAC = "(CASE WHEN ta + tb - least_sum > 0 THEN CAST(least_sum AS DOUBLE) / (ta + tb - least_sum) ELSE 0.0 END)"
SIMS = f"""sims AS (SELECT 'idx:main:sim:unweighted_cosine:' || id1 || ':' || id2 AS sid, id1, id2, round({COS}, 4) AS score, split_part(id1, ':', 4) AS md5_1, split_part(id2, ':', 4) AS md5_2, ta, tb,
  least(ta, tb) AS min_features, CASE WHEN split_part(id1, ':', 4) <> split_part(id2, ':', 4) THEN 'true' ELSE 'false' END AS is_cross_binary FROM raw WHERE {COS} >= {MIN})"""
BASE = f"WITH {FN}, {VEC}, {NORM}, {RAW}, {SIMS} "
DVEC = """dw AS (SELECT 'idx:main:func:' || source || ':' || doc_id AS function_id, regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') AS w FROM documents),
  docc AS (SELECT function_id, i AS pos, substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 8) AS hash FROM (SELECT function_id, w, unnest(range(1, len(w) - 1)) AS i FROM dw WHERE len(w) >= 3)),
  vec AS (SELECT function_id, hash, CAST(count(*) AS BIGINT) AS tf FROM docc GROUP BY 1, 2)"""
TOK = """tk AS (SELECT function_id, line, k AS idx, t[k + 1] AS text FROM (SELECT function_id, line, t, unnest(range(0, len(t))) AS k FROM (SELECT function_id, j AS line, string_split(l[j + 1], ' ') AS t FROM
  (SELECT function_id, l, unnest(range(0, len(l))) AS j FROM (SELECT 'idx:main:func:' || source || ':' || doc_id AS function_id, string_split(text, chr(10)) AS l FROM documents)))))"""
ORD = """od AS (SELECT 'main' AS collection, 'idx:main:func:' || o_custkey || ':' || o_orderkey AS function_id, CAST(o_custkey AS VARCHAR) AS file_md5, 'cust_' || o_custkey AS file_name, o_orderpriority AS batch_uuid,
  o_orderstatus AS language_id, 'ord_' || o_orderkey AS function_name, [o_orderpriority] AS tags, CASE WHEN o_totalprice > 100000 THEN ['Big', o_orderstatus] ELSE [] END AS user_tags, o_totalprice AS price,
  CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS entry_date, o_orderkey FROM orders)"""
JOBS = """jb AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CAST(user_id AS VARCHAR) AS parent_id, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'pending' WHEN 2 THEN 'completed' WHEN 3 THEN 'cancelled' ELSE 'failed' END AS status,
  event_id % 101 AS progress, value AS speed, 100 AS total_items, event_id % 97 AS processed_items, epoch_us(ts) AS created_at FROM events)"""
OPS = "op AS (SELECT event_id AS op_id, user_id AS job_id, event_type AS op, CASE WHEN event_type IN ('click', 'view') THEN 'db_queries' WHEN event_type = 'error' THEN 'lua_scripts' ELSE 'pure_python' END AS cat, value AS \"time\", epoch_us(ts) AS ts FROM events)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sims(s, d):
    return similarity.build_pairs(src.customer_vectors(s, d), src.customer_functions(s, d), min_score=MIN)


def _brief(df: DataFrame) -> DataFrame:
    return df.select("sid", "score", "min_features")


BRIEF = "SELECT sid, score, min_features FROM sims s "
EITHER = "(SELECT sid FROM sims JOIN fn ON function_id IN (id1, id2) WHERE {})"


# ------------------------------------------------------------------ vectors

@query(f"WITH {DVEC} SELECT function_id, hash, tf FROM vec")
def vec_tf(s, d):
    return src.document_vectors(s, d).select("function_id", "hash", "tf")


@query(f"WITH {VEC}, {NORM} SELECT function_id, n2, total, u AS unique_features, sqrt(CAST(n2 AS DOUBLE)) AS norm FROM nrm")
def vec_norms(s, d):
    return vectors.norms(src.customer_vectors(s, d)).select("function_id", "n2", "total", "unique_features", "norm")


@query(f"WITH {VEC} SELECT function_id, string_agg(hash || '=' || tf, ',' ORDER BY tf DESC, hash) AS features FROM vec GROUP BY 1")
def vec_tf_lists(s, d):
    rows = vectors.tf_lists(src.customer_vectors(s, d))
    return rows.select("function_id", F.array_join(F.transform("features", lambda x: F.concat(x["hash"], F.lit("="), x["tf"].cast("string"))), ",").alias("features"))


@query(f"WITH {VEC} SELECT hash, CAST(count(*) AS BIGINT) AS frequency FROM vec GROUP BY 1")
def inverted_index_df(s, d):
    return vectors.document_frequency(src.customer_vectors(s, d)).select("hash", "frequency")


@query(f"WITH {VEC} SELECT hash, CAST(count(*) AS BIGINT) AS frequency, CAST(sum(tf * tf) AS BIGINT) AS tf_score, CAST(sum(tf) AS BIGINT) AS total_tf FROM vec GROUP BY 1")
def feature_tf_score(s, d):
    return vectors.feature_stats(src.customer_vectors(s, d)).select("hash", "frequency", "tf_score", "total_tf")


# ------------------------------------------------------------------ pairs

@query(f"WITH {VEC}, {NORM}, {RAW} SELECT id1, id2, round({COS}, 4) AS score FROM raw")
def pair_cosine(s, d):
    return similarity.scored_pairs(src.customer_vectors(s, d)).select("id1", "id2", "score")


@query(f"WITH {VEC}, {NORM}, {RAW} SELECT id1, id2, round({JAC}, 4) AS score FROM raw")
def pair_jaccard(s, d):
    return similarity.scored_pairs(src.customer_vectors(s, d), "jaccard").select("id1", "id2", "score")


_BOTH = "bth AS (SELECT id1 AS target, id2 AS candidate, score FROM sc UNION ALL SELECT id2, id1, score FROM sc), rk AS (SELECT target, candidate, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, candidate) AS rank FROM bth)"


@query(f"WITH {DVEC}, {NORM}, {RAW}, sc AS (SELECT id1, id2, round({COS}, 4) AS score FROM raw WHERE {COS} >= 0.3), {_BOTH} SELECT target, candidate, score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5")
def pair_cosine_docs_topk(s, d):
    return similarity.top_k(similarity.scored_pairs(src.document_vectors(s, d), "unweighted_cosine", 0.3), 5).select("target", "candidate", "score", "rank")


@query(f"WITH {VEC}, {NORM}, {RAW}, sc AS (SELECT id1, id2, round({JAC}, 4) AS score FROM raw WHERE {JAC} >= 0.05), {_BOTH} SELECT target, candidate, score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 3")
def topk_per_target(s, d):
    return similarity.top_k(similarity.scored_pairs(src.customer_vectors(s, d), "jaccard", 0.05), 3).select("target", "candidate", "score", "rank")


@query(BASE + "SELECT sid, id1, id2, score, md5_1, md5_2, ta AS feat_count1, tb AS feat_count2, min_features, is_cross_binary FROM sims")
def canonical_pairs(s, d):
    return _sims(s, d).drop("collection", "algo")


@query(BASE + BRIEF + "WHERE is_cross_binary = 'true'")
def cross_binary_pairs(s, d):
    f = src.customer_functions(s, d)
    return _brief(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, cross_binary=True))


@query(BASE + BRIEF + "WHERE min_features >= 45")
def min_features_filter(s, d):
    f = src.customer_functions(s, d)
    return _brief(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, min_features=45))


@query(BASE + BRIEF + "WHERE score BETWEEN 0.11 AND 0.5 ORDER BY score DESC, sid LIMIT 50 OFFSET 20")
def score_range_page(s, d):
    f = src.customer_functions(s, d)
    return _brief(search.pair_page(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=0.11, max_score=0.5), offset=20, limit=50))


@query(BASE + BRIEF + "ORDER BY min_features ASC, sid LIMIT 60")
def sort_by_feat_count(s, d):
    return _brief(search.pair_page(_sims(s, d), "feat_count", False, 0, 60))


@query(BASE + "SELECT sid, score, min_features FROM (SELECT * FROM sims ORDER BY score DESC, sid LIMIT 200) WHERE min_features >= 30")
def pool_limited_search(s, d):
    f = src.customer_functions(s, d)
    return _brief(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, min_features=30, pool_limit=200))


def _facet(**facets):
    def run(s, d):
        f = src.customer_functions(s, d)
        return _brief(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, facets=facets))

    return run


def _add_facet(title: str, sql: str, **facets):
    run = _facet(**facets)
    run.__name__ = title
    query(sql)(run)


_add_facet("facet_language", BASE + BRIEF + "WHERE sid IN " + EITHER.format("contains(lower(language_id), 'build')"), language="BUILD")
_add_facet("facet_name_substring", BASE + BRIEF + "WHERE sid IN " + EITHER.format("contains(lower(function_name), '00001') OR contains(lower(file_name), '00001')"), name="00001")
_add_facet("facet_tag", BASE + BRIEF + "WHERE sid IN " + EITHER.format("tag = 'debt' OR user_tag = 'debt'"), tag="debt")
_add_facet("facet_user_tag_and_static_tag", BASE + BRIEF + "WHERE sid IN " + EITHER.format("user_tag = 'machinery'") + " AND sid IN " + EITHER.format("tag = 'rich'"), user_tag="machinery", static_tag="rich")
_add_facet("facet_func_tags", BASE + BRIEF + "WHERE sid IN " + EITHER.format("contains(tag, 'mi') OR contains(user_tag, 'mi')") + " AND sid IN " + EITHER.format("contains(tag, 'd')") + " AND sid IN " + EITHER.format("contains(user_tag, 'u')"), func_tag="mi", func_static_tag="d", func_user_tag="u")
_add_facet("facet_sim_tags_empty", BASE + BRIEF + "WHERE false", sim_tag="x", sim_static_tag="x", sim_user_tag="x")

_WORD = "contains(lower(tag), '{0}') OR contains(lower(user_tag), '{0}') OR contains(lower(function_name), '{0}') OR contains(lower(file_name), '{0}') OR contains(lower(file_md5), '{0}') OR contains(lower(language_id), '{0}')"


@query(BASE + BRIEF + "WHERE sid IN " + EITHER.format(_WORD.format("auto")) + " AND sid IN " + EITHER.format(_WORD.format("rich")))
def keyword_and_of_ors(s, d):
    f = src.customer_functions(s, d)
    return _brief(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, q=" auto  RICH "))


@query(BASE + BRIEF + "WHERE contains(md5_1, '7') OR contains(md5_2, '7') OR contains(md5_1, '21') OR contains(md5_2, '21')")
def md5_multi_or(s, d):
    f = src.customer_functions(s, d)
    return _brief(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, md5=["7", "21", "7", ""]))


@query(BASE + """, pg AS (SELECT * FROM sims ORDER BY score DESC, sid LIMIT 100)
  SELECT sid, score, x.function_name AS name1, y.function_name AS name2, x.file_name AS file1, y.language_id AS language2, 'N/A' AS return1, x.tag AS tag1 FROM pg JOIN fn x ON x.function_id = id1 JOIN fn y ON y.function_id = id2""")
def enriched_page(s, d):
    rows = search.enrich(search.pair_page(_sims(s, d)), src.customer_functions(s, d))
    return rows.select("sid", "score", "name1", "name2", F.col("meta1.file_name").alias("file1"), F.col("meta2.language_id").alias("language2"), F.col("meta1.return_type").alias("return1"), F.element_at("meta1.tags", 1).alias("tag1"))


@query(f"""WITH {FN}, {VEC}, {NORM}, wanted AS (SELECT a.function_id AS id1, b.function_id AS id2 FROM fn a JOIN fn b ON b.c_custkey = a.c_custkey + 1),
  sh AS (SELECT id1, id2, CAST(sum(a.tf * b.tf) AS BIGINT) AS dot, CAST(sum(least(a.tf, b.tf)) AS BIGINT) AS least_sum FROM wanted JOIN vec a ON a.function_id = id1 JOIN vec b ON b.function_id = id2 AND a.hash = b.hash GROUP BY 1, 2),
  al AS (SELECT w.id1, w.id2, coalesce(dot, 0) AS dot, coalesce(least_sum, 0) AS least_sum, x.n2 AS n2_a, y.n2 AS n2_b, x.total AS ta, y.total AS tb FROM wanted w LEFT JOIN sh ON sh.id1 = w.id1 AND sh.id2 = w.id2 LEFT JOIN nrm x ON x.function_id = w.id1 LEFT JOIN nrm y ON y.function_id = w.id2)
  SELECT id1, id2, {COS} AS unweighted_cosine, CASE WHEN n2_a IS NULL OR n2_b IS NULL THEN NULL ELSE {JAC} END AS jaccard FROM al""")
def pair_score_exact(s, d):
    f = src.customer_functions(s, d).select("collection", "function_id", "c_custkey")
    nxt = f.select(F.col("function_id").alias("id2"), (F.col("c_custkey") - 1).alias("c_custkey"))
    wanted = f.join(nxt, "c_custkey").select("collection", F.col("function_id").alias("id1"), "id2")
    return similarity.pair_score(src.customer_vectors(s, d), wanted).select("id1", "id2", "unweighted_cosine", "jaccard")


@query(BASE + "SELECT sid, score FROM sims JOIN fn a ON a.function_id = id1 JOIN fn b ON b.function_id = id2 WHERE a.c_custkey % 3 <> 0 OR b.c_custkey % 3 <> 0")
def incremental_build(s, d):
    """Customers whose key 3 divides are built; only pairs with a new function are formed."""
    f, v = src.customer_functions(s, d), src.customer_vectors(s, d)
    todo = similarity.unbuilt(f, f.where("c_custkey % 3 = 0").select("collection", "function_id"))
    return similarity.build_pairs(v, f, min_score=MIN, targets=todo).select("sid", "score")


@query(BASE + "SELECT sid, score FROM sims WHERE sid NOT IN " + EITHER.format("batch_uuid = '2'"))
def clear_pairs(s, d):
    return similarity.clear_pairs(_sims(s, d), state.targets_of(src.customer_functions(s, d), batch="2")).select("sid", "score")


@query(BASE + "SELECT sid, score FROM sims")
def rebuild_pairs(s, d):
    """Clearing one batch and building it again gives the full build."""
    f, v = src.customer_functions(s, d), src.customer_vectors(s, d)
    sims = _sims(s, d)
    out, _ = similarity.rebuild(v, f, sims, f.select("collection", "function_id"), state.targets_of(f, batch="2"), min_score=MIN)
    return out.select("sid", "score")


@query(BASE + "SELECT function_id, CAST(count(*) AS BIGINT) AS pairs, max(score) AS best FROM (SELECT id1 AS function_id, score FROM sims UNION ALL SELECT id2, score FROM sims) GROUP BY 1")
def involves_counts(s, d):
    return similarity.involves(_sims(s, d)).groupBy("function_id").agg(F.count("*").alias("pairs"), F.max("score").alias("best"))


@query(BASE + BRIEF + "WHERE md5_1 = '7' OR md5_2 = '7' ORDER BY score DESC, sid LIMIT 20")
def similarity_list_file(s, d):
    sims = _sims(s, d)
    own = similarity.involves(sims).where("file_md5 = '7'").select("sid")
    return _brief(search.pair_page(sims.join(own, "sid", "left_semi"), limit=20))


# ------------------------------------------------------------------ document search

_OD = "SELECT function_id, function_name, price FROM od "


def _od(df):
    return df.select("function_id", "function_name", "price")


@query(f"WITH {ORD} {_OD} WHERE lower(language_id) = 'f' AND lower(batch_uuid) = '1-urgent' ORDER BY function_id LIMIT 100 OFFSET 10")
def function_search_exact(s, d):
    rows = search.query_documents(src.order_functions(s, d), {"language_id": "f", "batch_uuid": "1-URGENT", "file_name": ""})
    return _od(search.page(rows, [F.col("function_id")], 10, 100))


@query(f"WITH {ORD} {_OD} WHERE len(list_filter(list_concat(tags, user_tags), lambda t: lower(t) = 'big')) > 0")
def tag_union_search(s, d):
    return _od(search.query_documents(src.order_functions(s, d), {"tag": "BIG"}))


@query(f"WITH {ORD} {_OD} WHERE 'Big' IN (SELECT unnest(user_tags)) AND batch_uuid = '2-HIGH'")
def multi_tag_all(s, d):
    return _od(search.query_documents(src.order_functions(s, d), tags=["big", "2-high"]))


@query(f"WITH {ORD} {_OD} WHERE price BETWEEN 50000 AND 120000 AND entry_date BETWEEN 800000000000 AND 850000000000")
def numeric_range_search(s, d):
    return _od(search.query_documents(src.order_functions(s, d), ranges={"price": (50000, 120000), "entry_date": (800000000000, 850000000000)}))


@query(f"WITH {ORD} SELECT function_id FROM od WHERE language_id = 'O' INTERSECT SELECT function_id FROM od WHERE batch_uuid = '5-LOW' INTERSECT SELECT function_id FROM od WHERE price > 100000")
def intersect_postings(s, d):
    f = src.order_functions(s, d)
    posted = stats.postings(f, "func", ["language_id", "batch_uuid", "tags", "user_tags"], "function_id")
    pick = lambda field, value: posted.where((F.col("field") == field) & (F.col("value") == value)).select("doc_id")
    return pick("language_id", "o").intersect(pick("batch_uuid", "5-low")).intersect(pick("user_tags", "big")).withColumnRenamed("doc_id", "function_id")


_POSTS = """ps AS (SELECT DISTINCT field, lower(value) AS value, function_id FROM (SELECT 'language_id' AS field, language_id AS value, function_id FROM od UNION ALL SELECT 'batch_uuid', batch_uuid, function_id FROM od
  UNION ALL SELECT 'tags', unnest(tags), function_id FROM od UNION ALL SELECT 'user_tags', unnest(user_tags), function_id FROM od) WHERE value <> ''), ec AS (SELECT field, value, count(*) AS n FROM ps GROUP BY 1, 2)"""


@query(f"WITH {ORD}, {_POSTS} SELECT 'func' AS level, field, CAST(count(*) AS BIGINT) AS buckets, CAST(sum(n) AS BIGINT) AS postings, CAST(sum(n) AS DOUBLE) / count(*) AS avg_postings, arg_max(value, (n, value)) AS example FROM ec GROUP BY field")
def registry_dictionary(s, d):
    return stats.registry(stats.postings(src.order_functions(s, d), "func", ["language_id", "batch_uuid", "tags", "user_tags"], "function_id"))


@query(f"WITH {ORD} SELECT file_md5, file_name, CAST(count(*) AS BIGINT) AS n_functions, CAST((SELECT count(DISTINCT file_md5) FROM od) AS BIGINT) AS total FROM od GROUP BY 1, 2 ORDER BY file_md5 LIMIT 100")
def file_search_with_totals(s, d):
    f = src.files_of(src.order_functions(s, d)).select("file_md5", "file_name", "n_functions")
    total = f.agg(F.count("*").alias("total"))
    return search.page(f, [F.col("file_md5")], 0, 100).crossJoin(F.broadcast(total))  # one row


@query(f"WITH {ORD} SELECT batch_uuid, 'main:batch:' || batch_uuid AS batch_id, CAST(count(DISTINCT file_md5) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS total_functions, min(entry_date) AS created_at, max(entry_date) AS last_updated FROM od GROUP BY 1 ORDER BY last_updated DESC, batch_uuid LIMIT 100")
def batch_search_recent(s, d):
    f = src.order_functions(s, d)
    # A file for each customer and batch, with the time of its newest order.
    files = f.groupBy("collection", "batch_uuid", "file_md5").agg(F.count("*").alias("n_functions"), F.min("entry_date").alias("first"), F.max("entry_date").alias("entry_date")).withColumn("batch_name", F.col("batch_uuid"))
    first = files.groupBy("batch_uuid").agg(F.min("first").alias("first"))
    rows = ingest.batches(files).join(first, "batch_uuid").withColumn("created_at", F.col("first")).drop("collection", "first", "name")
    return search.page(rows, [F.coalesce("last_updated", F.lit(0)).desc(), F.col("batch_uuid")])


@query("SELECT r_name AS collection, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS total_functions, max(c_custkey) AS last_updated FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 1 LIMIT 100")
def collection_search(s, d):
    f = src.customer_functions(s, d)
    rows = f.join(src.table(s, d, "region"), F.col("batch_uuid") == F.col("r_regionkey").cast("string"))
    files = rows.groupBy(F.col("r_name").alias("collection"), "file_md5").agg(F.count("*").alias("n_functions"), F.max("c_custkey").alias("entry_date"))
    out = ingest.collections(files)
    return search.page(out, [F.col("collection")])


# ------------------------------------------------------------------ status

_ST = "CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS {0}, CAST(count(*) FILTER (WHERE NOT c_acctbal > 0) AS BIGINT) AS un{0}, count(*) FILTER (WHERE c_acctbal > 0) / count(*) * 100.0 AS ratio"


def _status(by: str, word: str):
    def run(s, d):
        f = src.customer_functions(s, d)
        return stats.progress(f, f.where("c_acctbal > 0"), [by], word)

    run.__name__ = f"{'build' if word == 'built' else 'index'}_status_{ {'collection': 'collection', 'batch_uuid': 'batch', 'file_md5': 'file'}[by] }"
    query(f"WITH {FN} SELECT {by}, {_ST.format(word)} FROM fn GROUP BY 1")(run)


for _word in ("built", "indexed"):
    for _by in ("collection", "batch_uuid", "file_md5"):
        _status(_by, _word)


@query(f"""{BASE.rstrip()}, t AS (SELECT CAST(count(DISTINCT file_md5) AS BIGINT) AS num_files, CAST(count(*) AS BIGINT) AS num_functions, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS num_indexed FROM fn)
  SELECT 'main' AS collection, num_files, num_functions, num_indexed, (SELECT CAST(count(DISTINCT hash) AS BIGINT) FROM vec) AS num_features, (SELECT CAST(count(*) AS BIGINT) FROM sims) AS num_sim_meta, num_functions - num_indexed AS num_missing, num_indexed / num_functions * 100.0 AS indexing_ratio FROM t""")
def index_status_missing(s, d):
    f, v = src.customer_functions(s, d), src.customer_vectors(s, d)
    return stats.index_summary(src.files_of(f), f, f.where("c_acctbal > 0"), v, _sims(s, d))


@query("""SELECT 'pages' AS component, CAST(count(*) AS BIGINT) AS count, avg(z) AS avg_size, CAST(sum(z) AS BIGINT) AS total_size FROM (SELECT octet_length(encode(CAST(json_object('page_id', page_id, 'url', url, 'html', html) AS VARCHAR))) AS z FROM pages)
  UNION ALL SELECT 'labels', count(*), avg(z), CAST(sum(z) AS BIGINT) FROM (SELECT octet_length(encode(CAST(json_object('doc_id', doc_id, 'quality', quality, 'toxic', toxic) AS VARCHAR))) AS z FROM labels)""")
def storage_breakdown(s, d):
    return stats.storage({name: src.table(s, d, name) for name in ("pages", "labels")})


# ------------------------------------------------------------------ tags

_TAGS = """tg AS (SELECT 'main' AS collection, unnest(['debt', 'Rich', 'rich', 'mid', 'building', 'unused']) AS tag), us AS (SELECT lower(tag) AS low FROM fn UNION ALL SELECT lower(user_tag) FROM fn WHERE user_tag IS NOT NULL)"""


@query(f"WITH {FN}, {_TAGS} SELECT tag, CAST(count(low) AS BIGINT) AS count FROM tg LEFT JOIN us ON lower(tag) = low GROUP BY tag")
def tag_counts(s, d):
    meta = s.createDataFrame([("main", t, None, 0) for t in ("debt", "Rich", "rich", "mid", "building", "unused")], "collection string, tag string, color string, priority long")
    return tags.tag_counts(meta, {"func": src.customer_functions(s, d)}).select("tag", "count")


@query(f"WITH {FN} SELECT function_id, array_to_string(list_sort(CASE WHEN batch_uuid = '1' THEN list_concat(CASE WHEN user_tag IS NULL THEN [] ELSE [user_tag] END, CASE WHEN user_tag = 'checked' THEN [] ELSE ['checked'] END) WHEN user_tag IS NULL THEN [] ELSE [user_tag] END), ',') AS user_tags FROM fn")
def tag_add(s, d):
    f = src.customer_functions(s, d)
    wanted = f.where("batch_uuid = '1'").select(F.col("function_id").alias("id"), F.lit(" checked ").alias("tag"))
    return tags.add_tags(tags.add_tags(f, wanted, "function_id"), wanted, "function_id").select("function_id", F.array_join(F.sort_array("user_tags"), ",").alias("user_tags"))


@query(f"WITH {FN} SELECT function_id, CASE WHEN user_tag IS NULL OR user_tag = 'building' THEN '' ELSE user_tag END AS user_tags FROM fn")
def tag_remove(s, d):
    f = src.customer_functions(s, d)
    wanted = f.select(F.concat("function_id", F.lit(":meta")).alias("id"), F.lit("building").alias("tag"))
    return tags.remove_tags(f, wanted, "function_id").select("function_id", F.array_join("user_tags", ",").alias("user_tags"))


# ------------------------------------------------------------------ features

@query(f"WITH {DVEC} SELECT hash, CAST(count(*) AS BIGINT) AS frequency, CAST(sum(tf * tf) AS BIGINT) AS tf_score, CAST(sum(tf) AS BIGINT) AS total_tf FROM vec WHERE hash LIKE 'a%' GROUP BY 1 ORDER BY tf_score DESC, hash DESC LIMIT 50")
def feature_search_tf_desc(s, d):
    return features.search_features(src.document_vectors(s, d), "a", "tf", 0, 50).drop("collection")


@query(f"WITH {VEC} SELECT hash, CAST(count(*) AS BIGINT) AS frequency, CAST(sum(tf * tf) AS BIGINT) AS tf_score, CAST(sum(tf) AS BIGINT) AS total_tf FROM vec GROUP BY 1 ORDER BY hash LIMIT 20 OFFSET 40")
def feature_search_default(s, d):
    return features.search_features(src.customer_vectors(s, d), "", "default", 40, 20).drop("collection")


_CTX = "ctx AS (SELECT function_id, hash, pos FROM (SELECT *, row_number() OVER (PARTITION BY function_id, hash ORDER BY pos DESC) AS n FROM docc) WHERE n = 1)"


@query(f"WITH {DVEC}, {_CTX} SELECT function_id, hash, CAST(pos AS BIGINT) AS pos FROM ctx")
def feature_context_last_wins(s, d):
    return vectors.last_context(src.document_occurrences(s, d)).select("function_id", "hash", "pos")


@query(f"WITH {DVEC}, {_CTX} SELECT hash, min(function_id) AS function_id, CAST(arg_min(pos, function_id) AS BIGINT) AS pos FROM ctx GROUP BY 1")
def feature_context_first(s, d):
    return vectors.first_context(vectors.last_context(src.document_occurrences(s, d))).select("hash", "function_id", "pos")


# ------------------------------------------------------------------ alignment

def _hashes(s, d):
    """Tokens of eight characters or more stand in for tokens with features."""
    t = src.document_tokens(s, d)
    w = t.withColumn("hash", F.substring(F.md5("text"), 1, 8)).where(F.length("text") >= 8)
    return t, w.groupBy("collection", "function_id", "line", "idx").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))


def _numbered(s, d):
    """Tokens with function-wide numbers (line and place in the line), and their features."""
    t, h = _hashes(s, d)
    number = (F.col("line") * 1_000_000 + F.col("idx")).alias("idx")
    return t.select("collection", "function_id", "line", number, "text"), h.select("collection", "function_id", number, "hashes")


_LINES = f"""{TOK}, ln AS (SELECT function_id, line, string_agg(text, '' ORDER BY idx) AS text, array_to_string(list_sort(list_distinct(list(substr(md5(text), 1, 8)) FILTER (WHERE length(text) >= 8))), ',') AS hs FROM tk GROUP BY 1, 2)"""


@query(f"WITH {_LINES} SELECT function_id, CAST(line AS BIGINT) AS line, CASE WHEN hs <> '' THEN 'FEATURES:' || hs ELSE 'TEXT:' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS identity FROM ln")
def line_identity(s, d):
    return align.line_identities(*_numbered(s, d)).select("function_id", "line", "identity")


@query(f"WITH {TOK} SELECT function_id, CAST(line AS BIGINT) AS line, CAST(count(*) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE length(text) >= 8) AS BIGINT) AS featured, string_agg(CASE WHEN length(text) >= 8 THEN 'diff-unique' ELSE '' END, ',' ORDER BY idx) AS classes FROM tk GROUP BY 1, 2")
def code_view_rows(s, d):
    rows = align.code_view(*[x.withColumn("type", F.lit("text")) if i == 0 else x for i, x in enumerate(_numbered(s, d))])
    return rows.select("function_id", "line", F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("tokens", lambda t: t["diff_class"] != "")).cast("long").alias("featured"), F.array_join(F.transform("tokens", lambda t: t["diff_class"]), ",").alias("classes"))


@query(f"WITH {DVEC} SELECT function_id, CAST(pos AS BIGINT) AS idx, string_agg(hash, ',' ORDER BY hash) AS hashes FROM (SELECT function_id, hash, unnest([pos, pos + 1, pos + 2]) AS pos FROM docc) GROUP BY 1, 2")
def token_feature_map(s, d):
    occ = src.document_occurrences(s, d).withColumn("addr_to_token_idx", F.array(F.col("pos"), F.col("pos") + 1, F.col("pos") + 2))
    return align.token_features(occ).select("function_id", "idx", F.array_join("hashes", ",").alias("hashes"))


_NEXT = "nx AS (SELECT a.function_id AS id1, b.function_id AS id2 FROM (SELECT 'idx:main:func:' || source || ':' || doc_id AS function_id, doc_id FROM documents) a JOIN (SELECT 'idx:main:func:' || source || ':' || doc_id AS function_id, doc_id FROM documents) b ON b.doc_id = a.doc_id + 20)"


def _later(s, d, step: int = 20):
    f = src.document_functions(s, d).select("collection", "function_id", "doc_id")
    nxt = f.select(F.col("collection").alias("collection2"), F.col("function_id").alias("id2"), (F.col("doc_id") - step).alias("doc_id"))
    return f.join(nxt, "doc_id").select(F.col("collection").alias("collection1"), F.col("function_id").alias("id1"), "collection2", "id2")


@query(f"WITH {DVEC}, {_NEXT} SELECT id1, id2, string_agg(a.hash, ',' ORDER BY a.hash) AS hashes FROM nx JOIN vec a ON a.function_id = id1 JOIN vec b ON b.function_id = id2 AND a.hash = b.hash GROUP BY 1, 2")
def common_hashes(s, d):
    return align.common_hashes(src.document_vectors(s, d), _later(s, d)).select("id1", "id2", F.array_join("hashes", ",").alias("hashes"))


@query()
def aligned_diff(s, d):
    return align.aligned_diff(align.line_identities(*_numbered(s, d)), _later(s, d))


# ------------------------------------------------------------------ scalars

@query("""SELECT event_id, CAST(CASE WHEN value IS NULL OR value = 0 THEN 0 ELSE trunc(value * 1000) END AS BIGINT) AS seconds_ms, CAST(epoch_us(ts) // 1000 AS BIGINT) AS text_ms, 0::BIGINT AS bad_ms FROM events""")
def parse_timestamp(s, d):
    e = src.table(s, d, "events")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return e.select("event_id", values.millis(F.col("value")).alias("seconds_ms"), values.millis_text(iso).alias("text_ms"), values.millis_text(F.lit("soon")).alias("bad_ms"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{"k":' || (props->>'$.k') || '}' AS canonical FROM events""")
def json_projection(s, d):
    e = src.table(s, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("canonical"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: trim(x)), '|') AS tags, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, CAST(0 AS BIGINT) AS blank FROM part""")
def csv_tags_normalise(s, d):
    t = ids.split_tags(F.replace(F.col("p_name"), F.lit(" "), F.lit(" ,\t")))
    return src.table(s, d, "part").select("p_partkey", F.array_join(t, "|").alias("tags"), F.size(t).cast("long").alias("n"), F.size(ids.split_tags(F.lit(" "))).cast("long").alias("blank"))


_FID = "'idx:main:func:' || o_custkey || ':' || lower(hex(o_orderkey))"


@query(f"""SELECT o_orderkey, {_FID} AS function_id, 'idx:main:file:' || o_custkey AS file_id, lower(hex(o_orderkey)) AS address, CAST(o_custkey AS VARCHAR) AS md5, 'unknown_addr' AS missing,
  'idx:main:sim:jaccard:' || greatest('idx:main:func:9:1', {_FID}) || ':' || least('idx:main:func:9:1', {_FID}) AS sid, 'main:function:' || o_custkey || ':' || lower(hex(o_orderkey)) AS legacy FROM orders""")
def id_parse_build(s, d):
    """Ids of every order; the pair ids' two ends come in either order."""
    o = src.table(s, d, "orders")
    md5 = F.col("o_custkey").cast("string")
    full = F.concat(md5, F.lit(":#"), md5, F.lit("::f:@x::g:@"), ids.hex32(F.col("o_orderkey")))
    fid = ids.function_id(F.lit("main"), md5, ids.address_of(full))
    return o.select(
        "o_orderkey", fid.alias("function_id"), ids.file_id(F.lit("main"), md5).alias("file_id"), ids.last_part(fid).alias("address"), ids.md5_of(fid, F.lit("main")).alias("md5"), ids.address_of(md5).alias("missing"),
        ids.pair_id(F.lit("main"), F.lit("jaccard"), fid, F.lit("idx:main:func:9:1")).alias("sid"), ids.legacy_function_id(F.concat(F.lit("main:#"), md5, F.lit("::f:@"), ids.last_part(fid))).alias("legacy"))


# ------------------------------------------------------------------ jobs

@query(f"""WITH {JOBS}, r AS (SELECT CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS active_workers, CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending_jobs, CAST(sum(100 - processed_items) FILTER (WHERE status = 'running') AS BIGINT) AS remaining_items,
  round(sum(speed) FILTER (WHERE status = 'running'), 2) AS total_speed FROM jb) SELECT active_workers, pending_jobs, remaining_items, total_speed FROM r""")
def job_stats(s, d):
    return jobs.job_stats(src.event_jobs(s, d)).select("active_workers", "pending_jobs", "remaining_items", F.round("total_speed", 2).alias("total_speed"))


@query(f"WITH {JOBS} SELECT parent_id, CAST(floor(sum(progress) / count(*)) AS BIGINT) AS progress, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE 'running' END AS status FROM jb GROUP BY 1")
def pipeline_progress(s, d):
    return jobs.pipeline_progress(src.event_jobs(s, d))


@query(f"WITH {JOBS} SELECT id, type, created_at FROM jb ORDER BY created_at DESC, id LIMIT 50")
def newest_jobs(s, d):
    return jobs.newest_jobs(src.event_jobs(s, d)).select("id", "type", "created_at")


@query(f"WITH {JOBS} SELECT id, CASE WHEN (id LIKE '%7' OR parent_id LIKE '%7') AND status NOT IN ('completed', 'failed') THEN 'cancelled' ELSE status END AS status FROM jb")
def cancel_jobs(s, d):
    j = src.event_jobs(s, d)
    own = j.where("id like '%7'").select("id").union(j.where("parent_id like '%7'").select(F.col("parent_id").alias("id")))
    return jobs.cancel(j, own).select("id", "status")


@query(f"WITH {OPS} SELECT cat, op, round(sum(\"time\"), 2) AS total, round(coalesce(sum(\"time\") FILTER (WHERE cat = 'db_queries'), 0), 2) AS db, round(coalesce(sum(\"time\") FILTER (WHERE cat = 'lua_scripts'), 0), 2) AS lua, CAST(count(*) AS BIGINT) AS ops_count FROM op GROUP BY ROLLUP (cat, op)")
def perf_rollup(s, d):
    r = jobs.perf_rollup(src.event_ops(s, d), ["cat", "op"])
    return r.select("cat", "op", F.round("total", 2).alias("total"), F.round("db", 2).alias("db"), F.round("lua", 2).alias("lua"), "ops_count")


@query(f"WITH {OPS} SELECT op_id, op, \"time\" FROM op ORDER BY \"time\" DESC, op_id LIMIT 10")
def top_slowest_ops(s, d):
    return jobs.slowest(src.event_ops(s, d)).select("op_id", "op", "time")


@query(f"WITH {OPS}, w AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY op_id) AS a, row_number() OVER (PARTITION BY op ORDER BY op_id DESC) AS b FROM op) SELECT op_id, op FROM w WHERE a <= 200 OR b <= 300")
def log_caps(s, d):
    return jobs.capped(src.event_ops(s, d), "op", "op_id", 200, 300).select("op_id", "op")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS succeeded, avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) * 100 AS percent FROM events")
def upload_success_rate(s, d):
    return jobs.success_rate(src.table(s, d, "events").withColumn("ok", F.col("event_type") != "error"))


@query(f"WITH {VEC}, {FN}, kept AS (SELECT vec.* FROM vec JOIN fn USING (function_id) WHERE file_md5 <> '3') SELECT hash, CAST(count(*) AS BIGINT) AS frequency, CAST(sum(tf * tf) AS BIGINT) AS tf_score, CAST(sum(tf) AS BIGINT) AS total_tf FROM kept GROUP BY 1")
def clear_features(s, d):
    f, v = src.customer_functions(s, d), src.customer_vectors(s, d)
    left, _ = state.clear_features(v, f.select("collection", "function_id"), state.targets_of(f, md5="3"))
    return vectors.feature_stats(left).drop("collection")


@query(f"WITH {FN} SELECT function_id FROM fn WHERE file_md5 <> '3' AND function_id NOT LIKE 'idx:main:func:1%'")
def delete_file_and_prefix(s, d):
    f = src.customer_functions(s, d)
    left = state.delete_file({"functions": f}, "3", "main")["functions"]
    return state.delete_prefix(left, "function_id", "idx:main:func:1").select("function_id")


@query("SELECT CAST(user_id % 8 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS events, max(event_id) AS last_event FROM events GROUP BY 1")
def stream_ingest(s, d):
    """The events as a file stream: every micro-batch appends under its number, and the table
    is what all of them wrote."""
    from ..sources.scratch import scratch

    e = src.table(s, d, "events")
    root = scratch(s, "stream")
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)

    def put(df, number):
        df.select(F.pmod("user_id", F.lit(8)).cast("long").alias("part"), "event_id").write.mode("overwrite").parquet(f"{root}/out/batch_no={number}")

    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return s.read.parquet(f"{root}/out").groupBy("part").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
