"""Queries over upload documents, views, states and small expressions, each with its SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import ids, values
from ..operators import align, features, ingest, jobs, search, similarity, state, stats, tags, vectors
from ..sources import tables as src
from ..sources import upload
from ..sources.scratch import scratch, written
from .catalog import BASE, BRIEF, FN, JOBS, MIN, OPS, ORD, VEC, _brief, _sims, query

#: Common table expressions of the SQL side: orders as uploads, their items as tokens and features.
ITEMS = """it AS (SELECT l_orderkey AS o, 'idx:main:func:o' || l_orderkey || ':' || lower(hex(l_orderkey)) AS function_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) - 1 AS k, CAST(l_linenumber - 1 AS BIGINT) AS line,
  'p' || (l_partkey % 100) AS hash, l_returnflag AS type, 'OP' || l_linestatus AS pcode_op, CASE WHEN l_linenumber % 2 = 1 THEN 'FULL' || l_suppkey END AS pcode_op_full, l_quantity,
  l_returnflag || l_suppkey AS text, l_linestatus AS token_type, lower(hex(l_suppkey)) AS addr FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""
SEQ = "CASE WHEN l_quantity > 25 THEN 's' || k END"
IVEC = "iv AS (SELECT o, function_id, hash, CAST(count(*) AS BIGINT) AS tf FROM it GROUP BY ALL)"
CTX = f"ctx AS (SELECT *, {SEQ} AS seq FROM it QUALIFY row_number() OVER (PARTITION BY function_id, hash ORDER BY k DESC) = 1)"
TEXT = "lt AS (SELECT function_id, line, string_agg(text, '' ORDER BY k) AS line_text FROM it GROUP BY 1, 2)"
NVEC = """nv AS (SELECT 'idx:main:func:r' || n_regionkey || ':' || lower(hex(CAST(n_nationkey AS BIGINT))) AS function_id, 'k' || ((k * 7 + n_regionkey) % 11) AS hash, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT *, unnest(range(0, n_nationkey + 1)) AS k FROM nation) GROUP BY 1, 2)"""
NSIMS = """nn AS (SELECT function_id, sum(tf * tf) AS n2 FROM nv GROUP BY 1), ns AS (SELECT id1, id2, dot / (sqrt(CAST(x.n2 AS DOUBLE)) * sqrt(CAST(y.n2 AS DOUBLE))) AS raw FROM
  (SELECT a.function_id AS id1, b.function_id AS id2, CAST(sum(a.tf * b.tf) AS DOUBLE) AS dot FROM nv a JOIN nv b ON a.hash = b.hash AND a.function_id > b.function_id GROUP BY 1, 2) JOIN nn x ON x.function_id = id1 JOIN nn y ON y.function_id = id2)"""


def _funcs(s, d):
    """The orders' functions, written once as the stored state is."""
    return written(ingest.functions(src.order_uploads(s, d)), "order-functions")


def _text(column: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep).alias(column)


# ------------------------------------------------------------------ uploads

_FILES = """SELECT 'o' || o_orderkey AS file_md5, 'idx:main:file:o' || o_orderkey AS file_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'o' || o_orderkey || '.bin' END AS file_name, o_orderpriority AS batch_uuid, o_orderstatus AS language_id,
  o_orderpriority AS tags, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS entry_date, CAST(1 AS BIGINT) AS n_functions FROM orders"""


@query(_FILES)
def ingest_files(s, d):
    return ingest.files(src.order_uploads(s, d)).select("file_md5", "file_id", "file_name", "batch_uuid", "language_id", F.array_join("tags", ",").alias("tags"), "entry_date", "n_functions")


@query("""SELECT 'idx:main:func:o' || o_orderkey || ':' || lower(hex(o_orderkey)) AS function_id, 'o' || o_orderkey AS file_md5, lower(hex(o_orderkey)) AS address, 'fn_' || o_orderkey AS function_name, o_orderpriority AS batch_uuid, o_orderstatus AS language_id,
  o_orderstatus AS tags, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS bsim_features_count FROM orders WHERE o_orderkey % 10 <> 0""")
def ingest_functions_without_thunks(s, d):
    f = ingest.functions(src.order_uploads(s, d), skip_thunks=True)
    return f.select("function_id", "file_md5", "address", "function_name", "batch_uuid", "language_id", F.array_join("tags", ",").alias("tags"), "bsim_features_count")


@query(f"WITH {ITEMS} SELECT function_id, k AS idx, text, token_type AS type, line, addr FROM it")
def ingest_tokens(s, d):
    return ingest.tokens(_funcs(s, d)).select("function_id", "idx", "text", "type", "line", "addr")


@query(f"WITH {ITEMS} SELECT function_id, k AS pos, hash, type, pcode_op, pcode_op_full, {SEQ} AS seq, CAST(line AS VARCHAR) AS line_idx, CAST(k AS VARCHAR) AS addr_to_token_idx FROM it")
def ingest_feature_occurrences(s, d):
    """Token references come as lists and as numbers; both become lists."""
    return ingest.feature_occurrences(_funcs(s, d)).select("function_id", "pos", "hash", "type", "pcode_op", "pcode_op_full", "seq", _text("line_idx"), _text("addr_to_token_idx"))


@query(f"WITH {ITEMS}, {IVEC} SELECT function_id, hash, tf FROM iv")
def ingest_vectors(s, d):
    return ingest.vectors(_funcs(s, d)).select("function_id", "hash", "tf")


@query(f"WITH {ITEMS} SELECT function_id, hash, CAST(count(*) AS BIGINT) AS tf FROM it GROUP BY 1, 2")
def upload_dump_reload(s, d):
    """The uploads are dumped as JSON, read again and counted from their occurrences."""
    path = scratch(s, "dump")
    upload.write_uploads(src.order_uploads(s, d), path)
    return vectors.term_frequencies(ingest.feature_occurrences(ingest.functions(upload.read_dump(s, path)))).select("function_id", "hash", "tf")


_REGIONS = "SELECT '{0}' AS read, 'r' || r_regionkey AS file_md5, r_name AS file_name, CAST(count(*) AS BIGINT) AS n_functions FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL"


@query(_REGIONS.format("all") + " UNION ALL (" + _REGIONS.format("replay") + " ORDER BY file_md5 LIMIT 3)")
def upload_files(s, d):
    """One JSON document for each file, read at once, and replayed by name up to a limit."""
    path = scratch(s, "uploads")
    upload.write_uploads(src.nation_uploads(s, d), path, folders=None)
    both = [("all", upload.read_uploads(s, path)), ("replay", upload.replay(s, path, 3).drop("source_file"))]
    out = [ingest.files(u.drop("at")).select(F.lit(name).alias("read"), "file_md5", "file_name", "n_functions") for name, u in both]
    return out[0].unionByName(out[1])


@query(f"WITH {NVEC}, {NSIMS} SELECT 'idx:main:sim:unweighted_cosine:' || id1 || ':' || id2 AS sid, round(raw, 4) AS score FROM ns WHERE raw >= 0.5")
def stream_pipeline(s, d):
    """Uploads as a file stream, two files a micro-batch, through all four stages; a second run
    resumes at the checkpoint and finds nothing new."""
    from ..streaming import pipeline

    root, source = scratch(s, "state"), scratch(s, "uploads")
    upload.write_uploads(src.nation_uploads(s, d), source, folders=None)
    for _ in range(2):
        pipeline.run_stream(s, f"{source}/*", root, f"{root}-checkpoint", files_per_batch=2, min_score=0.5)
    return pipeline.read_state(s, root, "sims").select("sid", "score")


@query(f"WITH {NVEC} SELECT function_id, hash, tf FROM nv")
def stream_vectors(s, d):
    """The feature table that the stream's third stage leaves."""
    from ..streaming import pipeline

    root, source = scratch(s, "state"), scratch(s, "uploads")
    upload.write_uploads(src.nation_uploads(s, d), source, folders=None)
    pipeline.run_stream(s, f"{source}/*", root, f"{root}-checkpoint", files_per_batch=1, min_score=0.5)
    return pipeline.read_state(s, root, "vec_tf").select("function_id", "hash", "tf")


# ------------------------------------------------------------------ features and views

@query(f"""WITH {ITEMS}, {IVEC}, {CTX}, {TEXT}, st AS (SELECT hash, CAST(count(*) AS BIGINT) AS frequency, CAST(sum(tf * tf) AS BIGINT) AS tf_score, CAST(sum(tf) AS BIGINT) AS total_tf FROM iv GROUP BY 1 ORDER BY tf_score DESC, hash DESC LIMIT 40),
  fc AS (SELECT * FROM ctx QUALIFY row_number() OVER (PARTITION BY hash ORDER BY function_id) = 1)
  SELECT st.*, fc.function_id, fc.type, fc.pcode_op, fc.line, lt.line_text FROM st JOIN fc USING (hash) JOIN lt ON lt.function_id = fc.function_id AND lt.line = fc.line""")
def feature_context_page(s, d):
    f = _funcs(s, d)
    page = features.search_features(ingest.vectors(f), "p", "tf", 0, 40)
    return features.with_context(page, vectors.last_context(ingest.feature_occurrences(f)), ingest.tokens(f)).drop("collection")


@query(f"""WITH {ITEMS}, {IVEC}, {CTX}, own AS (SELECT * FROM iv WHERE hash = 'p7'), fl AS (SELECT function_id, min(pcode_op_full) AS pf, min({SEQ}) AS sq FROM it WHERE hash = 'p7' GROUP BY 1)
  SELECT own.function_id, own.tf, c.type, c.pcode_op, coalesce(c.pcode_op_full, pf) AS pcode_op_full, coalesce(c.seq, sq) AS seq, CAST(c.line AS VARCHAR) AS line_idx,
  (SELECT CAST(count(*) AS BIGINT) FROM own) AS occurrence_count, (SELECT CAST(sum(tf) AS BIGINT) FROM own) AS total_occurrences FROM own JOIN ctx c USING (function_id, hash) JOIN fl USING (function_id) ORDER BY own.function_id LIMIT 1000""")
def feature_details_page(s, d):
    """Fields that a function's last occurrence lacks come from its other ones."""
    f = _funcs(s, d)
    occ = ingest.feature_occurrences(f)
    out = features.feature_details(ingest.vectors(f), vectors.last_context(occ), occ, "p7")
    return out.select("function_id", "tf", "type", "pcode_op", "pcode_op_full", "seq", _text("line_idx"), "occurrence_count", "total_occurrences")


@query(f"""WITH {ITEMS}, {TEXT}, sn AS (SELECT function_id, hash, type, line, min(k) AS k FROM it GROUP BY 1, 2, 3, 4)
  SELECT function_id, hash, type, string_agg(line || '=' || line_text, '|' ORDER BY k) AS lines FROM sn JOIN lt USING (function_id, line) GROUP BY 1, 2, 3""")
def feature_lines(s, d):
    f = _funcs(s, d)
    rows = align.feature_view(ingest.feature_occurrences(f), ingest.tokens(f))
    return rows.select("function_id", "hash", "type", F.array_join(F.transform("lines", lambda x: F.concat(x["line"].cast("string"), F.lit("="), x["text"])), "|").alias("lines"))


def _next_common(s, d, vec):
    """The features that each order's function shares with that of the next order key."""
    o = src.table(s, d, "orders").select("o_orderkey")
    fid = lambda k: F.concat(F.lit("idx:main:func:o"), k.cast("string"), F.lit(":"), F.lower(F.hex(k)))
    k = F.col("o_orderkey")
    wanted = o.select(F.lit("main").alias("collection1"), fid(k).alias("id1"), F.lit("main").alias("collection2"), fid(k + 1).alias("id2"))
    return align.common_hashes(vec, wanted).select(F.col("collection1").alias("collection"), F.col("id1").alias("function_id"), "hashes")


_COMMON = "cm AS (SELECT DISTINCT a.function_id, a.hash FROM iv a JOIN iv b ON b.o = a.o + 1 AND b.hash = a.hash)"


@query(f"WITH {ITEMS}, {IVEC}, {_COMMON} SELECT it.function_id, k AS idx, CASE WHEN cm.hash IS NOT NULL THEN 'match' ELSE 'unique' END AS diff_class FROM it LEFT JOIN cm USING (function_id, hash)")
def token_classes(s, d):
    f = _funcs(s, d)
    common = _next_common(s, d, ingest.vectors(f))
    return align.token_classes(ingest.tokens(f), align.token_features(ingest.feature_occurrences(f)), common).select("function_id", "idx", "diff_class")


@query(f"""WITH {ITEMS}, {IVEC}, {_COMMON} SELECT it.function_id, k AS idx, hash || '/' || pcode_op || '/' || coalesce(pcode_op_full, '-') || '/' || type || '/' || coalesce({SEQ}, '-') || '/' || addr || '/' || line || '/' || tf || '/' || CASE WHEN cm.hash IS NOT NULL THEN '#00ff00' ELSE '#ff003c' END AS tips
  FROM it JOIN iv USING (function_id, hash) LEFT JOIN cm USING (function_id, hash)""")
def token_tips(s, d):
    f = _funcs(s, d)
    vec = ingest.vectors(f)
    rows = align.token_tips(ingest.feature_occurrences(f), vec, _next_common(s, d, vec))
    shown = lambda t: F.concat_ws("/", t["hash"], t["pcode_op"], F.coalesce(t["pcode_op_full"], F.lit("-")), t["type"], F.coalesce(t["seq"], F.lit("-")), t["addr"], F.array_join(F.transform(t["line_idx"], lambda n: n.cast("string")), "+"), t["tf"], t["colour"])
    return rows.select("function_id", "idx", F.array_join(F.transform("tips", shown), ",").alias("tips"))


@query(f"WITH {ITEMS} SELECT function_id, line, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS token_idx, string_agg(DISTINCT addr, ',' ORDER BY addr) AS addresses FROM it GROUP BY 1, 2")
def line_token_map(s, d):
    return align.line_to_token(ingest.tokens(_funcs(s, d))).select("function_id", "line", _text("token_idx"), F.array_join("addresses", ",").alias("addresses"))


@query(f"WITH {ITEMS} SELECT function_id, line, text, k AS idx FROM it")
def token_numbers(s, d):
    """Numbers over a whole function from the tokens of its lines."""
    t = ingest.tokens(_funcs(s, d))
    lines = t.groupBy("collection", "function_id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("tokens"))
    return align.token_index(lines).select("function_id", "line", "text", "idx")


@query(f"WITH {ITEMS} SELECT function_id, line, arg_min(addr, k) AS address FROM it GROUP BY 1, 2")
def line_first_addresses(s, d):
    return align.line_addresses(_funcs(s, d)).select("function_id", "line", "address")


@query(f"WITH {ITEMS} SELECT 'idx:main:func:o' || o_orderkey || ':' || lower(hex(o_orderkey)) AS function_id, coalesce((SELECT string_agg(text, '' ORDER BY k) FROM it WHERE o = o_orderkey AND line = 2), '') AS third_line FROM orders")
def third_lines(s, d):
    """The third line's text from each function's nested tokens, without unnesting them."""
    return _funcs(s, d).select("function_id", values.line_text(F.col("source.c_tokens"), F.lit(2)).alias("third_line"))


_EDITED = """ln AS (SELECT function_id, k, count(*) OVER (PARTITION BY function_id) AS n FROM it)"""


@query(f"""WITH {ITEMS}, {_EDITED} SELECT function_id, CASE WHEN k = 0 THEN CASE WHEN n = 1 THEN 'replace' ELSE 'delete' END ELSE 'equal' END AS tag, k AS row_idx, CASE WHEN k = 0 THEN 0 ELSE 1 END AS chunk_id, k + 1 AS l_line, CASE WHEN k = 0 THEN CASE WHEN n = 1 THEN 1 END ELSE k END AS r_line FROM ln
  UNION ALL SELECT DISTINCT function_id, 'insert', n, 2, NULL, n FROM ln WHERE n > 1""")
def aligned_diff_edits(s, d):
    """Each function against itself without its first line and with another one at its end."""
    t = ingest.tokens(_funcs(s, d))
    left = t.select("collection", "function_id", F.col("idx").alias("line"), F.concat_ws("-", "idx", "text").alias("identity"))
    edited = lambda c: F.concat(c, F.lit("-edited")).alias("function_id")
    right = left.where("line > 0").select("collection", edited(F.col("function_id")), F.col("line") - 1, "identity")
    ends = left.groupBy("collection", "function_id").agg(F.max("line").alias("line")).select("collection", edited(F.col("function_id")), "line", F.lit("another").alias("identity"))
    wanted = left.select("collection", "function_id").distinct().select(F.col("collection").alias("collection1"), F.col("function_id").alias("id1"), F.col("collection").alias("collection2"), edited(F.col("function_id")).alias("id2"))
    out = align.aligned_diff(left.unionByName(right.withColumnRenamed("(line - 1)", "line")).unionByName(ends), wanted)
    return out.select(F.split_part("pair_id", F.lit("|"), F.lit(1)).alias("function_id"), "tag", "row_idx", "chunk_id", "l_line", "r_line")


# ------------------------------------------------------------------ search totals, states, counts

@query(BASE + ", hit AS (SELECT * FROM sims WHERE min_features >= 30) SELECT sid, score, min_features, (SELECT CAST(count(*) AS BIGINT) FROM hit) AS total FROM hit ORDER BY score DESC, sid LIMIT 20 OFFSET 10")
def similarity_search_total(s, d):
    f = src.customer_functions(s, d)
    hits = written(search.search_pairs(_sims(s, d), f, src.files_of(f), "main", min_score=MIN, min_features=30), "hits")
    return search.with_total(_brief(search.pair_page(hits, offset=10, limit=20)), hits)


@query(BASE + ", n AS (SELECT count(*) AS n FROM sims), lm AS (SELECT unnest([0, 200, 2000000]) AS asked) SELECT CAST(asked AS BIGINT) AS asked, CAST(greatest(1, least(asked, 1000000)) AS BIGINT) AS pool, CAST(least(n, greatest(1, least(asked, 1000000))) AS BIGINT) AS candidates, n >= greatest(1, least(asked, 1000000)) AS pool_truncated FROM lm, n")
def pool_status(s, d):
    sims = written(_sims(s, d), "sims")
    rows = [search.pool_status(sims, "main", min_score=MIN, pool_limit=n).withColumn("asked", F.lit(n).cast("long")) for n in (0, 200, 2_000_000)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {VEC}, st AS (SELECT hash, CAST(count(*) AS BIGINT) AS frequency FROM vec WHERE hash LIKE '1%' GROUP BY 1) SELECT hash, frequency, (SELECT CAST(count(*) AS BIGINT) FROM st) AS total FROM st ORDER BY hash LIMIT 30")
def feature_search_total(s, d):
    v = src.customer_vectors(s, d)
    hits = features.search_features(v, "1", "default", 0, 30).select("hash", "frequency")
    return search.with_total(hits, v.where(F.startswith("hash", F.lit("1"))).select("hash").distinct())


@query(f"WITH {ORD} SELECT function_id, function_name, price FROM od WHERE o_orderkey = 77")
def function_lookup(s, d):
    f = src.order_functions(s, d)
    wanted = src.table(s, d, "orders").where("o_orderkey = 77").select("o_custkey").first()[0]
    return search.find(f, "function_id", f"idx:main:func:{wanted}:77").select("function_id", "function_name", "price")


@query(f"WITH {JOBS} SELECT id, type, status, progress FROM jb WHERE id = '123'")
def job_lookup(s, d):
    return search.find(src.event_jobs(s, d), "id", "123").select("id", "type", "status", "progress")


@query(BASE + f""", sj AS (SELECT 1 FROM raw WHERE (CASE WHEN ta + tb - least_sum > 0 THEN CAST(least_sum AS DOUBLE) / (ta + tb - least_sum) ELSE 0.0 END) >= {MIN})
  SELECT 'main' AS collection, (SELECT CAST(count(*) AS BIGINT) FROM sims) AS sims_unweighted_cosine, (SELECT CAST(count(*) AS BIGINT) FROM sj) AS sims_jaccard""")
def index_status_algos(s, d):
    v, f = src.customer_vectors(s, d), src.customer_functions(s, d)
    return stats.pair_counts(similarity.build_algos(v, f, min_score=MIN))


@query(BASE + BRIEF + "WHERE EXISTS (SELECT 1 FROM fn WHERE batch_uuid = '1' AND function_id IN (id1, id2)) ORDER BY score DESC, sid LIMIT 30")
def similarity_list_batch(s, d):
    sims = written(_sims(s, d), "sims")
    own = similarity.involves(sims).join(state.targets_of(src.customer_functions(s, d), batch="1"), ["collection", "function_id"], "left_semi").select("sid")
    return _brief(search.pair_page(sims.join(own, "sid", "left_semi"), limit=30))


@query(BASE + "SELECT id1, id2, score FROM sims JOIN fn a ON a.function_id = id1 JOIN fn b ON b.function_id = id2 WHERE abs(a.c_custkey - b.c_custkey) = 1")
def cached_pair_lookup(s, d):
    """Neighbours by key, asked for in the order of their keys, whichever id is the greater."""
    f = src.customer_functions(s, d).select("collection", "function_id", "c_custkey")
    nxt = f.select(F.col("function_id").alias("id2"), (F.col("c_custkey") - 1).alias("c_custkey"))
    wanted = f.join(nxt, "c_custkey").select("collection", F.col("function_id").alias("id1"), "id2")
    return similarity.cached_pair(_sims(s, d), wanted, "unweighted_cosine").select("id1", "id2", "score")


@query(BASE + "SELECT sid, score, (SELECT CAST(count(*) AS BIGINT) FROM fn) AS built FROM sims")
def incremental_tables(s, d):
    """The pair table and the built set after a third of the functions was built before."""
    f, v = src.customer_functions(s, d), src.customer_vectors(s, d)
    first = f.where("c_custkey % 3 = 0")
    old = written(similarity.build_pairs(v.join(first, ["collection", "function_id"], "left_semi"), first, min_score=MIN), "first-build")
    pairs, built = similarity.incremental_build(v, f, old, first.select("collection", "function_id"), min_score=MIN)
    return search.with_total(pairs.select("sid", "score"), built, "built")


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 2 END AS extra FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0""")
def upsert_rows(s, d):
    """Even keys are there; multiples of three are written again, with one more column."""
    n = src.table(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    old, new = n.where("k % 2 = 0").withColumn("v", F.lit("old")), n.where("k % 3 = 0").withColumns({"v": F.lit("new"), "extra": F.col("k") * 2})
    return similarity.upsert(old.withColumn("extra", F.lit(None).cast("long")), new.withColumn("extra", F.col("extra").cast("long")), ["k"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey <> 1")
def wipe_collection(s, d):
    n = src.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("collection"), F.col("n_nationkey").cast("long").alias("k"))
    return state.delete_collection({"rows": n}, "1")["rows"].select("k")


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 25")
def sample_of_rows(s, d):
    return stats.sample_rows(src.table(s, d, "orders"), 25, "o_orderkey", 3).select("o_orderkey")


@query(f"WITH {ORD}, b AS (SELECT file_md5, batch_uuid, count(*) AS n, min(entry_date) AS a, max(entry_date) AS z FROM od GROUP BY 1, 2) SELECT batch_uuid, min(a) AS created_at, max(z) AS last_updated, 'main' AS collections FROM b GROUP BY 1")
def global_batches(s, d):
    return ingest.global_batches(_batch_files(s, d)).select("batch_uuid", "created_at", "last_updated", F.array_join("collections", ",").alias("collections"))


def _batch_files(s, d):
    """A file for each customer and priority, as ingest.files would leave it."""
    f = src.order_functions(s, d)
    return f.groupBy("collection", "batch_uuid", "file_md5", "entry_date").agg(F.count("*").alias("n_functions")).withColumn("batch_name", F.col("batch_uuid"))


@query(f"WITH {ORD} SELECT batch_uuid, 'main:batch:' || batch_uuid AS batch_id, batch_uuid AS name, CAST(count(DISTINCT (file_md5, entry_date)) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS total_functions, min(entry_date) AS created_at, max(entry_date) AS last_updated FROM od GROUP BY 1")
def batch_totals(s, d):
    return ingest.batches(_batch_files(s, d)).drop("collection")


@query(f"WITH {ORD} SELECT 'main' AS collection, CAST(count(DISTINCT (file_md5, entry_date, batch_uuid)) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS total_functions, max(entry_date) AS last_updated FROM od")
def collection_totals(s, d):
    return ingest.collections(_batch_files(s, d))


_SEGMENTS = "r_name AS collection, c_mktsegment AS batch_uuid, c_nationkey AS file_md5 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT batch_uuid, collection || ':batch:' || batch_uuid AS batch_id, CAST(count(DISTINCT file_md5) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS total_functions FROM (SELECT {_SEGMENTS}) WHERE collection = 'ASIA' GROUP BY batch_uuid, collection")
def collection_batches(s, d):
    """Regions as collections, market segments as batches, nations as files."""
    f = src.customer_functions(s, d).join(src.table(s, d, "region"), F.col("batch_uuid") == F.col("r_regionkey").cast("string"))
    files = f.groupBy(F.col("r_name").alias("collection"), F.col("language_id").alias("batch_uuid"), "file_md5").agg(F.count("*").alias("n_functions"), F.min("c_custkey").alias("entry_date")).withColumn("batch_name", F.col("batch_uuid"))
    return ingest.collection_batches(files, "ASIA").select("batch_uuid", "batch_id", "total_files", "total_functions")


@query(f"""WITH {FN}, fl AS (SELECT DISTINCT file_md5, batch_uuid FROM fn), tg AS (SELECT unnest(['debt', 'Rich', 'region 1', 'machinery', 'unused']) AS tag),
  us AS (SELECT lower(tag) AS low FROM fn UNION ALL SELECT lower(user_tag) FROM fn WHERE user_tag IS NOT NULL UNION ALL SELECT 'region ' || batch_uuid FROM fl) SELECT tag, CAST(count(low) AS BIGINT) AS count FROM tg LEFT JOIN us ON lower(tag) = low GROUP BY tag""")
def tag_counts_by_level(s, d):
    """Uses on functions and on files together; a file is tagged with its region."""
    f = src.customer_functions(s, d)
    files = src.files_of(f).withColumn("tags", F.array(F.concat(F.lit("Region "), F.col("batch_uuid"))))
    meta = s.createDataFrame([("main", t, None, 0) for t in ("debt", "Rich", "region 1", "machinery", "unused")], "collection string, tag string, color string, priority long")
    return tags.tag_counts(meta, {"func": f, "file": files}).select("tag", "count")


_PALETTE = "['#FF5555', '#50FA7B', '#F1FA8C', '#BD93F9', '#FF79C6', '#8BE9FD', '#FFB86C', '#A6E22E', '#66D9EF']"


@query(f"""WITH t AS (SELECT DISTINCT p_name AS tag FROM part) SELECT tag, CASE WHEN tag LIKE 'a%' THEN '#123456' ELSE ({_PALETTE})[CAST('0x' || substr(md5(tag), 1, 8) AS BIGINT) % 9 + 1] END AS color, CAST(CASE WHEN tag LIKE '%e' THEN 5 ELSE 0 END AS BIGINT) AS priority FROM t
  UNION ALL SELECT 'never used', '#66d9ef', CAST(7 AS BIGINT)""")
def tag_registry(s, d):
    """Part names as tags: each gets a palette colour; some then get a colour, a priority or both,
    and one that nothing uses is entered."""
    used = src.table(s, d, "part").select(F.lit("main").alias("collection"), F.col("p_name").alias("tag")).distinct()
    empty = s.createDataFrame([], "collection string, tag string, color string, priority long")
    known = written(tags.register(empty, used), "tags")
    changes = used.where("tag like 'a%' or tag like '%e'").select("collection", "tag", F.when(F.startswith("tag", F.lit("a")), "#123456").alias("color"), F.when(F.endswith("tag", F.lit("e")), 5).cast("long").alias("priority"))
    changes = changes.unionByName(s.createDataFrame([("main", "never used", None, 7)], changes.schema))
    return tags.set_metadata(known, changes).select("tag", "color", "priority")


# ------------------------------------------------------------------ jobs

@query(f"""WITH {JOBS}, r AS (SELECT count(*) FILTER (WHERE status = 'running') AS n, sum(speed) FILTER (WHERE status = 'running') AS sp, sum(100 - processed_items) FILTER (WHERE status = 'running') AS rest FROM jb)
  SELECT round(sp / n, 3) AS avg_speed, round(rest / sp, 3) AS global_eta FROM r""")
def job_speed_and_eta(s, d):
    return jobs.job_stats(src.event_jobs(s, d)).select(F.round("avg_speed", 3).alias("avg_speed"), F.round("global_eta", 3).alias("global_eta"))


_NOW = "CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 977 END"


@query(f"""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN {_NOW} > 0 THEN (event_id % 97) / ({_NOW} / 1000.0::DOUBLE) ELSE 0.0 END AS speed,
  CASE WHEN {_NOW} > 0 AND event_id % 97 > 0 THEN (100 - event_id % 97) / ((event_id % 97) / ({_NOW} / 1000.0::DOUBLE)) ELSE 0.0 END AS eta FROM events""")
def job_eta(s, d):
    """Jobs that were created up to a second ago; some just now, some with nothing done."""
    j = src.event_jobs(s, d).withColumns({"created_at": F.lit(0).cast("long"), "n": F.col("id").cast("long")})
    j = j.withColumn("now_ms", F.when(F.pmod("n", F.lit(4)) == 0, 0).otherwise(F.pmod("n", F.lit(977))).cast("long"))
    return jobs.with_eta(j).select("id", "speed", "eta")


@query(f"""WITH {OPS}, r AS (SELECT op, sum("time") AS total, coalesce(sum("time") FILTER (WHERE cat = 'db_queries'), 0.0) AS db, coalesce(sum("time") FILTER (WHERE cat = 'lua_scripts'), 0.0) AS lua, CAST(count(*) AS BIGINT) AS ops_count FROM op GROUP BY ROLLUP (op))
  SELECT op, round(greatest(0.0, total - db - lua), 2) AS python, round(db / total * 100, 1) AS db_percent, round(lua / total * 100, 1) AS lua_percent, round(greatest(0.0, total - db - lua) / total * 100, 1) AS python_percent, ops_count FROM r""")
def perf_percentages(s, d):
    r = jobs.perf_percent(jobs.perf_rollup(src.event_ops(s, d), ["op"]))
    return r.select("op", F.round("python", 2).alias("python"), "db_percent", "lua_percent", "python_percent", "ops_count")


@query(f"WITH {JOBS} SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM jb WHERE status = 'pending' ORDER BY created_at, id LIMIT 100")
def runnable_jobs(s, d):
    """The first hundred of the queue, with their places."""
    from pyspark.sql import Window

    first = jobs.runnable(src.event_jobs(s, d)).limit(100)
    return first.select("id", F.row_number().over(Window.orderBy("created_at", "id")).cast("long").alias("place"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'running' AND CAST(id AS BIGINT) % 3 <> 0 THEN CASE WHEN speed > 20 THEN 'completed' ELSE 'failed' END ELSE status END AS status FROM jb")
def job_transitions(s, d):
    """Two thirds of the jobs report a result; only running ones change."""
    j = src.event_jobs(s, d)
    results = j.where("cast(id as bigint) % 3 <> 0").select("id", (F.col("speed") > 20).alias("ok"))
    return jobs.finished(j, results).select("id", "status")


@query(f"""WITH {JOBS}, st AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY created_at, id) AS stage FROM (SELECT id, parent_id, created_at, CASE WHEN CAST(id AS BIGINT) % 2 = 0 OR status = 'pending' THEN 'pending' ELSE 'completed' END AS status FROM jb)),
  f AS (SELECT parent_id, min(stage) AS s FROM st WHERE status <> 'completed' GROUP BY 1) SELECT id, st.parent_id, stage FROM st JOIN f ON f.parent_id = st.parent_id AND f.s = st.stage WHERE status = 'pending'""")
def next_pipeline_stages(s, d):
    from pyspark.sql import Window

    j = src.event_jobs(s, d)
    j = j.withColumn("status", F.when((F.col("id").cast("long") % 2 == 0) | (F.col("status") == "pending"), "pending").otherwise("completed"))
    j = j.withColumn("stage", F.row_number().over(Window.partitionBy("parent_id").orderBy("created_at", "id")).cast("long"))
    return jobs.next_stages(j).select("id", "parent_id", "stage")


# ------------------------------------------------------------------ expressions

_K = "idx:main:func:' || o_custkey || ':' || lower(hex(o_orderkey))"


@query(f"""SELECT o_orderkey, greatest('{_K}, 'idx:main:func:9:1') AS first_id, least('{_K}, 'idx:main:func:9:1') AS second_id FROM orders""")
def pair_id_ends(s, d):
    o = src.table(s, d, "orders")
    fid = ids.function_id(F.lit("main"), F.col("o_custkey").cast("string"), F.lower(F.hex("o_orderkey")))
    one, two = ids.pair_ends(ids.pair_id(F.lit("main"), F.lit("jaccard"), fid, F.lit("idx:main:func:9:1")), F.lit("main"))
    return o.select("o_orderkey", one.alias("first_id"), two.alias("second_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'given' WHEN o_orderkey % 5 <> 0 THEN 'idx:main:func:m' || o_custkey || ':' || o_orderkey END AS function_id, 'idx:main:file:m' || o_custkey AS file_id, 'main:batch:' || o_orderpriority AS batch_id FROM orders""")
def missing_ids(s, d):
    """A third of the rows has a function id; of the others every fifth lacks the address."""
    o = src.table(s, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        "o_orderkey", F.lit("main").alias("collection"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("file_md5"), F.when(k % 5 != 0, k.cast("string")).alias("entrypoint_address"),
        F.col("o_orderpriority").alias("batch_uuid"), F.when(k % 3 == 0, "given").alias("function_id"))
    return ids.with_missing_ids(rows).select("o_orderkey", "function_id", "file_id", "batch_id")


@query("""SELECT o_orderkey, CASE WHEN z < 1024 THEN printf('%.1f B', z) WHEN z < 1048576 THEN printf('%.1f KB', z / 1024) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576) ELSE printf('%.1f GB', z / 1073741824) END AS shown,
  greatest(1, least(o_orderkey, 1000)) AS clamped, substr('order number ' || o_orderkey || ' of ' || o_custkey, 1, 18) AS short, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, md5('{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}') AS digest,
  CASE o_orderkey % 4 WHEN 0 THEN 'variable' WHEN 1 THEN 'func_call' WHEN 2 THEN 'op' ELSE 'text' END AS token_type FROM (SELECT *, CAST(o_orderkey * o_orderkey * 64 AS DOUBLE) AS z FROM orders)""")
def display_expressions(s, d):
    o, k = src.table(s, d, "orders"), F.col("o_orderkey")
    cls = F.when(k % 4 == 0, "ClangVariableToken").when(k % 4 == 1, "ClangFuncNameToken").when(k % 4 == 2, "ClangOpToken").otherwise("Other")
    return o.select(
        "o_orderkey", ids.fmt_bytes((k * k * 64).cast("double"), "GB").alias("shown"), values.clamp(k, 1, 1000).cast("long").alias("clamped"), values.shortened(F.concat(F.lit("order number "), k.cast("string"), F.lit(" of "), F.col("o_custkey").cast("string")), 18).alias("short"),
        values.shown_time(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("day"), ids.json_digest(F.struct(k.alias("k"), F.col("o_orderstatus").alias("s"))).alias("digest"), ids.token_type(cls).alias("token_type"))


@query(f"""WITH {ITEMS}, {IVEC}, sh AS (SELECT a.o, sum(a.tf * b.tf) AS dot, sum(least(a.tf, b.tf)) AS m, string_agg(a.hash, ',' ORDER BY a.hash) AS keys FROM iv a JOIN iv b ON b.o = a.o + 1 AND b.hash = a.hash GROUP BY 1)
  SELECT o_orderkey, CAST(coalesce(dot, 0) AS BIGINT) AS dot, CAST(coalesce(m, 0) AS BIGINT) AS min_sum, coalesce(keys, '') AS keys, CAST(coalesce((SELECT tf FROM iv WHERE iv.o = o_orderkey AND hash = 'p7'), -1) AS BIGINT) AS p7
  FROM orders LEFT JOIN sh ON sh.o = o_orderkey WHERE o_orderkey + 1 IN (SELECT o_orderkey FROM orders)""")
def map_expressions(s, d):
    """Sparse vectors as maps: each order's against that of the next order key."""
    f = _funcs(s, d).select(F.conv("address", 16, 10).cast("long").alias("o_orderkey"), values.tf_map(F.col("features.bsim_features_tf")).alias("m"))
    nxt = f.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("m").alias("n"))
    m, n = F.col("m"), F.col("n")
    return f.join(nxt, "o_orderkey").select(
        "o_orderkey", values.map_dot(m, n).alias("dot"), values.map_min_sum(m, n).alias("min_sum"), F.array_join(F.sort_array(values.common_keys(m, n)), ",").alias("keys"), values.lookup(m, F.lit("p7"), F.lit(-1).cast("long")).alias("p7"))


@query("SELECT event_id, CAST(0 AS BIGINT) AS partial FROM events")
def partial_dates(s, d):
    """Years and months alone aren't dates."""
    e = src.table(s, d, "events")
    text = F.when(F.pmod("event_id", F.lit(2)) == 0, F.date_format("ts", "yyyy")).otherwise(F.date_format("ts", "yyyy-MM"))
    return e.select("event_id", values.millis_text(text).alias("partial"))
