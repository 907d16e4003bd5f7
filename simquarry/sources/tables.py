"""The driver's tables as entities of the engine.

* customers: a customer is a function, its nation the file, its region the batch, its market
  segment the language; the parts it ordered are its features.
* documents: a document is a function, its source the file, its language the batch; its
  three-word shingles are its features, its lines the source lines.
* orders: an order is a function, its customer the file, its priority the batch.
* events: event types are job types, values are durations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
#: Bytes of the documents' files whose shingles one task counts, about.
DEALT_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Few input splits (a small file in one row group) are dealt to all cores before a costly
    expansion; a scan that already has a split for each core is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def customer_functions(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") > 5000, "rich").otherwise("mid")
    return rows.select(
        F.lit("main").alias("collection"), F.concat_ws(":", F.lit("idx:main:func"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("function_id"),
        F.col("c_nationkey").cast("string").alias("file_md5"), F.col("n_name").alias("file_name"), F.col("n_regionkey").cast("string").alias("batch_uuid"), F.col("c_mktsegment").alias("language_id"),
        F.col("c_name").alias("function_name"), F.array(band).alias("tags"),
        F.when(F.col("c_acctbal") > 0, F.array(F.lower("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("user_tags"), F.col("c_acctbal"), F.col("c_custkey"))


def files_of(functions: DataFrame) -> DataFrame:
    """A file table for adapters whose files are known by their functions alone."""
    return functions.groupBy("collection", "file_md5").agg(F.max("file_name").alias("file_name"), F.max("batch_uuid").alias("batch_uuid"), F.count("*").alias("n_functions"))


def customer_vectors(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    rows = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Dealt by customer once, for the count and the join below.
    rows = rows.repartition("o_custkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("tf"))
    rows = rows.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    fid = F.concat_ws(":", F.lit("idx:main:func"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return rows.select(F.lit("main").alias("collection"), fid.alias("function_id"), F.col("l_partkey").cast("string").alias("hash"), "tf")


def document_functions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.lit("main").alias("collection"), _doc_id().alias("function_id"), F.col("source").alias("file_md5"), F.col("source").alias("file_name"), F.col("lang").alias("batch_uuid"), F.col("lang").alias("language_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("function_name"), "n_chars", "doc_id")


def _doc_id():
    return F.concat_ws(":", F.lit("idx:main:func"), F.col("source"), F.col("doc_id").cast("string"))


def document_occurrences(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """One row per shingle occurrence: hash, position and the line it starts on. White space
    separates words; the hash is the first eight hex digits of the shingle's md5. `dealt`: texts
    are dealt by function before they become many rows, which then need no shuffle by function."""
    t = table(spark, d, "documents").select("doc_id", "source", "text", _doc_id().alias("function_id"))
    if dealt:  # a number of partitions that Spark doesn't lessen by the size of the texts
        n = t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // DEALT_BYTES
        t = t.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n), "function_id")
    else:
        t = spread(t)
    t = t.select("function_id", F.split(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"[ \t\n\r]+").alias("w"))
    t = t.where(F.size("w") >= SHINGLE)
    rows = t.select("function_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1))).alias("i"))
    shingle = F.concat_ws(" ", *(F.element_at("w", F.col("i") + k) for k in range(SHINGLE)))
    return rows.select(F.lit("main").alias("collection"), "function_id", F.substring(F.md5(shingle), 1, 8).alias("hash"), F.col("i").cast("long").alias("pos"))


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    return document_occurrences(spark, d, dealt=True).groupBy("collection", "function_id", "hash").agg(F.count("*").alias("tf"))


def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One row per token: lines are split at line feeds, tokens at single spaces."""
    t = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    t = t.select(F.lit("main").alias("collection"), _doc_id().alias("function_id"), F.posexplode(F.split("text", "\n")).alias("line", "l"))
    rows = t.select("collection", "function_id", F.col("line").cast("long").alias("line"), F.posexplode(F.split("l", " ")).alias("k", "text"))
    return rows.select("collection", "function_id", "line", F.col("k").cast("long").alias("idx"), "text")


def order_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.lit("main").alias("collection"), F.concat_ws(":", F.lit("idx:main:func"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("function_id"),
        F.col("o_custkey").cast("string").alias("file_md5"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("file_name"), F.col("o_orderpriority").alias("batch_uuid"), F.col("o_orderstatus").alias("language_id"),
        F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("function_name"), F.array(F.col("o_orderpriority")).alias("tags"),
        F.when(F.col("o_totalprice") > 100000, F.array(F.lit("Big"), F.col("o_orderstatus"))).otherwise(F.array().cast("array<string>")).alias("user_tags"),
        F.col("o_totalprice").alias("price"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("entry_date"), F.col("o_orderkey"))


def event_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs: the user is the pipeline; status and progress follow from the id."""
    e = table(spark, d, "events")
    pick = F.pmod("event_id", F.lit(5))
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("parent_id"),
        F.when(pick == 0, "running").when(pick == 1, "pending").when(pick == 2, "completed").when(pick == 3, "cancelled").otherwise("failed").alias("status"),
        F.pmod("event_id", F.lit(101)).alias("progress"), F.col("value").alias("speed"), F.lit(100).cast("long").alias("total_items"), F.pmod("event_id", F.lit(97)).alias("processed_items"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))


def event_ops(spark: SparkSession, d: str) -> DataFrame:
    """Events as timed operations: clicks and views are store queries, errors are scripts."""
    e = table(spark, d, "events")
    cat = F.when(F.col("event_type").isin("click", "view"), "db_queries").when(F.col("event_type") == "error", "lua_scripts").otherwise("pure_python")
    return e.select(F.col("event_id").alias("op_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("op"), cat.alias("cat"), F.col("value").alias("time"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


def order_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Upload documents, one for each order: the order is the file and its one function, its line
    items are the tokens and the feature occurrences. Line numbers repeat and leave gaps, values are
    missing, and token references come as a list or a number, as in real uploads."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    # An order has a handful of items.
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = o.join(items, o["o_orderkey"] == items["l_orderkey"], "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    key, md5 = F.col("o_orderkey"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    line = lambda x: (x["l_linenumber"] - 1).cast("long")
    addr = lambda x: F.lower(F.hex(x["l_suppkey"]))
    hash_of = lambda x: F.concat(F.lit("p"), F.pmod(x["l_partkey"], F.lit(100)).cast("string"))
    none = lambda kind="string": F.lit(None).cast(kind)
    tokens = F.transform("items", lambda x, k: F.struct(
        F.concat(x["l_returnflag"], x["l_suppkey"].cast("string")).alias("t"), x["l_linestatus"].alias("type"), line(x).alias("line"), addr(x).alias("addr"), k.cast("long").alias("pcode_time"), F.concat(F.lit("q"), k.cast("string")).alias("seq")))
    meta = F.transform("items", lambda x, k: F.struct(
        hash_of(x).alias("hash"), x["l_returnflag"].alias("type"), F.concat(F.lit("OP"), x["l_linestatus"]).alias("pcode_op"),
        F.when(F.pmod(x["l_linenumber"], F.lit(2)) == 1, F.concat(F.lit("FULL"), x["l_suppkey"].cast("string"))).alias("pcode_op_full"), none().alias("previous_pcode_op"), none().alias("previous_seq"),
        F.array(line(x)).alias("line_idx"), F.array().cast("array<long>").alias("seq_to_token_idx"), F.when(k % 2 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(k.cast("string")).alias("addr_to_token_idx"),
        addr(x).alias("addr"), none("long").alias("seq_time"), F.when(x["l_quantity"] > 25, F.concat(F.lit("s"), k.cast("string"))).alias("seq"), F.lit(0).cast("long").alias("block_index"), none().alias("pcode_block")))
    hashes = F.transform("items", hash_of)
    tf = F.transform(F.array_distinct(hashes), lambda h: F.struct(h.alias("hash"), F.size(F.filter(hashes, lambda y: y == h)).cast("long").alias("tf")))
    lines = F.array_distinct(F.transform("items", line))
    line_addr = F.map_from_entries(F.transform(lines, lambda n: F.struct(n.cast("string").alias("key"), F.transform(F.filter("items", lambda x: line(x) == n), addr).alias("value"))))
    when = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    n = F.size("items").cast("long")
    empty = lambda: F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<bigint>>"))
    function = F.struct(
        F.struct(
            F.lit("function").alias("type"), F.concat(F.lit("fn_"), key.cast("string")).alias("function_name"), none().alias("calling_convention"), none().alias("decompiler_id"), when.alias("entry_date"), when.alias("file_date"),
            F.lit("").alias("file_md5"), F.concat(md5, F.lit(".bin")).alias("file_name"), none().alias("batch_uuid"), none().alias("batch_name"), F.col("o_orderstatus").alias("language_id"),
            F.concat(F.lit("m:#m::f:@"), F.lower(F.hex(key))).alias("full_id"), F.array(F.col("o_orderstatus")).alias("tags"), F.array().cast("array<string>").alias("labels"), n.alias("instruction_count"), (key % 10 == 0).alias("is_thunk"),
            none().alias("return_type"), none().alias("entrypoint_address"), n.alias("bsim_features_count"), F.size(F.array_distinct(hashes)).cast("long").alias("bsim_unique_features_count")).alias("function_metadata"),
        F.struct(F.array().cast("array<string>").alias("c_lines"), tokens.alias("c_tokens"), empty().alias("addr_to_line"), empty().alias("addr_to_token"), empty().alias("seq_to_token"), empty().alias("line_to_token"), line_addr.alias("line_to_addr")).alias("function_source"),
        F.struct(meta.alias("bsim_features_meta"), hashes.alias("bsim_features_raw"), tf.alias("bsim_features_tf"), n.alias("bsim_features_count"), F.size(F.array_distinct(hashes)).cast("long").alias("bsim_unique_features_count")).alias("function_features"))
    file = F.struct(
        when.alias("entry_date"), when.alias("file_date"), none().alias("file_md5"), F.when(key % 7 == 0, "").otherwise(F.concat(md5, F.lit(".bin"))).alias("file_name"), F.col("o_orderpriority").alias("batch_uuid"),
        none().alias("batch_name"), none("long").alias("batch_order"), F.array(F.col("o_orderpriority")).alias("tags"), F.col("o_orderstatus").alias("language_id"), none().alias("file_id"))
    return rows.select(F.lit("").alias("collection"), md5.alias("file_md5"), file.alias("file_metadata"), F.array(function).alias("functions"))


def nation_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Upload documents, one for each region, whose functions are its nations (25 in all, at every
    scale). A nation's features are the digits and the parities of the numbers up to its key."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    digits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_nationkey").cast("long")), lambda k: F.concat(F.lit("k"), F.pmod(k * 7 + F.col("n_regionkey"), F.lit(11)).cast("string")))
    tf = F.transform(F.array_distinct(digits), lambda h: F.struct(h.alias("hash"), F.size(F.filter(digits, lambda y: y == h)).cast("long").alias("tf")))
    meta = F.struct(F.col("n_name").alias("function_name"), F.concat(F.lit("m:#m::f:@"), F.lower(F.hex(F.col("n_nationkey").cast("long")))).alias("full_id"), F.lit("x").alias("language_id"))
    functions = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(meta.alias("function_metadata"), F.struct(tf.alias("bsim_features_tf")).alias("function_features")))).alias("functions"))
    rows = r.join(functions, r["r_regionkey"] == functions["n_regionkey"])
    return rows.select(F.lit("main").alias("collection"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("file_md5"), F.struct(F.col("r_name").alias("file_name"), F.lit("b").alias("batch_uuid")).alias("file_metadata"), "functions")
