"""From upload documents to files, functions, tokens, feature occurrences and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import address_of, batch_id, file_id, function_id
from ..functions.values import as_array
from ..sources.upload import upload_key


def files(uploads: DataFrame) -> DataFrame:
    """One row per file; values come from the metadata, then from the envelope."""
    u = upload_key(uploads)
    m = F.col("file_metadata")
    return u.select(
        "collection", "file_md5", file_id(F.col("collection"), F.col("file_md5")).alias("file_id"),
        F.coalesce(F.nullif(m["file_name"], F.lit("")), F.lit("unknown")).alias("file_name"),
        F.coalesce(F.nullif(m["batch_uuid"], F.lit("")), F.lit("unknown")).alias("batch_uuid"), m["batch_name"].alias("batch_name"), m["batch_order"].alias("batch_order"),
        m["language_id"].alias("language_id"), F.coalesce(m["tags"], F.array().cast("array<string>")).alias("tags"), m["entry_date"].alias("entry_date"), m["file_date"].alias("file_date"),
        F.coalesce(F.size("functions"), F.lit(0)).cast("long").alias("n_functions"))


def functions(uploads: DataFrame, skip_thunks: bool = False) -> DataFrame:
    """One row per function, with its source and features still nested."""
    u = upload_key(uploads)
    rows = u.select("collection", "file_md5", F.col("file_metadata.batch_uuid").alias("file_batch"), F.explode("functions").alias("f"))
    m = F.col("f.function_metadata")
    if skip_thunks:
        rows = rows.where(~F.coalesce(m["is_thunk"], F.lit(False)))
    md5 = F.coalesce(F.nullif(m["file_md5"], F.lit("")), F.col("file_md5"))
    address = F.coalesce(address_of(m["full_id"]), F.lit("unknown_addr"))
    return rows.select(
        "collection", md5.alias("file_md5"), address.alias("address"), function_id(F.col("collection"), md5, address).alias("function_id"),
        m["function_name"].alias("function_name"), m["file_name"].alias("file_name"), F.coalesce(m["batch_uuid"], F.col("file_batch")).alias("batch_uuid"), m["batch_name"].alias("batch_name"),
        m["language_id"].alias("language_id"), m["decompiler_id"].alias("decompiler_id"), m["calling_convention"].alias("calling_convention"), m["return_type"].alias("return_type"),
        m["entrypoint_address"].alias("entrypoint_address"), m["instruction_count"].alias("instruction_count"), m["is_thunk"].alias("is_thunk"),
        F.coalesce(m["tags"], F.array().cast("array<string>")).alias("tags"), m["entry_date"].alias("entry_date"), m["file_date"].alias("file_date"),
        F.coalesce(m["bsim_features_count"], F.lit(0)).alias("bsim_features_count"), F.col("f.function_source").alias("source"), F.col("f.function_features").alias("features"))


def tokens(funcs: DataFrame) -> DataFrame:
    """One row per source token, with its global index."""
    return funcs.select("collection", "function_id", F.posexplode("source.c_tokens").alias("idx", "tok")).select("collection", "function_id", F.col("idx").cast("long").alias("idx"), "tok.*").withColumnRenamed("t", "text")


def feature_occurrences(funcs: DataFrame) -> DataFrame:
    """One row per feature occurrence; polymorphic fields coerced."""
    rows = funcs.select("collection", "function_id", F.posexplode("features.bsim_features_meta").alias("pos", "o")).select("collection", "function_id", F.col("pos").cast("long").alias("pos"), "o.*")
    return rows.withColumns({"pcode_block": F.from_json("pcode_block", "map<string,string>"), "addr_to_token_idx": as_array(F.col("addr_to_token_idx"))})


def vectors(funcs: DataFrame) -> DataFrame:
    """vec_tf from the stored tf lists; a hash that is listed twice counts its last entry."""
    rows = funcs.select("collection", "function_id", F.posexplode("features.bsim_features_tf").alias("p", "x")).select("collection", "function_id", F.col("x.hash").alias("hash"), F.col("x.tf").alias("tf"), "p")
    return rows.groupBy("collection", "function_id", "hash").agg(F.max_by("tf", "p").alias("tf"))


def batches(files_: DataFrame) -> DataFrame:
    """Totals of each batch in each collection."""
    return files_.groupBy("collection", "batch_uuid").agg(
        F.max("batch_name").alias("name"), F.count("*").alias("total_files"), F.sum("n_functions").alias("total_functions"),
        F.min("entry_date").alias("created_at"), F.max("entry_date").alias("last_updated")).withColumn("batch_id", batch_id(F.col("collection"), F.col("batch_uuid")))


def global_batches(files_: DataFrame) -> DataFrame:
    """Each batch with the collections that hold it."""
    return files_.groupBy("batch_uuid").agg(F.max("batch_name").alias("name"), F.min("entry_date").alias("created_at"), F.max("entry_date").alias("last_updated"), F.sort_array(F.collect_set("collection")).alias("collections"))


def collections(files_: DataFrame) -> DataFrame:
    return files_.groupBy("collection").agg(F.count("*").alias("total_files"), F.sum("n_functions").alias("total_functions"), F.max("entry_date").alias("last_updated"))


def collection_batches(files_: DataFrame, collection: str) -> DataFrame:
    """Of all registered batches, those that a collection has, with their totals there."""
    own = batches(files_.where(F.col("collection") == collection))
    return own.join(global_batches(files_).select("batch_uuid"), "batch_uuid", "left_semi")
