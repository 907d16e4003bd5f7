"""Upload documents: one nested JSON per binary, as batch source, stream source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILE_META = _struct(entry_date=_L, file_date=_L, file_md5=_S, file_name=_S, batch_uuid=_S, batch_name=_S, batch_order=_L, tags=T.ArrayType(_S), language_id=_S, file_id=_S)
FUNCTION_META = _struct(
    type=_S, function_name=_S, calling_convention=_S, decompiler_id=_S, entry_date=_L, file_date=_L, file_md5=_S, file_name=_S, batch_uuid=_S, batch_name=_S,
    language_id=_S, full_id=_S, tags=T.ArrayType(_S), labels=T.ArrayType(_S), instruction_count=_L, is_thunk=T.BooleanType(), return_type=_S, entrypoint_address=_S,
    bsim_features_count=_L, bsim_unique_features_count=_L)
TOKEN = _struct(t=_S, type=_S, line=_L, addr=_S, pcode_time=_L, seq=_S)
_LONGS = T.MapType(_S, T.ArrayType(_L))
SOURCE = _struct(c_lines=T.ArrayType(_S), c_tokens=T.ArrayType(TOKEN), addr_to_line=_LONGS, addr_to_token=_LONGS, seq_to_token=_LONGS, line_to_token=_LONGS, line_to_addr=T.MapType(_S, T.ArrayType(_S)))
#: pcode_block and addr_to_token_idx come in several shapes; they are read as text and coerced.
FEATURE = _struct(
    hash=_S, type=_S, pcode_op=_S, pcode_op_full=_S, previous_pcode_op=_S, previous_seq=_S, line_idx=T.ArrayType(_L), seq_to_token_idx=T.ArrayType(_L), addr_to_token_idx=_S,
    addr=_S, seq_time=_L, seq=_S, block_index=_L, pcode_block=_S)
FEATURES = _struct(bsim_features_meta=T.ArrayType(FEATURE), bsim_features_raw=T.ArrayType(_S), bsim_features_tf=T.ArrayType(_struct(hash=_S, tf=_L)), bsim_features_count=_L, bsim_unique_features_count=_L)
UPLOAD = _struct(collection=_S, file_md5=_S, file_metadata=FILE_META, functions=T.ArrayType(_struct(function_metadata=FUNCTION_META, function_source=SOURCE, function_features=FEATURES)))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """All upload documents under a path; malformed fields become null."""
    return spark.read.schema(UPLOAD).option("mode", "PERMISSIVE").json(path, multiLine=True)


def replay(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Upload documents in file-name order, at most `limit` of them, with `source_file`."""
    df = spark.read.schema(UPLOAD).json(path, multiLine=True).withColumn("source_file", F.input_file_name())
    df = df.orderBy("source_file")
    return df.limit(limit) if limit is not None else df


def stream_uploads(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_per_batch).json(path, multiLine=True)


def write_uploads(uploads: DataFrame, path: str, folders: int | None = 256) -> None:
    """The dump sink: JSON lines in a bounded number of folders by the digest of the file md5, or,
    with folders=None, in a folder for each file (for a few files that people look at)."""
    at = F.col("file_md5") if folders is None else F.pmod(F.xxhash64("file_md5"), F.lit(folders))
    rows = uploads.withColumn("at", at)
    if folders is not None:
        rows = rows.repartition("at")  # one task, and so one file, for each folder
    rows.write.mode("overwrite").partitionBy("at").json(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The upload documents of a dump."""
    return spark.read.schema(UPLOAD).json(path)


def upload_key(uploads: DataFrame) -> DataFrame:
    """file_md5 or, where it is missing, the md5 of the document's JSON; collection or "main"."""
    body = F.md5(F.to_json(F.struct("file_metadata", "functions")).cast("binary"))
    return uploads.withColumns({
        "file_md5": F.coalesce(F.nullif("file_md5", F.lit("")), F.nullif(F.col("file_metadata.file_md5"), F.lit("")), body),
        "collection": F.coalesce(F.nullif("collection", F.lit("")), F.lit("main")),
    })
