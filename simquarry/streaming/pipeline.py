"""The ingest pipeline as a stream: each micro-batch of upload documents runs the four stages
(metadata, functions, features, similarity) and writes their tables.

State is a folder of Parquet tables. A micro-batch writes under its own number, so a repeated
batch replaces its earlier attempt; readers union the numbers and let later batches win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest, similarity
from ..sources.upload import stream_uploads

TABLES = {"files": ["collection", "file_md5"], "functions": ["collection", "function_id"], "vec_tf": ["collection", "function_id", "hash"], "sims": ["collection", "algo", "id1", "id2"], "built": ["collection", "function_id"]}


#: Micro-batches after which a state table's current rows are written as a snapshot.
COMPACT = 16


def _names(spark: SparkSession, path: str, lead: str) -> list[int] | None:
    """The numbers n of the folders `lead`n under a path; None where there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = (f.getPath().getName() for f in fs.listStatus(at))
    return sorted(int(n[len(lead) :]) for n in found if n.startswith(lead))


def read_state(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame | None:
    """The current rows of a state table, or None where no batch has written it: those of the
    last snapshot and of the batches after it, the later ones winning."""
    path = f"{root}/{table}"
    written = _names(spark, path, "batch_no=")
    if not written:
        return None
    limit = written[-1] + 1 if before is None else before
    kept = [n for n in _names(spark, f"{root}/{table}-snapshots", "upto=") or () if n < limit]
    low = kept[-1] if kept else -1
    df = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path).where((F.col("batch_no") > low) & (F.col("batch_no") < limit))
    if kept:
        df = spark.read.parquet(f"{root}/{table}-snapshots/upto={low}").withColumn("batch_no", F.lit(low)).unionByName(df, allowMissingColumns=True)
    w = Window.partitionBy(*TABLES[table]).orderBy(F.col("batch_no").desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch_no")


def compact(spark: SparkSession, root: str, number: int) -> None:
    """Writes each table's rows as they are after batch `number`, so that later reads rank only
    what came after: a batch costs the size of the state, not of its history."""
    for table in TABLES:
        rows = read_state(spark, root, table, number + 1)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{root}/{table}-snapshots/upto={number}")


def process_batch(uploads: DataFrame, number: int, root: str, algo: str = "unweighted_cosine", k: int = 1000, min_score: float = 0.3) -> None:
    spark = uploads.sparkSession
    uploads = uploads.persist()

    def put(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{table}/batch_no={number}")

    try:
        put(ingest.files(uploads), "files")
        funcs = ingest.functions(uploads)
        put(funcs.drop("source", "features"), "functions")
        put(ingest.vectors(funcs), "vec_tf")
    finally:
        uploads.unpersist()
    functions, vec = read_state(spark, root, "functions", number + 1), read_state(spark, root, "vec_tf", number + 1)
    built = read_state(spark, root, "built", number)
    todo = functions if built is None else similarity.unbuilt(functions, built)
    put(similarity.build_pairs(vec, functions, algo, k, min_score, todo), "sims")
    put(todo.select("collection", "function_id"), "built")
    if number % COMPACT == COMPACT - 1:
        compact(spark, root, number)


def run_stream(spark: SparkSession, source: str, root: str, checkpoint: str, files_per_batch: int = 100, **how):
    """Processes what is in `source` now and stops; a restart resumes at the checkpoint."""
    query = (
        stream_uploads(spark, source, files_per_batch).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(lambda df, n: process_batch(df, n, root, **how)).start()
    )
    query.awaitTermination()
    return query
