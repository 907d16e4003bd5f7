"""Job, pipeline and performance statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, PENDING, CANCELLED = "running", "pending", "cancelled"


def job_stats(jobs: DataFrame) -> DataFrame:
    """One row: running and pending jobs, average and total speed of the running ones, what is
    left and the time it takes at that speed (0 where the speed is 0)."""
    run = F.col("status") == ACTIVE
    speed = F.when(run, F.coalesce("speed", F.lit(0.0)))
    left = F.when(run, F.greatest(F.lit(0), F.coalesce("total_items", F.lit(0)) - F.coalesce("processed_items", F.lit(0))))
    total, rest = F.coalesce(F.sum(speed), F.lit(0.0)), F.coalesce(F.sum(left), F.lit(0)).cast("long")
    return jobs.agg(
        F.count_if(run).alias("active_workers"), F.count_if(F.col("status") == PENDING).alias("pending_jobs"),
        F.when(F.count_if(run) > 0, total / F.count_if(run)).otherwise(F.lit(0.0)).alias("avg_speed"), total.alias("total_speed"), rest.alias("remaining_items"),
        F.when(total > 0, rest / total).otherwise(F.lit(0.0)).alias("global_eta"))


def runnable(jobs: DataFrame) -> DataFrame:
    """Pending jobs, oldest first; cancelled ones are skipped."""
    return jobs.where(F.col("status") == PENDING).orderBy("created_at", "id")


def pipeline_progress(tasks: DataFrame) -> DataFrame:
    """The whole percent of each pipeline; failed as soon as a task failed."""
    status = F.when(F.max(F.col("status") == "failed"), "failed").when(F.min(F.col("status") == "completed"), "completed").when(F.max(F.col("status") == CANCELLED), CANCELLED).otherwise(ACTIVE)
    return tasks.groupBy("parent_id").agg(F.floor(F.sum("progress") / F.count("*")).cast("long").alias("progress"), status.alias("status"))


def perf_rollup(ops: DataFrame, by: list[str]) -> DataFrame:
    """total, db, lua and python (the rest, at least 0) seconds and the number of operations,
    for each group and in all (null keys)."""
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("cat") == c, F.col("time"))), F.lit(0.0))
    total = F.sum("time")
    return ops.rollup(*by).agg(total.alias("total"), pick("db_queries").alias("db"), pick("lua_scripts").alias("lua"), F.greatest(F.lit(0.0), total - pick("db_queries") - pick("lua_scripts")).alias("python"), F.count("*").alias("ops_count"))


def slowest(ops: DataFrame, n: int = 10) -> DataFrame:
    return ops.orderBy(F.col("time").desc(), F.col("op_id")).limit(n)


def newest_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("id")).limit(n)


def capped(rows: DataFrame, group: str, order: str, head: int, tail: int) -> DataFrame:
    """The first `head` and last `tail` rows of each group; what lies between is cut out."""
    first = Window.partitionBy(group).orderBy(order)
    last = Window.partitionBy(group).orderBy(F.col(order).desc())
    marked = rows.withColumns({"__a": F.row_number().over(first), "__b": F.row_number().over(last)})
    return marked.where((F.col("__a") <= head) | (F.col("__b") <= tail)).drop("__a", "__b")


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Cancels jobs and their sub-tasks unless they are over."""
    hit = ids.select(F.col("id").alias("__id")).distinct()
    own = jobs.join(hit, F.col("id") == F.col("__id"), "left").withColumnRenamed("__id", "__own")
    both = own.join(hit, F.col("parent_id") == F.col("__id"), "left")
    stop = (F.col("__own").isNotNull() | F.col("__id").isNotNull()) & ~F.col("status").isin("completed", "failed")
    return both.withColumn("status", F.when(stop, CANCELLED).otherwise(F.col("status"))).drop("__own", "__id")


def success_rate(uploads: DataFrame) -> DataFrame:
    return uploads.agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), (F.avg(F.col("ok").cast("int")) * 100).alias("percent"))


def with_eta(jobs: DataFrame, now: str = "now_ms") -> DataFrame:
    """Speed (items a second since created_at, milliseconds) and eta (seconds) of each job; 0
    where nothing is done or no time has passed."""
    took = (F.col(now) - F.col("created_at")) / 1000.0
    speed = F.when((took > 0) & (F.col("processed_items") > 0), F.col("processed_items") / took).otherwise(F.lit(0.0))
    left = F.greatest(F.lit(0), F.col("total_items") - F.col("processed_items"))
    return jobs.withColumn("speed", speed).withColumn("eta", F.when(F.col("speed") > 0, left / F.col("speed")).otherwise(F.lit(0.0)))


def perf_percent(rolled: DataFrame) -> DataFrame:
    """perf_rollup with each part's share of its row's total, in percent to one decimal (0 where
    the total is 0)."""
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return rolled.withColumns({f"{c}_percent": share(c) for c in ("db", "lua", "python")})


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The jobs after `results` (id, ok): a running job becomes completed or failed, other jobs
    keep their state."""
    r = results.groupBy(F.col("id").alias("__id")).agg(F.min("ok").alias("__ok"))
    out = jobs.join(r, F.col("id") == F.col("__id"), "left")
    done = (F.col("status") == ACTIVE) & F.col("__ok").isNotNull()
    return out.withColumn("status", F.when(done, F.when(F.col("__ok"), "completed").otherwise("failed")).otherwise(F.col("status"))).drop("__id", "__ok")


def next_stages(tasks: DataFrame) -> DataFrame:
    """The tasks (id, parent_id, stage, status) that may start: of each pipeline without a failed or
    cancelled task, the first pending one once all before it are completed."""
    w = Window.partitionBy("parent_id")
    first = F.min(F.when(F.col("status") != "completed", F.col("stage"))).over(w)
    stopped = F.max(F.col("status").isin("failed", CANCELLED)).over(w)
    out = tasks.withColumns({"__first": first, "__stopped": stopped})
    return out.where((F.col("status") == PENDING) & (F.col("stage") == F.col("__first")) & ~F.col("__stopped")).drop("__first", "__stopped")
