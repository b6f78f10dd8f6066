"""Reports of running graphs as a stream: appended, mirrored in the runs' status, and answered, batch by batch.

A batch of events is joined with the heads of the runs and with the requests to cancel.  It appends what its
runs may still say, numbered behind what they have; the answer to a run that is to stop says so, and the
batch ends the run's log.  The heads are written last and mark the batch as done: a batch that is tried again
before that writes the same places over, and one that is tried again after it does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.runlog import TERMINAL

HEADS = "run_id bigint, next_seq bigint, status string, batch bigint"
#: Batches whose heads are kept apart; then they are joined to one table.
APART = 20


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def heads(spark: SparkSession, path: str, before: int) -> DataFrame:
    """(run_id, next_seq, status, batch) of each run, from the batches up to `before`: the last joined table and what came since."""
    joined = before // APART * APART
    parts = [p for p in [f"{path}/heads/joined={joined}", *(f"{path}/heads/batch={k}" for k in range(max(joined, 0), before + 1))] if _exists(spark, f"{p}/_SUCCESS")]
    if not parts:
        return spark.createDataFrame([], HEADS)
    rows = spark.read.schema(HEADS).parquet(*parts)
    return rows.groupBy("run_id").agg(F.max(F.struct("batch", "next_seq", "status")).alias("h")).select("run_id", "h.next_seq", "h.status", "h.batch")


def report(batch: DataFrame, known: DataFrame, requests: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(appended, heads): a batch's events (run_id, type, node_id, payload, created_at) as they go to the log, and its runs' new heads.

    Nothing is appended to a run that has ended.  In a run that requests (run_id) ask to cancel, the batch's
    own events still count, up to a finish among them; then the log ends with a finish of its own.
    """
    named = known.select("run_id", "next_seq", F.col("status").alias("was"))
    asked = requests.select("run_id").distinct().withColumn("asked", F.lit(True))
    met = batch.join(named, "run_id", "left").join(asked, "run_id", "left").where(~F.coalesce(F.col("was").isin(*TERMINAL), F.lit(False)))
    order = Window.partitionBy("run_id").orderBy("created_at", "type", "node_id", "payload")
    ends = F.col("type") == "run.finished"
    placed = met.withColumn("nth", F.row_number().over(order)).withColumn("ended", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = placed.where("ended = 0").withColumn("seq", (F.coalesce("next_seq", F.lit(0)) + F.col("nth") - 1).cast("bigint"))
    said = F.get_json_object("payload", "$.status")
    end = F.max(F.when(ends, F.when(said.isin(*TERMINAL), said).otherwise("finished")))
    by_run = kept.groupBy("run_id").agg((F.max("seq") + 1).alias("next"), end.alias("end"), F.max("asked").alias("asked"), F.max("created_at").alias("created_at"), F.first("was", True).alias("was"), F.max((F.col("type") == "run.started").cast("int")).alias("starts"))
    stop = F.col("end").isNull() & F.col("asked").isNotNull()
    columns = ["run_id", "seq", "type", "node_id", "payload", "created_at"]
    finish = by_run.where(stop).select("run_id", F.col("next").alias("seq"), F.lit("run.finished").alias("type"), F.lit(None).cast("string").alias("node_id"), F.lit('{"status":"cancelled"}').alias("payload"), "created_at")
    status = F.when(stop, "cancelled").when(F.col("end").isNotNull(), F.col("end")).when(F.col("starts") > 0, "running").otherwise(F.coalesce("was", F.lit("queued")))
    new = by_run.select("run_id", (F.col("next") + stop.cast("int")).cast("bigint").alias("next_seq"), status.alias("status"), F.lit(number).cast("bigint").alias("batch"))
    return kept.select(*columns).unionByName(finish.select(*columns)), new


def answers(batch: DataFrame, appended: DataFrame, known: DataFrame) -> DataFrame:
    """(run_id, appended, cancelled): what each run that reported is told; known are the heads behind the batch."""
    counts = appended.groupBy("run_id").agg(F.count(F.lit(1)).alias("appended"))
    told = batch.select("run_id").distinct().join(counts, "run_id", "left").join(known.select("run_id", "status"), "run_id", "left")
    return told.select("run_id", F.coalesce("appended", F.lit(0)).cast("bigint").alias("appended"), F.coalesce(F.col("status") == "cancelled", F.lit(False)).alias("cancelled"))


def reporting(path: str, requests: Callable[[SparkSession], DataFrame], tell: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: path/log/batch=N, path/answers/batch=N and path/heads/batch=N, in this order.

    requests gives the requests to cancel as they are at the batch; tell gets the answers once they hold.
    One query writes a log.  After APART batches the heads are joined to one table and the older ones go.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{path}/heads/batch={number}"
        if not _exists(spark, f"{done}/_SUCCESS"):
            known = heads(spark, path, number - 1)
            asked = requests(spark)
            asked.select("run_id").distinct().write.mode("overwrite").parquet(f"{path}/requests/batch={number}")
            asked = spark.read.schema("run_id bigint").parquet(f"{path}/requests/batch={number}")
            log, new = report(batch, known, asked, number)
            log.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
            later = known.join(new, "run_id", "left_anti").unionByName(new)
            answers(batch, spark.read.schema(log.schema).parquet(f"{path}/log/batch={number}"), later).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")
            new.write.mode("overwrite").parquet(done)
            if number and number % APART == 0:
                heads(spark, path, number - 1).write.mode("overwrite").parquet(f"{path}/heads/joined={number}")
                for old in range(number - 2 * APART, number - APART):
                    _remove(spark, f"{path}/heads/batch={old}")
                _remove(spark, f"{path}/heads/joined={number - 2 * APART}")
        if tell is not None:
            tell(spark.read.schema("run_id bigint, appended bigint, cancelled boolean").parquet(f"{path}/answers/batch={number}"), number)

    return sink


@contextmanager
def running(spark: SparkSession, run: int) -> Iterator[None]:
    """Marks this thread's jobs as the run's, so that stop_cancelled finds them."""
    context, tag = spark.sparkContext, f"run-{run}"
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


def stop_cancelled(told: DataFrame, number: int = 0) -> None:
    """Stops the jobs of the runs that are told to stop; for `tell`.  The driver sees the ids of those alone."""
    context = told.sparkSession.sparkContext
    for row in told.where("cancelled").select("run_id").toLocalIterator():
        context.cancelJobsWithTag(f"run-{row.run_id}")
