"""The run log as a stream: read from where a query stopped, states kept, idle sessions closed, events numbered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomgraph.operators.runlog import node_states

LOG = "run_id bigint, seq bigint, type string, node_id string, graph_path string, payload string, created_at timestamp"


def read_log(spark: SparkSession, path: str, files_each: int = 1000) -> DataFrame:
    """The log's files as a stream; the checkpoint holds how far a query has read."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_each).parquet(path)


def live_states(log: DataFrame) -> DataFrame:
    """Node states as events come in; to be written in update mode."""
    return node_states(log)


def idle(log: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of runs that nothing touched for the gap, once the watermark has passed them."""
    own = log.withWatermark("created_at", late).groupBy("run_id", F.session_window("created_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return own.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def follow(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Runs a query over the stream, each batch to the sink; without `every`, over what is there now."""
    writer = frame.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_numbered(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that numbers a batch's events behind what each run already has, into path/batch=N.

    Beside the log, path-heads/N keeps each run's next number after batch N, so a batch reads that table of
    the one before it and never the log.  One query writes a log, so numbering has no rival; a batch that
    is retried writes the same rows over its own.
    """

    def sink(batch: DataFrame, number: int) -> None:
        from loomgraph.operators.runlog import number as numbered

        spark = batch.sparkSession
        base = spark.read.parquet(f"{path}-heads/{number - 1}") if number else None
        numbered(batch, "run_id", "created_at", "type", "node_id", base=base).write.mode("overwrite").parquet(f"{path}/batch={number}")
        heads = spark.read.parquet(f"{path}/batch={number}").groupBy("run_id").agg((F.max("seq") + 1).alias("next_seq"))
        if base is not None:
            heads = heads.unionByName(base.join(heads, "run_id", "left_anti"))
        heads.write.mode("overwrite").parquet(f"{path}-heads/{number}")

    return sink
