"""The append-only run log: numbering, reads from an offset, and folds to state.

A log has run_id, seq (from 0, gapless in a run), type, node_id, graph_path and payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_STATES = {"node.started": "running", "node.finished": "finished", "node.output": "finished", "node.failed": "failed"}
TERMINAL = ("finished", "partial", "failed", "cancelled")


def number(events: DataFrame, run: str, *order: str | Column, base: DataFrame | None = None) -> DataFrame:
    """events with seq, from 0 in each run, or behind the base's (run, next_seq) when events are appended."""
    seq = (F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1).cast("bigint")
    if base is None:
        return events.withColumn("seq", seq)
    return events.join(base, run, "left").withColumn("seq", seq + F.coalesce("next_seq", F.lit(0))).drop("next_seq")


def after(log: DataFrame, seq: int = -1, most: int = 500) -> DataFrame:
    """Of each run, the next events behind an offset; the filter reaches the scan."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    return log.where(F.col("seq") > seq).withColumn("place", place).where(F.col("place") <= most).drop("place")


def _latest(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def node_states(log: DataFrame, graph_path: str | None = None) -> DataFrame:
    """(run_id, node_id, state): what the last of a node's lifecycle events says; one graph's if named."""
    own = log.where(F.col("type").isin(*NODE_STATES))
    if graph_path is not None:
        own = own.where(F.col("graph_path") == graph_path)
    state = F.element_at(F.create_map(*[F.lit(x) for pair in NODE_STATES.items() for x in pair]), F.col("type"))
    return own.groupBy("run_id", "node_id").agg(_latest(state, F.col("seq")).alias("state"))


def run_status(log: DataFrame, started: str = "run.started", finished: str = "run.finished") -> DataFrame:
    """(run_id, status, events): queued until started; the last word is the finish's own status, or finished.

    Cancelled is terminal: neither a late start nor a late finish undoes it.
    """
    said = F.get_json_object("payload", "$.status")
    end = F.when(said.isin(*TERMINAL), said).otherwise("finished")
    folded = log.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("events"), F.count_if(F.col("type") == started).alias("starts"), F.max_by(F.when(F.col("type") == finished, end), F.when(F.col("type") == finished, F.col("seq"))).alias("end"), F.bool_or((F.col("type") == finished) & (end == "cancelled")).alias("cancelled"))
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("end").isNotNull(), F.col("end")).when(F.col("starts") > 0, "running").otherwise("queued")
    return folded.select("run_id", status.alias("status"), "events")


def without_late(log: DataFrame, finished: str = "run.finished") -> DataFrame:
    """Events behind a run's finish are refused."""
    ends = log.where(F.col("type") == finished).groupBy("run_id").agg(F.min("seq").alias("end"))
    return log.join(ends, "run_id", "left").where(F.col("end").isNull() | (F.col("seq") <= F.col("end"))).drop("end")


def cancelled_at(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The log with runs cut short: requests (run_id, seq) are cancellations that came before the event seq was
    reported.  That report still counts, and the answer to it ends the run: its next event is the finish.

    A run that had finished by then is as it was.  Of several requests the first counts.
    """
    first = requests.groupBy("run_id").agg(F.min("seq").alias("asked"))
    ends = log.where(F.col("type") == "run.finished").groupBy("run_id").agg(F.min("seq").alias("end"))
    met = log.join(first, "run_id", "left").join(ends, "run_id", "left")
    cut = F.col("asked").isNotNull() & (F.col("end").isNull() | (F.col("asked") < F.col("end")))
    kept = met.where(~F.coalesce(cut, F.lit(False)) | (F.col("seq") <= F.col("asked"))).select(*log.columns)
    last = met.where(cut & (F.col("seq") == F.col("asked")))
    said = {"seq": F.col("seq") + 1, "type": F.lit("run.finished"), "payload": F.lit('{"status":"cancelled"}')}
    finish = last.select(*[said[c].alias(c) if c in said else F.col(c) if c in ("run_id", "created_at", "ts") else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
    return kept.unionByName(finish)


def reports(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, appended, cancelled): the answer to each run's report of events."""
    sent = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("appended"))
    status = runs.select(F.col("id").alias("run_id"), (F.col("status") == "cancelled").alias("cancelled"))
    return sent.join(status, "run_id", "left").select("run_id", "appended", F.coalesce("cancelled", F.lit(False)).alias("cancelled"))


def latest_runs(runs: DataFrame, created: str, tie: str, most: int = 50) -> DataFrame:
    return runs.orderBy(F.desc(created), F.desc(tie)).limit(most)


def tail(lines: DataFrame, group: str, seq: str, most: int) -> DataFrame:
    """The ring buffer: each group's last lines."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(seq)))
    return lines.withColumn("place", place).where(F.col("place") <= most).drop("place")


def lines_after(lines: DataFrame, group: str, seq: str, offset: int = 0) -> DataFrame:
    """By group, the lines behind an offset: how many, and the offset to ask for next."""
    own = F.when(F.col(seq) > offset, F.col(seq))
    return lines.groupBy(group).agg(F.count(own).cast("bigint").alias("n_lines"), F.coalesce(F.max(own), F.lit(offset)).cast("bigint").alias("last_seq"))


def idle_sessions(touches: DataFrame, owner: str, ts: str, gap: str = "1 hour") -> DataFrame:
    """(owner, start, end, touches): a session ends when nothing touched it for the gap."""
    grouped = touches.groupBy(owner, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("touches"))
    return grouped.select(owner, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "touches")


def sequence_gaps(log: DataFrame) -> DataFrame:
    """Runs whose numbering is not gapless from 0: there should be none."""
    seen = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    return seen.where("low <> 0 OR high <> n - 1 OR d <> n").select("run_id")
