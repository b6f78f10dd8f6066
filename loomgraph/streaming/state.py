"""Streams with expiring state: late events, ring buffers of lines, each kept by key in the state store.

They need the RocksDB state store; with_store() sets it for a session.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class RefuseLate(StatefulProcessor):
    """Events of a run behind its finish are not accepted.  A run's finish is forgotten by a timer, `keep`
    milliseconds of event time behind it; until then it is one number of state, and after that none."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """A batch's finish counts for all of the batch's events, in whatever order they come; of those only seq and type are held."""
        end = self.end.get()[0] if self.end.exists() else None
        seqs, types, finished = [], [], []
        for part in rows:
            seqs.append(part["seq"].to_numpy(np.int64))
            types.append(part["type"].astype("category"))
            ends = part.loc[part["type"] == "run.finished", ["seq", "created_at"]]
            finished += list(ends.itertuples(index=False, name=None))
        if finished:
            first, at = min(finished)
            if end is None:
                self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.keep)
            if end is None or first < end:
                end = int(first)
                self.end.update((end,))
        for seq, kind in zip(seqs, types, strict=True):
            accepted = np.ones(len(seq), bool) if end is None else seq <= end
            yield pd.DataFrame({"run_id": key[0], "seq": seq, "type": pd.Series(kind.tolist(), dtype=object), "accepted": accepted})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.end.clear()
        yield from ()

    def close(self) -> None:
        pass


def refuse_late(log: DataFrame, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(run_id, seq, type, accepted) of a log with created_at: what comes behind a run's finish is not accepted.

    keep: for how long, in event time, a finish is remembered; it must be longer than events can be late.
    """
    own = log.select("run_id", "seq", "type", "created_at").withWatermark("created_at", late)
    made = RefuseLate(int(pd.Timedelta(keep).total_seconds() * 1000))
    return own.groupBy("run_id").transformWithStateInPandas(made, "run_id bigint, seq bigint, type string, accepted boolean", "append", "EventTime")


class Ring(StatefulProcessor):
    """Each session's last `most` lines, numbered from 1 as they come; a timer forgets a session, lines and
    number, `keep` milliseconds of event time behind its last line."""

    def __init__(self, most: int, keep: int) -> None:
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "seq bigint, line string")
        self.next = handle.getValueState("next", "seq bigint, expires bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Only the last lines of a batch are held, so a flood of lines costs no more memory than the buffer and one part."""
        first, expires = self.next.get() if self.next.exists() else (0, 0)
        number, latest, last = first, [], 0
        for part in rows:
            number += len(part)
            latest = heapq.nlargest(self.most, [*latest, *zip(part["ord"].tolist(), part["line"].tolist(), strict=True)], key=lambda x: x[0])
            last = max(last, int(part["created_at"].max().timestamp() * 1000))
        fresh = [(number - k, line) for k, (_, line) in enumerate(latest)][::-1]
        held = list(self.lines.get()) if self.lines.exists() and len(fresh) < self.most else []
        kept = [*[(int(seq), line) for seq, line in held], *fresh][-self.most :]
        self.lines.put(kept)
        if expires and last + self.keep > expires:
            self.handle.deleteTimer(expires)
        if last + self.keep > expires:
            expires = last + self.keep
            self.handle.registerTimer(expires)
        self.next.update((number, expires))
        yield pd.DataFrame({"session": pd.Series([key[0]], dtype=object), "n_lines": [number - first], "first_seq": [kept[0][0]], "last_seq": [number]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.lines.clear()
        self.next.clear()
        yield from ()

    def close(self) -> None:
        pass


def ring_buffers(lines: DataFrame, most: int = 5000, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """lines (session, line, ord, their order in a batch, created_at) to (session, n_lines, first_seq, last_seq)
    for each session and batch: how many came, and what the buffer now spans."""
    own = lines.select("session", "line", "ord", "created_at").withWatermark("created_at", late)
    made = Ring(most, int(pd.Timedelta(keep).total_seconds() * 1000))
    return own.groupBy("session").transformWithStateInPandas(made, "session string, n_lines bigint, first_seq bigint, last_seq bigint", "update", "EventTime")


def buffered(spark: SparkSession, checkpoint: str, after: int = 0) -> DataFrame:
    """(session, seq, line): the lines that the buffers of a query with this checkpoint hold behind an offset."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "lines").load()
    return held.select("key.session", "list_element.*").where(F.col("seq") > after).select("session", "seq", "line")


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run_id, seq): the finishes that refuse_late still remembers."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "end").load()
    return held.select(F.col("key.run_id").alias("run_id"), F.col("value.seq").alias("seq"))
