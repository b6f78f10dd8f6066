"""The log as a source with offsets, state that expires, and reports with answers."""

from __future__ import annotations

import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import runlog
from loomgraph.streaming import reports, source, state
from loomgraph.streaming import runlog as live

LOG = "run_id long, seq long, type string, node_id string, payload string"


@pytest.fixture
def ready(spark):
    source.register(spark)
    state.with_store(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def events(spark, run, seqs):
    return spark.createDataFrame([(run, s, "node.output", f"n{s % 3}", "{}") for s in seqs], LOG)


def test_the_source_gives_each_event_once_over_restarts(ready, tmp_path):
    log, seen = str(tmp_path / "log"), []
    read = lambda **o: ready.readStream.format("runlog").options(path=log, run=7, each=10, **o).load()
    run = lambda cp, **o: live.follow(read(**o), lambda b, _: seen.extend(r.seq for r in b.collect()), str(tmp_path / cp)).awaitTermination()
    events(ready, 7, range(25)).unionByName(events(ready, 8, range(100))).repartition(3).write.parquet(log)
    run("cp")
    assert sorted(seen) == list(range(25))
    run("cp")
    assert len(seen) == 25
    events(ready, 7, range(25, 61)).write.mode("append").parquet(log)
    run("cp")
    assert sorted(seen) == list(range(61))
    seen.clear()
    run("cp2", after=40)
    assert sorted(seen) == list(range(41, 61))
    with pytest.raises(Exception, match="option run"):
        ready.readStream.format("runlog").options(path=log).load().writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()


def test_the_source_as_a_batch(ready, tmp_path):
    log = str(tmp_path / "log")
    events(ready, 7, range(25)).unionByName(events(ready, 8, range(10))).repartition(4).write.parquet(log)
    load = lambda **o: ready.read.format("runlog").options(path=log, **o).load()
    assert sorted((r.run_id, r.seq) for r in load(after=7).collect()) == [(7, s) for s in range(8, 25)] + [(8, 8), (8, 9)]
    assert sorted(r.seq for r in load(run=8).collect()) == list(range(10))
    assert sorted(r.seq for r in load().where("run_id = 7 AND seq > 20 AND type = 'node.output'").collect()) == [21, 22, 23, 24]
    assert load(run=9).count() == 0 and ready.read.format("runlog").options(path=str(tmp_path / "none")).load().count() == 0


def rows(*items):
    start = datetime(2024, 1, 1)
    return [(run, seq, kind, node, None, "{}", start + timedelta(minutes=m)) for run, seq, kind, node, m in items]


def test_a_finish_is_forgotten_by_its_timer(ready, tmp_path):
    log, cp, judged = str(tmp_path / "log"), str(tmp_path / "cp"), {}

    def run(*items):
        ready.createDataFrame(rows(*items), live.LOG).write.mode("append").parquet(log)
        live.follow(state.refuse_late(live.read_log(ready, log), "1 hour"), lambda b, _: judged.update({(r.run_id, r.seq): r.accepted for r in b.collect()}), cp).awaitTermination()
        return {tuple(r) for r in state.remembered(ready, cp).collect()}

    assert run((1, 4, "node.started", "b", 4), (1, 0, "run.started", None, 0), (1, 3, "run.finished", None, 3), (2, 0, "run.started", None, 0)) == {(1, 3)}
    assert judged == {(1, 4): False, (1, 0): True, (1, 3): True, (2, 0): True}
    assert run((1, 5, "node.started", "b", 20), (2, 1, "node.started", "a", 21)) == {(1, 3)}
    assert not judged[1, 5] and judged[2, 1]
    run((3, 0, "run.started", None, 200))  # moves the watermark past the hour
    assert run((3, 1, "run.finished", None, 201)) == {(3, 1)}


def test_ring_buffers_hold_what_the_batch_tail_gives(ready, tmp_path):
    lines, cp, told = str(tmp_path / "lines"), str(tmp_path / "cp"), []
    start = datetime(2024, 1, 1)
    every = [(f"s{k % 3}", k, f"line {k}", start + timedelta(seconds=k)) for k in range(50)]
    shape = "session string, ord long, line string, created_at timestamp"

    def run(*items):
        ready.createDataFrame(items, shape).write.mode("append").parquet(lines)
        live.follow(state.ring_buffers(ready.readStream.schema(shape).parquet(lines), 7), lambda b, _: told.extend(b.collect()), cp, "update").awaitTermination()

    for at, end in ((0, 5), (5, 40), (40, 50)):
        run(*every[at:end])
    numbered = runlog.number(ready.createDataFrame(every, shape), "session", "ord").withColumn("seq", F.col("seq") + 1)
    wanted = sorted((r.session, r.seq, r.line) for r in runlog.tail(numbered, "session", "seq", 7).collect())
    assert sorted(tuple(r) for r in state.buffered(ready, cp).collect()) == wanted and len(wanted) == 21
    assert sorted(tuple(r) for r in state.buffered(ready, cp, 14).collect()) == [w for w in wanted if w[1] > 14]
    assert sum(r.n_lines for r in told) == 50 and {(r.session, r.last_seq, r.first_seq) for r in told} >= {("s0", 17, 11), ("s2", 16, 10)}
    for minutes in (300, 301):  # the watermark passes the sessions' last lines, and they are forgotten
        run(("s9", 100 + minutes, "late", start + timedelta(minutes=minutes)))
    assert {r.session for r in state.buffered(ready, cp).collect()} == {"s9"}


def sent(spark, *items):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(run, kind, node, payload, start + timedelta(seconds=s)) for s, (run, kind, node, payload) in enumerate(items)], "run_id long, type string, node_id string, payload string, created_at timestamp")


def test_a_cancelled_run_appends_nothing_after_its_answer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "APART", 2)
    path, asked, told = str(tmp_path), [], {}
    sink = reports.reporting(path, lambda s: s.createDataFrame([(r,) for r in asked], "run_id long"), lambda a, n: told.setdefault(n, set()).update(tuple(r) for r in a.collect()))
    read = lambda: sorted((r.run_id, r.seq, r.type, r.payload) for r in spark.read.parquet(f"{path}/log").collect())
    sink(sent(spark, (1, "run.started", None, "{}"), (2, "run.started", None, "{}"), (1, "node.started", "a", "{}")), 0)
    assert told[0] == {(1, 2, False), (2, 1, False)}
    asked.append(1)
    second = sent(spark, (1, "node.output", "a", "{}"), (2, "run.finished", None, '{"status":"partial"}'), (2, "node.started", "z", "{}"))
    monkeypatch.setattr(reports, "answers", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sink(second, 1)
    monkeypatch.undo()
    monkeypatch.setattr(reports, "APART", 2)
    sink(second, 1)
    assert told[1] == {(1, 2, True), (2, 1, False)}
    log = read()
    assert log == [(1, 0, "run.started", "{}"), (1, 1, "node.started", "{}"), (1, 2, "node.output", "{}"), (1, 3, "run.finished", '{"status":"cancelled"}'), (2, 0, "run.started", "{}"), (2, 1, "run.finished", '{"status":"partial"}')]
    sink(second, 1)  # a retry of what is done
    for n in range(2, 7):
        sink(sent(spark, (1, "node.output", "b", "{}"), (2, "node.output", "b", "{}"), (10 + n, "run.started", None, "{}")), n)
        assert {(1, 0, True), (2, 0, False)} <= told[n]
    assert [x for x in read() if x[0] < 3] == log
    known = {r.run_id: (r.next_seq, r.status) for r in reports.heads(spark, path, 6).collect()}
    assert known == {1: (4, "cancelled"), 2: (2, "partial")} | {10 + n: (1, "running") for n in range(2, 7)}


def test_a_told_run_stops(spark):
    ended = []

    def work():
        with reports.running(spark, 5):
            try:
                spark.range(8).repartition(8).mapInArrow(lambda it: (time.sleep(6) or b for b in it), "id long").collect()
            except Exception as error:
                ended.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    told = spark.createDataFrame([(5, 0, True), (6, 0, False)], "run_id long, appended long, cancelled boolean")
    until = time.time() + 30
    while thread.is_alive() and time.time() < until:
        time.sleep(1)
        reports.stop_cancelled(told)
    assert not thread.is_alive() and len(ended) == 1
