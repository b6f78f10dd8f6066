"""Files, snapshots and the log as a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from loomgraph.sources import files
from loomgraph.streaming import runlog as live

GRAPH = "kind: Graph\nspec:\n  nodes:\n    - { id: a, type: io, direction: in }\n    - { id: b, type: code, include: ['x/*'] }\n  edges:\n    - { id: e, kind: flow, from: { node: a }, to: { node: b, function: f } }\n"


def test_directory_and_documents(spark, tmp_path):
    for name, body in {"graphs/g.yaml": GRAPH, "bad.yaml": "a: [", "node_modules/x.md": "no", "b.bin": None}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body.encode() if body is not None else b"\xff\xfe")
    found = files.directory(spark, str(tmp_path))
    assert sorted(r.path for r in found.select("path").collect()) == ["b.bin", "bad.yaml", "graphs/g.yaml"]
    texts = files.texts(found)
    assert sorted(r.path for r in texts.collect()) == ["bad.yaml", "graphs/g.yaml"]
    docs = files.documents(texts)
    asked = files.in_memory(spark, {"graphs/g.yaml": "", "bad.yaml": "", "none.yaml": ""})
    assert sorted(map(tuple, files.graph_errors(docs, asked).collect())) == [("bad.yaml", "not YAML"), ("none.yaml", "no such file")]
    assert [files.one_file(spark, str(tmp_path), p).count() for p in ("bad.yaml", "../bad.yaml", "graphs", "x")] == [1, 0, 0, 0]
    assert {r.path: r.document is None for r in docs.collect()} == {"bad.yaml": True, "graphs/g.yaml": False}
    nodes, edges = files.graph_tables(docs)
    assert [(r.id, r.type) for r in nodes.orderBy("ord").collect()] == [("a", "io"), ("b", "code")]
    assert edges.select("src", "dst", "function").first() == ("a", "b", "f")


def test_snapshots(spark):
    tree = spark.createDataFrame([("c1", "a.md", "h1", 2), ("c1", "b.py", "h2", 2), ("c0", "old.md", "h1", 2)], "commit_sha string, path string, blob_sha string, size long")
    blobs = spark.createDataFrame([("h1", "A"), ("h2", "B")], "blob_sha string, content string")
    first = files.snapshot(blobs, tree, "c1")
    assert sorted(map(tuple, first.collect())) == [("a.md", "A"), ("b.py", None)]
    more = files.hydrate(first, tree, blobs, "c1", spark.createDataFrame([("b.py",)], "path string"))
    assert sorted(map(tuple, more.collect())) == [("a.md", "A"), ("b.py", "B")]
    new_tree, fresh = files.commit(tree, more, "c1", "c2")
    assert new_tree.count() == 2 and fresh.count() == 2
    _, again = files.commit(new_tree, more, "c2", "c3")
    assert again.count() == 0
    assert [r.path for r in files.append_absent(more, {"a.md": "x", "c.md": "y"}).collect()] == ["c.md"]


def rows(*items):
    start = datetime(2024, 1, 1)
    return [(run, seq, kind, node, None, "{}", start + timedelta(minutes=m)) for run, seq, kind, node, m in items]


def test_stream_states(spark, tmp_path):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    spark.createDataFrame(rows((1, 0, "run.started", None, 0), (1, 1, "node.started", "a", 1)), live.LOG).write.parquet(log)
    seen = {}

    def keep(batch, _):
        seen.update({(r.run_id, r.node_id): r.state for r in batch.collect()})

    live.follow(live.live_states(live.read_log(spark, log)), keep, checkpoint, "update").awaitTermination()
    assert seen == {(1, "a"): "running"}
    spark.createDataFrame(rows((1, 2, "node.failed", "a", 2), (1, 3, "run.finished", None, 3), (1, 4, "node.started", "b", 4)), live.LOG).write.mode("append").parquet(log)
    live.follow(live.live_states(live.read_log(spark, log)), keep, checkpoint, "update").awaitTermination()
    assert seen[(1, "a")] == "failed"


def test_events_are_appended(spark, tmp_path):
    for seq in (0, 1):
        files.write_events(spark.createDataFrame(rows((1, seq, "run.started", None, 0)), live.LOG), str(tmp_path / "log"))
    assert sorted(r.seq for r in live.read_log(spark, str(tmp_path / "log")).sparkSession.read.parquet(str(tmp_path / "log")).collect()) == [0, 1]


def test_appends_are_numbered_once(spark, tmp_path):
    sink = live.append_numbered(str(tmp_path / "numbered"))
    batch = spark.createDataFrame(rows((1, 0, "run.started", None, 0), (1, 0, "node.started", "a", 1)), live.LOG).drop("seq")
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.createDataFrame(rows((1, 0, "node.finished", "a", 2)), live.LOG).drop("seq"), 1)
    got = spark.read.parquet(str(tmp_path / "numbered"))
    assert sorted((r.seq, r.type) for r in got.collect()) == [(0, "run.started"), (1, "node.started"), (2, "node.finished")]


def test_idle_sessions_close_behind_the_watermark(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame(rows((1, 0, "a", None, 0), (1, 1, "a", None, 30), (1, 2, "a", None, 300)), live.LOG).write.parquet(log)
    closed = []
    live.follow(live.idle(live.read_log(spark, log)), lambda b, _: closed.extend(r.events for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert closed == [2]


def test_a_project_in_one_go(spark):
    from loomgraph.sources import bundle

    graph = "kind: Graph\nspec:\n  nodes:\n    - { id: a, type: io, direction: in, schema: s.json }\n    - { id: b, type: io, direction: out, schema: none.json }\n    - { id: c, type: io, direction: out, schema: bad.json }\n    - { id: step, type: code, entrypoint: step.py }\n    - { id: again, type: subgraph, ref: g.yaml }\n    - { id: Bad, type: odd }\n  edges:\n    - { id: e, kind: flow, from: { node: a }, to: { node: step } }\n    - { id: f, kind: other, from: { node: step }, to: { node: b } }\n"
    project = files.in_memory(spark, {"g.yaml": graph, "broken.yaml": "a: [", "s.json": '{"type": "object", "required": ["x"]}', "bad.json": '{"properties": {"x": {"type": "text"}}}', "step.py": "def handler(x: int) -> str: ..."})
    got = bundle.load(project)
    found = {(r.code, (r.node_id or r.edge_id or r.message).split("#")[-1]) for r in got.diagnostics.collect()}
    assert {("unresolved-schema", "b"), ("invalid-json-schema", "c"), ("subgraph-cycle", "g.yaml"), ("invalid-manifest", "Bad"), ("invalid-manifest", "f"), ("invalid-manifest", "")} <= found
    assert ("invalid-json-schema", "a") not in found
    assert got.contracts.select("name", "path").first() == ("handler", "step.py")
    assert [r.id for r in bundle.reachable(got.nodes, spark.createDataFrame([("g.yaml",)], "id string")).collect()] == ["g.yaml"]


def test_a_composition_in_one_go(spark):
    from loomgraph.sources import bundle

    app = """
kind: Composition
spec:
  nodes:
    - { id: web, type: client, client: web, path: web }
    - { id: api, type: boundary, boundary: api, exposes: [svc, web], invocation: { svc: sync } }
    - { id: svc, type: service, impl: { graph: g.yaml } }
    - { id: job, type: process, calls: [svc, none] }
  edges:
    - { id: a, kind: routes-to, from: { node: web }, to: { node: api } }
    - { id: b, kind: routes-to, from: { node: web }, to: { node: svc } }
"""
    agent = "kind: Agent\nmetadata: { id: bot, name: Bot }\nspec: { promptFile: agents/bot/prompt.md, maxTurns: 3 }\n"
    got = bundle.load(files.in_memory(spark, {"app.yaml": app, "agents/bot/agent.yaml": agent}))
    assert {(r.code, r.file, r.node_id or r.edge_id) for r in got.diagnostics.collect()} == {("exposes-non-service", "app.yaml", "api"), ("calls-non-service", "app.yaml", "job"), ("unresolved-ref", "app.yaml", "svc"), ("edge-kind-bad-source", "app.yaml", "b")} | {("invalid-manifest", f, n) for f, n in (("app.yaml", None), ("app.yaml", "job"), ("agents/bot/agent.yaml", None))}  # no version, no metadata, no trigger
    assert [tuple(r) for r in got.agents.collect()] == [("agents/bot/agent.yaml", "bot", "Bot", None, "agents/bot/prompt.md", 3)]


def test_workspaces_and_heads(spark):
    workspace = spark.createDataFrame([("a", "1", 1), ("b", "2", 4)], "path string, content string, version int")
    after, refused = files.write_through(workspace, files.in_memory(spark, {"a": "1", "b": "3", "c": "4"}))
    assert sorted(map(tuple, after.collect())) == [("a", "1", 1), ("b", "3", 5), ("c", "4", 1)] and refused.count() == 0
    same, refused = files.write_through(workspace, files.in_memory(spark, {"../x": "1", "b": "3"}))
    assert [r.path for r in refused.collect()] == ["../x"] and sorted(map(tuple, same.collect())) == [("a", "1", 1), ("b", "2", 4)]
    refs = spark.createDataFrame([("m", "h1"), ("n", "h2"), ("o", "h3")], "branch string, head string")
    moves = spark.createDataFrame([("m", "h1", "x"), ("n", "h1", "y")], "branch string, expected string, new string")
    moved, outcome = files.move_heads(refs, moves)
    assert sorted(map(tuple, moved.collect())) == [("m", "x"), ("n", "h2"), ("o", "h3")]
    assert sorted(map(tuple, outcome.collect())) == [("m", True, "x"), ("n", False, "h2")]


def test_schema_problems():
    from loomgraph.operators.validation import schema_problem

    good = [True, {}, {"type": ["string", "null"], "minLength": 1}, {"anyOf": [{"enum": [1]}], "items": {"pattern": "^a"}}]
    bad = [[], "x", {"type": "text"}, {"required": "x"}, {"required": ["a", "a"]}, {"minLength": -1}, {"anyOf": []}, {"items": {"pattern": "("}}, {"properties": []}, {"properties": {"a": 3}}]
    assert [schema_problem(s) for s in good] == [None] * len(good)
    assert all(schema_problem(s) for s in bad)
