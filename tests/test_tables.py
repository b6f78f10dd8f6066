"""Overlay, run log, validation and changes on hand-made tables."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import emissions, folds, graphs, mutations, overlay, runlog, validation

PENDING = "path string, kind string, content string, from_path string"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("a.md", "A"), ("dir/b.md", "B"), ("dir/c.yaml", "C")], "path string, content string")


def pending(spark, *rows):
    return spark.createDataFrame(list(rows), PENDING)


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_shadow_the_base(spark, base):
    p = pending(spark, ("a.md", "modify", "A2", None), ("new.md", "add", "N", None), ("dir/b.md", "delete", None, None))
    assert listed(overlay.read(base, p)) == [("a.md", "A2", "modify"), ("dir/c.yaml", "C", "base"), ("new.md", "N", "add")]
    assert listed(overlay.listing(base, p, "**/*.md")) == [("a.md",), ("new.md",)]


def test_a_rename_reads_its_old_path(spark, base):
    p = pending(spark, ("z.md", "rename", None, "a.md"))
    assert ("z.md", "A", "rename") in listed(overlay.read(base, p))
    assert ("a.md",) not in listed(overlay.listing(base, p))
    assert listed(overlay.to_hydrate(spark.createDataFrame([("z.md",), ("dir/b.md",)], "path string"), p)) == [("a.md",), ("dir/b.md",)]


def test_a_path_renamed_away_stays_away(spark, base):
    p = pending(spark, ("z.md", "rename", None, "a.md"), ("a.md", "add", "again", None))
    assert [r for r in listed(overlay.read(base, p)) if r[0] == "a.md"] == []


def test_a_directory_of_deleted_files_still_exists(spark, base):
    p = pending(spark, ("dir/b.md", "delete", None, None), ("dir/c.yaml", "delete", None, None))
    asked = spark.createDataFrame([("dir",), ("dir/b.md",), ("none",)], "path string")
    assert listed(overlay.exists(base, p, asked)) == [("dir", True), ("dir/b.md", False), ("none", False)]


def test_saving_over_a_delete_is_a_modify(spark):
    p = pending(spark, ("a", "delete", None, None), ("b", "add", "1", None))
    saves = pending(spark, ("a", "modify", "x", None), ("b", "modify", "2", None), ("c", "add", "3", None))
    assert listed(overlay.upsert(p, saves).select("path", "kind", "content")) == [("a", "modify", "x"), ("b", "add", "2"), ("c", "add", "3")]
    assert listed(overlay.remove(p, spark.createDataFrame([("b",), ("d",)], "path string")).select("path", "kind")) == [("a", "delete"), ("d", "delete")]


def test_constraints(spark):
    p = pending(spark, ("../x", "add", "1", None), ("b", "delete", "c", None), ("c", "odd", None, None), ("d", "rename", None, "d"))
    assert listed(overlay.violations(p)) == [("../x", "relative path"), ("b", "delete has no content"), ("c", "kind"), ("d", "rename has an old path")]


LOG = "run_id long, seq long, type string, node_id string, graph_path string, payload string"


def test_run_states(spark):
    log = spark.createDataFrame([
        (1, 0, "run.started", None, None, "{}"), (1, 1, "node.started", "a", None, "{}"), (1, 2, "node.finished", "a", None, "{}"), (1, 3, "node.started", "b", "sub", "{}"), (1, 4, "run.finished", None, None, '{"status": "failed"}'), (1, 5, "node.finished", "b", "sub", "{}"),
        (2, 0, "run.finished", None, None, '{"status": "cancelled"}'), (2, 1, "run.started", None, None, "{}"), (3, 0, "run.started", None, None, "{}"),
    ], LOG)
    assert listed(runlog.run_status(log).select("run_id", "status")) == [(1, "failed"), (2, "cancelled"), (3, "running")]
    assert listed(runlog.node_states(log)) == [(1, "a", "finished"), (1, "b", "finished")]
    assert listed(runlog.node_states(log, "sub")) == [(1, "b", "finished")]
    assert runlog.without_late(log).where("run_id = 1").count() == 5
    assert runlog.sequence_gaps(log).count() == 0
    more = spark.createDataFrame([(1, "x", 9)], "run_id long, type string, at long")
    nexts = log.groupBy("run_id").agg((F.max("seq") + 1).alias("next_seq"))
    assert runlog.number(more, "run_id", "at", base=nexts).first().seq == 6


NODES = "ord int, id string, type string, direction string, ref string, entrypoint string, include array<string>"
EDGES = "ord int, id string, kind string, src string, dst string, function string"


def test_graph_rules(spark):
    nodes = spark.createDataFrame([
        (0, "in", "io", "in", None, None, None), (1, "step", "code", None, None, None, ["src/**/*.py"]), (2, "bot", "agent", None, "agents/missing.yaml", None, None), (3, "out", "io", "out", None, None, None), (4, "step", "code", None, None, "src/a.py", None), (5, "x", "code", None, None, "no.py", ["none/*"]),
    ], NODES)
    edges = spark.createDataFrame([
        (0, "e1", "flow", "in", "step", None), (1, "e2", "flow", "out", "in", None), (2, "e3", "capability", "step", "bot", "f"), (3, "e4", "flow", "step", "ghost", None), (4, "e5", "flow", "x", "bot", None), (5, "e6", "flow", "bot", "x", None),
    ], EDGES)
    files = spark.createDataFrame([("src/a.py", ""), ("src/b/c.py", "")], "path string, content string")
    found = validation.validate_graph(nodes, edges, files).cache()
    codes = {(r.code, r.node_id, r.edge_id) for r in found.collect()}
    assert {("duplicate-id", "step", None), ("unknown-node", None, "e4"), ("io-direction-violation", None, "e2"), ("capability-edge-bad-source", None, "e3"), ("capability-edge-bad-target", None, "e3"), ("unresolved-ref", "bot", None), ("unresolved-entrypoint", "x", None), ("unresolved-ref", "x", None), ("flow-code-node-needs-entrypoint", "step", None), ("flow-cycle", "bot", None)} == codes
    assert tuple(validation.blocks_run(found).first()) == (True, True)
    assert tuple(validation.blocks_run(found.where("false")).first()) == (False, False)


def test_composition_rules(spark):
    nodes = spark.createDataFrame([
        (0, "web", "client", None, None, None, None, None), (1, "api", "boundary", ["svc", "web", "lost"], {"svc": "sync", "other": "async"}, None, None, None), (2, "svc", "service", None, None, None, "g.yaml", None), (3, "cron", "process", None, None, ["api"], None, None),
    ], "ord int, id string, type string, exposes array<string>, invocation map<string,string>, calls array<string>, graph string, entrypoint string")
    edges = spark.createDataFrame([(0, "ok", "routes-to", "web", "api", None), (1, "direct", "routes-to", "web", "svc", None), (2, "back", "routes-to", "api", "web", None), (3, "dep", "depends-on", "api", "cron", None)], EDGES)
    files = spark.createDataFrame([("x", "")], "path string, content string")
    got = {(r.code, r.node_id or r.edge_id) for r in validation.validate_composition(nodes, edges, files).collect()}
    assert got == {("exposes-non-service", "api"), ("calls-non-service", "cron"), ("unresolved-ref", "svc"), ("edge-kind-bad-source", "direct"), ("client-is-edge-target", "back"), ("edge-kind-bad-source", "dep"), ("edge-kind-bad-target", "dep")}
    kinds = {r.id: (r.kind, r.refusal is None) for r in graphs.composition_edge_kind(edges.select("id", "src", "dst"), nodes).collect()}
    assert kinds == {"ok": ("routes-to", True), "direct": ("", False), "back": ("", False), "dep": ("", False)}


def test_depths_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzs"], "id string")
    assert listed(graphs.depths(nodes, edges)) == [("a", 0), ("b", 1), ("c", 2)]
    assert listed(graphs.on_cycles(edges)) == [("s",), ("x",), ("y",)]
    assert listed(graphs.closure(spark.createDataFrame([("y",)], "id string"), edges)) == [("x", 1), ("y", 0), ("z", 1)]


def test_long_chains(spark, monkeypatch):
    """A chain and a ring of 10,000 edges take fewer than 40 rounds."""
    n, rounds, kept = 10_000, [], graphs._kept
    monkeypatch.setattr(graphs, "_kept", lambda df: (rounds.append(1), kept(df))[1])
    chain = spark.range(n).selectExpr("format_string('n%05d', id) AS src", "format_string('n%05d', id + 1) AS dst")
    nodes = spark.range(n + 1).selectExpr("format_string('n%05d', id) AS id")
    wanted = [(f"n{k:05}", k) for k in range(n + 1)]

    def within(most, got):
        done = listed(got)
        assert len(rounds) < most
        rounds.clear()
        return done

    assert within(40, graphs.depths(nodes, chain)) == wanted
    assert within(40, graphs.closure(nodes.where("id = 'n00000'"), chain)) == wanted
    ring = chain.unionByName(spark.createDataFrame([(f"n{n:05}", "n00000")], chain.schema))
    assert len(within(40, graphs.on_cycles(ring))) == n + 1
    assert within(60, graphs.on_cycles(chain)) == []
    assert [len(r.path) for r in graphs.cycles(ring).collect()] == [n + 2]
    rounds.clear()
    # Two rings that a chain ties together, and a chain behind them.
    other = spark.range(300).selectExpr("format_string('m%05d', id) AS src", "format_string('m%05d', (id + 1) % 300) AS dst")
    tied = ring.unionByName(other).unionByName(spark.createDataFrame([("n00007", "m00009"), ("m00100", "z"), ("z", "zz")], chain.schema))
    assert len(within(60, graphs.strong_components(tied))) == n + 1 + 300
    assert within(40, graphs.depths(nodes, ring)) == []


def test_depths_where_ways_meet_again_and_again(spark):
    rungs = 6
    edges = [(f"{x}{k}", f"{y}{k + 1}") for k in range(rungs) for x in "ab" for y in "ab"] + [(f"a{rungs}", "t0")] + [(f"t{k}", f"t{k + 1}") for k in range(20)] + [("a0", "t5"), ("q", "t9")]
    nodes = sorted({n for e in edges for n in e} - {"q"})
    got = dict(listed(graphs.depths(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"))))
    wanted = {f"{x}{k}": k for k in range(rungs + 1) for x in "ab"} | {f"t{k}": rungs + 1 + k for k in range(9)}
    assert got == wanted  # q is no node, so what is behind it has no depth


@pytest.mark.parametrize("seed", range(1, 7))
def test_walks_match_plain_ones(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(rng.choice([12, 18, 24]))] + [(90, 3)] * (seed % 2)
    nodes = list(range(15))
    frame, ids = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "id long")
    reach = {n: {b for a, b in edges if a == n} for n in range(100)}
    for _ in range(15):
        reach = {n: r | {x for m in r for x in reach[m]} for n, r in reach.items()}
    assert listed(graphs.on_cycles(frame)) == [(n,) for n in nodes if n in reach[n]]
    depth, open_ = {}, {b for _, b in edges}
    for n in nodes:
        if n not in open_:
            depth[n] = 0
    for _ in nodes:
        for n in nodes:
            own = [a for a, b in edges if b == n]
            if n not in depth and own and all(a in depth for a in own):
                depth[n] = 1 + max(depth[a] for a in own)
    assert listed(graphs.depths(ids, frame)) == sorted(depth.items())
    near = {0: 0}
    for k in range(15):
        near |= {b: k + 1 for a, b in edges if near.get(a) == k and b not in near}
    assert listed(graphs.closure(ids.where("id = 0"), frame)) == sorted(near.items())
    paths = [r.path for r in graphs.cycles(frame).collect()]
    assert all(p[0] == p[-1] == min(p) and all((a, b) in edges for a, b in zip(p, p[1:], strict=False)) for p in paths)
    assert len({frozenset(p) for p in paths}) == len(paths) and {n for p in paths for n in p} <= {n for n in nodes if n in reach[n]}
    parts = {frozenset(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}
    assert all(any(set(p) <= c for p in paths) for c in parts)


@pytest.fixture
def tables(spark):
    nodes = spark.createDataFrame([("a", "code", {"name": "A"}), ("b", "agent", {})], "id string, type string, fields map<string,string>")
    edges = spark.createDataFrame([("e", "flow", "a", "b", {})], "id string, kind string, src string, dst string, fields map<string,string>")
    return mutations.GraphTables(nodes, edges, spark.createDataFrame([("a", 1.0, 2.0)], "id string, x double, y double"))


def test_ops_in_order(tables):
    ops = [
        {"op": "addNode", "node": {"id": "c", "type": "io", "direction": "out"}}, {"op": "addEdge", "edge": {"id": "f", "kind": "flow", "src": "b", "dst": "c"}},
        {"op": "updateNode", "id": "a", "patch": {"name": None, "entrypoint": "x.py"}}, {"op": "renameNode", "id": "a", "to": "start"}, {"op": "setLayout", "nodes": {"c": {"x": 3, "y": 4}}},
    ]
    done, said = mutations.apply_ops(tables, ops)
    assert listed(done.nodes.select("id")) == [("b",), ("c",), ("start",)]
    assert done.nodes.where("id = 'start'").first().fields == {"entrypoint": "x.py"}
    assert listed(done.edges.select("id", "src", "dst")) == [("e", "start", "b"), ("f", "b", "c")]
    assert listed(done.layout) == [("c", 3.0, 4.0), ("start", 1.0, 2.0)]
    assert said == "add node c; add edge f; update node a; rename a to start; move 1 node(s)"
    left, _ = mutations.apply_ops(done, [{"op": "removeNode", "id": "b"}])
    assert left.edges.count() == 0 and left.nodes.count() == 2


@pytest.mark.parametrize("op", [
    {"op": "removeEdge", "id": "none"}, {"op": "removeNode", "id": "a", "cascadeEdges": False}, {"op": "updateNode", "id": "a", "patch": {}}, {"op": "updateNode", "id": "a", "patch": {"type": "io"}},
    {"op": "updateNode", "id": "a", "patch": {"name": "A"}}, {"op": "renameNode", "id": "a", "to": "b"}, {"op": "renameNode", "id": "a", "to": "Bad"}, {"op": "addNode", "node": {}}, {"op": "what", "id": "a"},
])
def test_refusals(tables, op):
    with pytest.raises(mutations.Refused):
        mutations.apply_ops(tables, [op])


def test_a_rename_follows_names_in_fields(spark):
    nodes = spark.createDataFrame([("a", "service", {}), ("web", "client", {"exposes": '["a","b"]', "invocation": '{"b":"sync","a":"async"}', "title": "a"}), ("job", "process", {"calls": '["a"]'})], "id string, type string, fields map<string,string>")
    edges = spark.createDataFrame([], "id string, kind string, src string, dst string, fields map<string,string>")
    t = mutations.GraphTables(nodes, edges, spark.createDataFrame([], "id string, x double, y double"))
    done, _ = mutations.apply_ops(t, [{"op": "renameNode", "id": "a", "to": "z"}])
    got = {r.id: r.fields for r in done.nodes.collect()}
    assert got["web"] == {"exposes": '["z","b"]', "invocation": '{"b":"sync","z":"async"}', "title": "a"} and got["job"] == {"calls": '["z"]'} and "z" in got
    kept, _ = mutations.apply_ops(t, [{"op": "renameNode", "id": "a", "to": "z", "updateReferences": False}])
    assert {r.id: r.fields for r in kept.nodes.collect()}["job"] == {"calls": '["a"]'}


def test_cancelled_runs(spark):
    rows = [(r, k, t, "n", None, "{}") for r in (1, 2, 3) for k, t in enumerate(["run.started", "node.started", "node.finished", "run.finished"])]
    log = spark.createDataFrame(rows, LOG)
    requests = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "run_id long, seq long")
    got = [(r.run_id, r.seq, r.type) for r in runlog.cancelled_at(log, requests).orderBy("run_id", "seq").collect()]
    assert got == [(1, 0, "run.started"), (1, 1, "node.started"), (1, 2, "run.finished"), *[(r, k, t) for r, k, t, *_ in rows if r > 1]]
    assert {r.run_id: r.status for r in runlog.run_status(runlog.cancelled_at(log, requests)).collect()} == {1: "cancelled", 2: "finished", 3: "finished"}


def test_new_entrypoints_and_layout(spark):
    nodes = spark.createDataFrame([("a-b", "code", None, None), ("c", "code", ["lib/x/*.py"], None), ("d", "code", ["x.py"], None), ("e", "code", None, "e.py"), ("f", "io", None, None)], "id string, type string, include array<string>, entrypoint string")
    edges = spark.createDataFrame([("flow", "a-b", "c"), ("flow", "d", "e"), ("flow", "f", "c"), ("capability", "x", "a-b")], "kind string, src string, dst string")
    files = spark.createDataFrame([("src/d/main.py",)], "path string")
    assert listed(graphs.new_entrypoints(edges, nodes, files)) == [("a-b", "src/a_b/main.py"), ("c", "lib/x/main.py")]
    where = graphs.laid_out(nodes.select("id", F.lit(4).alias("ord")), spark.createDataFrame([("c", 1.0, 2.0)], "id string, x double, y double"))
    assert {r.id: (r.x, r.y) for r in where.collect()} == {n: (860.0, 180.0) if n != "c" else (1.0, 2.0) for n in ("a-b", "c", "d", "e", "f")}


def test_folds_of_a_group_stream(spark):
    rows = [(g, f"p{k:03}", f"text {k} é" * (k % 7)) for g in ("a", "b", None) for k in range(50)] + [("b", None, "x"), ("b", "q", None), ("c", "q", None)]
    files = spark.createDataFrame(rows, "g string, path string, text string").repartition(5)
    wanted, taken = {}, []
    for g in ("a", "b", None, "c"):
        whole, total = "", 0
        for _, p, t in sorted(r for r in rows if r[0] == g and None not in r[1:]):
            whole += f"{p}\0{t}\0"
            if len(t.encode()) <= 40 and total + len(t.encode()) <= 300:
                total += len(t.encode())
                taken.append((str(g), p))
        wanted[g] = hashlib.sha256((whole + "x\0m\0001").encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        hashes = folds.fingerprint(files, ["g"], "path", "text", "x", "m", "1")
        picked = folds.greedy_select(files.where("path is not null"), ["g"], "path", F.octet_length("text"), 40, 300)
        assert {r.g: r.input_hash for r in hashes.collect()} == wanted
        assert sorted((str(r.g), r.path) for r in picked.collect()) == sorted(taken)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for frame in (hashes, picked):
        assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_greedy_selection_goes_on_after_a_file_that_does_not_fit(spark):
    files = spark.createDataFrame([("g", "a", 50), ("g", "b", 80), ("g", "c", 40), ("g", "d", 500)], "g string, path string, size long")
    assert listed(folds.greedy_select(files, ["g"], "path", F.col("size"), 100, 100)) == [("g", "a"), ("g", "c")]


def test_next_id(spark):
    taken = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 3)], "g string, n long")
    assert listed(folds.next_id(taken, "g", "n")) == [("a", 3), ("b", 1)]


def test_emission_entries(spark):
    entries = spark.createDataFrame([("e", 0, "a.py", "x = 1", None), ("e", 1, "a.py", "y", None), ("e", 2, "b.py", "z", "odd"), ("e", 3, None, "z", None)], "emission string, ord int, path string, content string, role string")
    files, issues = emissions.parsed(entries)
    assert listed(files) == [("e", "a.py", "x = 1", "other")]
    assert sorted(r.issue for r in issues.collect()) == ["path is there already", "path or content is missing", "unknown role odd"]


@pytest.mark.parametrize(("content", "issues", "has_run"), [
    ("def run(x):\n    return x\n", [], True), ("def run(x):\n    for y in x:\n        pass\n", [], True), ("def run(x):\n    while x:\n        pass\n", ["run() branches"], True),
    ("import google.generativeai.types\n", ["vendor module google.generativeai.types"], False), ("import google.cloud\n", [], False), ("engine = Engine(model='m')\n", [], False),
    ("def f():\n    return Engine()\n", ["no Engine is made at the top of the module"], False), ("x = OpenAIEngine\n", ["vendor class OpenAIEngine"], False), ("def (", ["line 1 is not Python"], False),
])
def test_source_issues(content, issues, has_run):
    assert emissions.source_issues(content, "other") == (issues, has_run)


def test_schemas_with_references(spark):
    files = spark.createDataFrame([
        ("s/tree.json", '{"type": "object", "properties": {"children": {"items": {"$ref": "#"}}, "a~b": {"$ref": "#/$defs/x~1y"}}, "$defs": {"x/y": {"$ref": "#node"}, "z": {"$anchor": "node", "$ref": "#/properties/a~0b"}}}'),
        ("s/lost.json", '{"properties": {"a": {"$ref": "#/$defs/no"}}}'), ("s/hidden.json", '{"$ref": "#/else/where", "else": true, "where": 1}'), ("s/odd.json", '{"$ref": "#/x-parts/0", "x-parts": [{"type": "text"}]}'),
        ("s/a.json", '{"$ref": "sub/../b.json"}'), ("s/b.json", '{"$ref": "a.json#/$defs/here", "items": {"$ref": "a.json"}}'), ("s/c.json", '{"$ref": "tree.json#/$defs/z"}'), ("s/d.json", '{"allOf": [{"$ref": "c.json"}, {"$ref": "../t/none.json"}]}'), ("s/far.json", '{"$ref": "https://example.com/x.json"}'), ("s/type.json", '{"type": {}}'),
    ], "path string, content string")
    names = ["tree", "lost", "hidden", "odd", "a", "b", "c", "d", "far", "type"]
    nodes = spark.createDataFrame([(n, "io", f"s/{n}.json") for n in names], "id string, type string, schema string")
    got = {}
    for r in validation.schemas(nodes, files).collect():
        got.setdefault(r.node_id, set()).add(r.message.split(": ", 1)[1])
    assert got == {
        "lost": {"/properties/a/$ref #/$defs/no leads nowhere"}, "hidden": {"/$ref #/else/where leads nowhere"}, "odd": {"/x-parts/0/type is not a type"}, "b": {"$ref a.json#/$defs/here leads nowhere"},
        "a": {"refers to a schema that is wrong"}, "d": {"$ref ../t/none.json: no such file"}, "type": {"/type is not a type"},
    }


def test_rounds_follow_the_longest_ring_and_not_the_number_of_nodes(spark, monkeypatch):
    rounds, kept = [], graphs._kept
    monkeypatch.setattr(graphs, "_kept", lambda df: (rounds.append(1), kept(df))[1])
    rings = spark.range(8000).selectExpr("id AS src", "id - id % 4 + (id + 1) % 4 AS dst")
    assert graphs.strong_components(rings).groupBy("component").count().where("count = 4 AND component % 4 = 0").count() == 2000
    assert len(rounds) < 18
    rounds.clear()
    # Without a cycle and with 48 layers, which a trim at both ends takes off two at a time.
    layers = spark.range(48 * 48).selectExpr("id div 48 AS src", "id % 48 AS dst").where("src < dst")
    assert graphs.strong_components(layers).isEmpty()
    assert len(rounds) < 18


@pytest.mark.parametrize(("given", "wanted"), [("67108864b", "8m"), ("64MB", "8m"), ("1g", "8m"), ("16k", "16k"), ("1048576", "1048576")])
@pytest.mark.parametrize("what", ["rules", "walk"])
def test_rules_and_walks_bound_the_rows_of_a_task(spark, what, given, wanted):
    """The partitions that Spark merges get no larger than the bound; a session's own smaller ones stay."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    edges = spark.createDataFrame([(0, "e", "flow", "a", "b")], "ord long, id string, kind string, src string, dst string")
    try:
        spark.conf.set(name, given)
        if what == "walk":
            graphs.cycles(edges)
        else:
            validation.malformed(spark.createDataFrame([], "path string, document string"), spark.createDataFrame([], "graph_path string, ord long, id string, type string, direction string, ref string, entrypoint string, schema string"), edges.withColumn("graph_path", F.lit("g")))
        assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)
