"""Logs of changes over many graphs against the same ops one graph at a time."""

from __future__ import annotations

import json
import random

import pytest

from loomgraph.operators import mutations, oplog

NODES = "graph string, id string, type string, fields map<string,string>"
EDGES = "graph string, id string, kind string, src string, dst string, fields map<string,string>"
PLACES = "graph string, id string, x double, y double"


def rows(df):
    return sorted((json.dumps(r.asDict(), sort_keys=True) for r in df.collect()))


def batches(rng):
    """A graph's ops; now and then one that is refused."""
    out = []
    for k in range(rng.randrange(1, 6)):
        pick = rng.choice
        out.append(pick([
            {"op": "addNode", "node": {"id": f"n{k}", "type": "code", "exposes": ["a", "b"], "invocation": {"a": "sync", "c": "async"}}}, {"op": "addEdge", "edge": {"id": f"f{k}", "kind": "flow", "src": "a", "dst": pick("abc"), "note": {"x": 1}}},
            {"op": "setLayout", "nodes": {"a": {"x": k, "y": 2}, "c": {"x": 0, "y": 0.5}}}, {"op": "removeEdge", "id": pick(["e", "g"])}, {"op": "removeNode", "id": pick("abc"), "cascadeEdges": rng.random() < 0.8},
            {"op": "updateNode", "id": pick("ab"), "patch": {"name": pick(["A", None, "B"]), "size": k}}, {"op": "updateEdge", "id": "e", "patch": {"note": "x"}}, {"op": "renameNode", "id": pick("abc"), "to": pick(["z", "b", "Bad"]), "updateReferences": rng.random() < 0.8}, {"op": pick(["what", "addNode"]), "id": "a", "node": {"type": "io"}},
        ]))
    return out


def test_op_logs_match_ops_graph_by_graph(spark):
    rng = random.Random(3)
    nodes = [("a", "code", {"name": "A", "calls": '["b","c"]'}), ("b", "agent", {}), ("c", "io", {"direction": "in"})]
    edges = [("e", "flow", "a", "b", {}), ("g", "flow", "b", "c", {"note": "1"})]
    names = [f"g{k}" for k in range(12)]
    logs = {g: batches(rng) for g in names[:10]}
    tables = [spark.createDataFrame([(g, *r) for g in names for r in part], shape) for part, shape in ((nodes, NODES), (edges, EDGES), ([("a", 1.0, 2.0)], PLACES))]
    ops = spark.createDataFrame([(g, k, json.dumps(op)) for g, log in logs.items() for k, op in enumerate(log)], "graph string, ord long, op string").repartition(5)
    *after, outcomes = oplog.apply_op_log(*tables, ops)
    told = {r.graph: (r.said, r.refusal) for r in outcomes.collect()}
    assert set(told) == set(logs)
    refused = 0
    for g in names:
        own = mutations.GraphTables(*[t.where(f"graph = '{g}'").drop("graph") for t in tables])
        try:
            done, said = mutations.apply_ops(own, logs.get(g, []))
            assert told.get(g, ("", None)) == (said, None)
        except mutations.Refused as error:
            done, refused = own, refused + 1
            assert told[g][1] == str(error)
        for got, want in zip(after, (done.nodes, done.edges, done.layout), strict=True):
            assert rows(got.where(f"graph = '{g}'").drop("graph").select(*want.columns)) == rows(want)
    assert 0 < refused < 10


@pytest.mark.parametrize("text", ["{", "[]", '{"op": "removeNode"}', '{"op": "addEdge", "edge": 3}', '{"op": "setLayout", "nodes": {"a": {}}}'])
def test_malformed_ops_change_nothing(text):
    graph = oplog.State([{"id": "a", "type": "code", "fields": {}}])
    after, said, refusal = oplog.fold(graph, ['{"op": "renameNode", "id": "a", "to": "b"}', text])
    assert after == graph and said == "rename a to b" and refusal == "op 1 is malformed"


def test_ten_thousand_graphs_in_one_plan(spark):
    graphs = spark.range(10_000).selectExpr("concat('g', id) AS graph")
    none = "map() AS fields"
    nodes = graphs.selectExpr("graph", "explode(array('a', 'b')) AS id", "'code' AS type", f"cast({none.split(' AS')[0]} AS map<string,string>) AS fields")
    edges = graphs.selectExpr("graph", "'e' AS id", "'flow' AS kind", "'a' AS src", "'b' AS dst", "cast(map() AS map<string,string>) AS fields")
    five = [{"op": "addNode", "node": {"id": "c", "type": "io"}}, {"op": "addEdge", "edge": {"id": "f", "kind": "flow", "src": "b", "dst": "c"}}, {"op": "renameNode", "id": "a", "to": "start"}, {"op": "removeNode", "id": "b"}, {"op": "setLayout", "nodes": {"c": {"x": 1, "y": 1}}}]
    ops = graphs.crossJoin(spark.createDataFrame([(k, json.dumps(op)) for k, op in enumerate(five)], "ord long, op string"))
    after, links, places, outcomes = oplog.apply_op_log(nodes, edges, spark.createDataFrame([], PLACES), ops)
    assert {(r.id, r["count"]) for r in after.groupBy("id").count().collect()} == {("start", 10_000), ("c", 10_000)}
    assert links.count() == 0 and places.count() == 10_000 and outcomes.where("refusal is null").count() == 10_000


def test_a_graph_goes_to_one_task_when_its_tables_are_dealt_already(spark, monkeypatch):
    """The parts of the union are dealt by graph, which is no deal of their union once each merges its partitions."""
    plans, stored = [], oplog.stored
    monkeypatch.setattr(oplog, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.range(30).selectExpr("concat('g', id) AS graph").groupBy("graph").count().drop("count")
        nodes = names.selectExpr("graph", "explode(array('a', 'b')) AS id", "'code' AS type", "cast(map() AS map<string,string>) AS fields")
        edges = names.selectExpr("graph", "'e' AS id", "'flow' AS kind", "'a' AS src", "'b' AS dst", "cast(map() AS map<string,string>) AS fields")
        ops = names.selectExpr("graph", "0 AS ord", """'{"op": "removeNode", "id": "a"}' AS op""")
        after, links, _, outcomes = oplog.apply_op_log(nodes, edges, spark.createDataFrame([], PLACES), ops)
        assert (after.count(), links.count(), outcomes.where("refusal is null").count()) == (30, 0, 30)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    head = plans[0].split("Union")[0]
    assert "MapInArrow" in head and "Exchange hashpartitioning" in head
