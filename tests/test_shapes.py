"""Shapes of manifests against a plain checker."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import shapes
from loomgraph.operators import validation


def found(spark, shape, *values):
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string").withColumn("v", F.parse_json("t"))
    rows = frame.select("k", shape.issues(F.col("v"), F.lit("")).alias("i")).orderBy("k").collect()
    return [[(i.pointer, i.message) for i in r.i] for r in rows]


def test_small_shapes(spark):
    shape = shapes.Fields({"a": shapes.Items(shapes.Number(whole=True, positive=True)), "b": shapes.Names(shapes.ID, shapes.Among(("x", "y")))}, ("b",), strict=True)
    got = found(spark, shape, {"a": [1, 2]}, {"a": [0, 1.5, "1", None]}, {"b": {"k": "x", "B/~": "y", "m": 3}, "a": []}, {"a": None, "z": 1, "c": 2}, [1], None, {})
    assert got == [
        [], [(f"/a/{k}", "must be a positive whole number") for k in range(4)], [("/b/B~1~0", shapes.ID.message), ("/b/m", "must be x or y")],
        [("/a", "must be an array"), ("", "has unknown fields: c, z")], [("", "must be an object")], [("", "must be an object")], [("/a", "is missing")],
    ]


def test_the_branch_with_the_fewest_issues_speaks(spark):
    one, two = shapes.Fields({"graph": shapes.PATH}, strict=True), shapes.Fields({"entrypoint": shapes.PATH, "n": shapes.Number()}, strict=True)
    got = found(spark, shapes.Union((one, two)), {"graph": "a.yaml"}, {"entrypoint": "/a"}, {"entrypoint": "/a", "n": 1}, {"other": 1}, 5)
    assert got == [[], [("/graph", "is missing"), ("", "has unknown fields: entrypoint")], [("/entrypoint", shapes.PATH.message)], [("/graph", "is missing"), ("", "has unknown fields: other")], [("", "must be an object")]]


HEAD = {"apiVersion": "v1", "metadata": {"id": "m"}}


@pytest.mark.parametrize(("document", "wanted"), [
    (HEAD | {"kind": "Agent", "spec": {"promptFile": "p.md", "maxTurns": 3}}, []), (HEAD | {"kind": "Agent", "spec": {"promptFile": "../p.md", "maxTurns": 0, "model": ""}}, [("/spec/model", None, None), ("/spec/promptFile", None, None), ("/spec/maxTurns", None, None)]),
    ({"kind": "Agent", "metadata": {"id": "No", "name": ""}}, [("/apiVersion", None, None), ("/metadata/id", None, None), ("/metadata/name", None, None), ("/spec", None, None)]),
    (HEAD | {"kind": "Graph", "spec": {"nodes": [{"id": "a", "type": "io", "direction": "both"}, {"id": "B", "type": "code", "include": ["", 3]}, {"type": "agent"}, {"id": "x", "type": "odd"}, 7], "edges": [{"id": "e", "kind": "flow", "from": {"node": "a"}, "to": {"node": "b", "function": ""}}]}, "layout": {"nodes": {"a": {"x": 1}}}},
     [("/spec/nodes/0/direction", "a", None), ("/spec/nodes/1/id", "B", None), ("/spec/nodes/1/include/0", "B", None), ("/spec/nodes/1/include/1", "B", None), ("/spec/nodes/2/id", None, None), ("/spec/nodes/2/ref", None, None), ("/spec/nodes/3/type", "x", None), ("/spec/nodes/4", None, None), ("/spec/edges/0/to/function", None, "e"), ("/layout/nodes/a/y", None, None)]),
    (HEAD | {"kind": "Composition", "spec": {"nodes": [{"id": "s", "type": "service", "impl": {"graph": "g.yaml", "entrypoint": "x.py"}}, {"id": "b", "type": "boundary", "boundary": "api", "exposes": ["s", "S"], "invocation": {"s": "later"}}, {"id": "p", "type": "process", "trigger": {"kind": "schedule", "cron": ""}}, {"id": "c", "type": "client", "client": "web", "path": "web"}]}},
     [("/spec/nodes/0/impl", "s", None), ("/spec/nodes/1/exposes/1", "b", None), ("/spec/nodes/1/invocation/s", "b", None), ("/spec/nodes/2/trigger/cron", "p", None)]),
    ({"kind": "Other"}, [("/kind", None, None)]), ([1], [("", None, None)]), (None, [("", None, None)]),
])
def test_manifests(spark, document, wanted):
    rows = spark.createDataFrame([("f.yaml", json.dumps(document) if document is not None else None)], "path string, document string")
    got = [(r.pointer, r.node_id, r.edge_id) for r in validation.manifest_issues(rows).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
