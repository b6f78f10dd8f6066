"""Logs of changes over many graphs: each graph's ops in their order, all of them or none, in one plan.

Graphs are tables with a column graph: nodes (graph, id, type, fields), edges (graph, id, kind, src, dst,
fields), layout (graph, id, x, y).  A log is ops (graph, ord, op), op being JSON.  Graphs are dealt to tasks
by their name; a task holds the graph it is at, and graphs without ops are not touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import ID_PATTERN
from loomgraph.operators.mutations import NAME_LISTS, NAME_MAPS, Refused
from loomgraph.sources.shared import stored

_ROW = "what string, ord bigint, id string, type string, kind string, src string, dst string, fields map<string,string>, x double, y double, text string"


@dataclass
class State:
    """One graph: nodes and edges in their order, by place, so that an id may stand twice as in the tables."""

    nodes: list[dict[str, Any]] = field(default_factory=list)
    edges: list[dict[str, Any]] = field(default_factory=list)
    layout: dict[str, tuple[float, float]] = field(default_factory=dict)

    def copy(self) -> State:
        return State([dict(n) for n in self.nodes], [dict(e) for e in self.edges], dict(self.layout))

    def named(self, side: str, name: str) -> list[dict[str, Any]]:
        found = [r for r in getattr(self, side) if r["id"] == name]
        if not found:
            raise Refused(f'there is no {side[:-1]} "{name}"')
        return found


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def _taken(given: dict[str, Any], *keys: str) -> dict[str, Any]:
    """A row of the keys, with all else as its fields."""
    return {k: given.get(k) for k in keys} | {"fields": {k: _text(v) for k, v in given.items() if k not in keys}}


def add_node(graph: State, op: dict[str, Any]) -> str:
    if not isinstance(op["node"].get("id"), str):
        raise Refused("a node needs an id")
    graph.nodes.append(_taken(op["node"], "id", "type"))
    return f"add node {op['node']['id']}"


def add_edge(graph: State, op: dict[str, Any]) -> str:
    graph.edges.append(_taken(op["edge"], "id", "kind", "src", "dst"))
    return f"add edge {op['edge']['id']}"


def set_layout(graph: State, op: dict[str, Any]) -> str:
    graph.layout |= {name: (float(at["x"]), float(at["y"])) for name, at in op["nodes"].items()}
    return f"move {len(op['nodes'])} node(s)"


def remove_edge(graph: State, op: dict[str, Any]) -> str:
    graph.named("edges", op["id"])
    graph.edges = [e for e in graph.edges if e["id"] != op["id"]]
    return f"remove edge {op['id']}"


def remove_node(graph: State, op: dict[str, Any]) -> str:
    graph.named("nodes", op["id"])
    gone = {e["id"] for e in graph.edges if op["id"] in (e["src"], e["dst"])}
    if gone and not op.get("cascadeEdges", True):
        raise Refused(f'node "{op["id"]}" still has edges')
    graph.nodes = [n for n in graph.nodes if n["id"] != op["id"]]
    graph.edges = [e for e in graph.edges if e["id"] not in gone]
    graph.layout.pop(op["id"], None)
    return f"remove node {op['id']}"


def update(side: str) -> Callable[[State, dict[str, Any]], str]:
    def run(graph: State, op: dict[str, Any]) -> str:
        found, patch = graph.named(side, op["id"]), op["patch"]
        if not patch or "id" in patch or (side == "nodes" and "type" in patch):
            raise Refused("an update changes neither id nor type, and changes something")
        changed = False
        for row in found:
            after = {k: v for k, v in row["fields"].items() if k not in patch} | {k: _text(v) for k, v in patch.items() if v is not None}
            changed |= after != row["fields"]
            row["fields"] = after
        if not changed:
            raise Refused("the update has no effect")
        return f"update {side[:-1]} {op['id']}"

    return run


def rename_node(graph: State, op: dict[str, Any]) -> str:
    old, new = op["id"], op["to"]
    found = graph.named("nodes", old)
    if not re.match(ID_PATTERN, new):
        raise Refused(f'"{new}" is no id')
    if any(n["id"] == new for n in graph.nodes):
        raise Refused(f'there is a node "{new}" already')
    for node in found:
        node["id"] = new
    if op.get("updateReferences", True):
        for edge in graph.edges:
            edge.update({end: new for end in ("src", "dst") if edge[end] == old})
        if old in graph.layout:
            graph.layout[new] = graph.layout.pop(old)
        for fields in (n["fields"] for n in graph.nodes):
            for key in NAME_LISTS + NAME_MAPS:
                names = json.loads(fields[key]) if key in fields else None
                if names and old in names:
                    swapped = {new if k == old else k: v for k, v in names.items()} if key in NAME_MAPS else [new if k == old else k for k in names]
                    fields[key] = json.dumps(swapped, separators=(",", ":"), ensure_ascii=False)
    return f"rename {old} to {new}"


OPS: dict[str, Callable[[State, dict[str, Any]], str]] = {
    "addNode": add_node, "addEdge": add_edge, "setLayout": set_layout, "removeEdge": remove_edge, "removeNode": remove_node,
    "updateNode": update("nodes"), "updateEdge": update("edges"), "renameNode": rename_node,
}


def fold(graph: State, ops: list[str]) -> tuple[State, str, str | None]:
    """The graph after the ops, their summary, and why it was refused: the graph is then as it was."""
    now, said = graph.copy(), []
    for text in ops:
        try:
            op = json.loads(text)
            if op.get("op") not in OPS:
                raise Refused(f"unknown op {op.get('op')}")
            said.append(OPS[op["op"]](now, op))
        except (Refused, ValueError, KeyError, TypeError, AttributeError) as error:
            return graph, "; ".join(said), str(error) if isinstance(error, Refused) else f"op {len(said)} is malformed"
    return now, "; ".join(said), None


def _rows(name: Any, graph: State, said: str, refusal: str | None) -> Iterator[dict[str, Any]]:
    for what, side in (("node", graph.nodes), ("edge", graph.edges)):
        yield from ({"graph": name, "what": what, "ord": k, **row, "fields": list(row["fields"].items())} for k, row in enumerate(side))
    yield from ({"graph": name, "what": "place", "id": node, "x": x, "y": y} for node, (x, y) in graph.layout.items())
    yield {"graph": name, "what": "said", "text": said}
    if refusal is not None:
        yield {"graph": name, "what": "refusal", "text": refusal}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of graph, what and ord, a graph's ops behind its tables, to the graph's rows after the ops."""
    name, graph, ops, begun, schema = None, State(), [], False, None
    for batch in batches:
        schema, out = batch.schema, []
        for r in batch.to_pylist():
            if not begun or r["graph"] != name:
                if begun:
                    out += _rows(name, *fold(graph, ops))
                name, graph, ops, begun = r["graph"], State(), [], True
            if r["what"] == "node":
                graph.nodes.append({"id": r["id"], "type": r["type"], "fields": dict(r["fields"] or ())})
            elif r["what"] == "edge":
                graph.edges.append({c: r[c] for c in ("id", "kind", "src", "dst")} | {"fields": dict(r["fields"] or ())})
            elif r["what"] == "place":
                graph.layout[r["id"]] = (r["x"], r["y"])
            else:
                ops.append(r["text"])
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if begun:
        yield pa.RecordBatch.from_pylist(list(_rows(name, *fold(graph, ops))), schema=schema)


def apply_op_log(nodes: DataFrame, edges: DataFrame, layout: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, layout, outcomes) after the log; outcomes (graph, said, refusal) has a row for each graph with ops.

    A graph's ops are one batch: where one is refused, or is no op, none counts, and refusal says why.
    A graph that no table knows begins empty.
    """
    kind = ops.schema["graph"].dataType.simpleString()
    shape = {part.split()[0]: part.split(" ", 1)[1] for part in _ROW.split(", ")}

    def tagged(df: DataFrame, what: str, **known: str) -> DataFrame:
        own = {"what": F.lit(what)} | {c: F.col(v) for c, v in known.items()}
        return df.select("graph", *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in shape.items()])

    asked = ops.select("graph").distinct()
    mine = lambda df: df.join(asked, "graph", "left_semi")
    order = {"ord": "ord"}
    rows = tagged(mine(nodes), "node", id="id", type="type", fields="fields", **(order if "ord" in nodes.columns else {}))
    rows = rows.unionByName(tagged(mine(edges), "edge", id="id", kind="kind", src="src", dst="dst", fields="fields", **(order if "ord" in edges.columns else {})))
    rows = rows.unionByName(tagged(mine(layout), "place", id="id", x="x", y="y")).unionByName(tagged(ops, "zop", text="op", ord="ord"))
    # By a hash of the graph: the union's parts are dealt by graph already, and Spark, which then leaves out a
    # repartition by it, merges each part's partitions in its own way.
    sorted_ = rows.repartition(F.xxhash64("graph")).sortWithinPartitions("graph", "what", "ord", "id")
    done = stored(sorted_.mapInArrow(_folded, f"graph {kind}, {_ROW}"))
    rest = lambda df, columns: df.join(asked, "graph", "left_anti").select("graph", *columns)
    after = lambda df, what, columns: rest(df, columns).unionByName(done.where(F.col("what") == what).select("graph", *columns))
    outcomes = done.where("what = 'said'").select("graph", F.col("text").alias("said")).join(done.where("what = 'refusal'").select("graph", F.col("text").alias("refusal")), "graph", "left")
    return after(nodes, "node", ["id", "type", "fields"]), after(edges, "edge", ["id", "kind", "src", "dst", "fields"]), after(layout, "place", ["id", "x", "y"]), outcomes
