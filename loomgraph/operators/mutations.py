"""Structured changes of graph tables.  A graph is nodes, edges and layout; each change gives new tables or is refused."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import ID_PATTERN


class Refused(ValueError):
    """A change that does not apply; nothing is changed."""


@dataclass(frozen=True)
class GraphTables:
    """nodes (id, type, fields map<string,string>), edges (id, kind, src, dst, fields), layout (id, x, y)."""

    nodes: DataFrame
    edges: DataFrame
    layout: DataFrame


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with either end among ids (id), each once."""
    sides = edges.withColumn("end", F.explode(F.array_distinct(F.array("src", "dst"))))
    hit = sides.join(ids.select(F.col("id").alias("end")), "end", "left_semi").select("id").distinct()
    return edges.join(hit, "id", "left_semi")


def remove_nodes(tables: GraphTables, ids: DataFrame) -> GraphTables:
    """Without the nodes, their edges and their places."""
    gone = touching(tables.edges, ids).select("id")
    return GraphTables(tables.nodes.join(ids, "id", "left_anti"), tables.edges.join(gone, "id", "left_anti"), tables.layout.join(ids, "id", "left_anti"))


def cascade(edges: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """The edges that go with nodes (id) without being named (id) themselves."""
    return touching(edges, nodes).join(named, "id", "left_anti")


def delete_plan(edges: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """(op, id): the nodes, then those named edges that no node takes along."""
    rest = named.join(touching(edges, nodes).select("id"), "id", "left_anti")
    return nodes.select(F.lit("removeNode").alias("op"), "id").unionByName(rest.select(F.lit("removeEdge").alias("op"), "id"))


def patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """rows (id, fields) with patches (id, patch) laid over: a null value takes the field away."""
    merged = F.map_filter(F.map_concat(F.map_filter("fields", lambda k, _: ~F.array_contains(F.map_keys("patch"), k)), F.col("patch")), lambda _, v: v.isNotNull())
    met = rows.join(patches, "id", "left")
    return met.withColumn("fields", F.when(F.col("patch").isNotNull(), merged).otherwise(F.col("fields"))).drop("patch")


#: Fields of a composition's nodes that name other nodes: lists of names, and maps by name, as JSON text.
NAME_LISTS, NAME_MAPS = ("exposes", "calls"), ("invocation",)


def renamed(tables: GraphTables, names: DataFrame, references: bool = True) -> GraphTables:
    """names (id, new_id): ids follow, and, if references, so do edge ends, places, and names in other nodes' fields."""
    def swap(df: DataFrame, column: str) -> DataFrame:
        own = names.select(F.col("id").alias(column), F.col("new_id").alias("__new"))
        return df.join(own, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)

    nodes = swap(tables.nodes, "id")
    if not references:
        return replace(tables, nodes=nodes)
    for key in NAME_LISTS + NAME_MAPS if "fields" in nodes.columns else ():
        nodes = _renamed_field(nodes, key, names)
    return GraphTables(nodes, swap(swap(tables.edges, "src"), "dst"), swap(tables.layout, "id"))


def _renamed_field(nodes: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """nodes with the names in one JSON field swapped, in their order."""
    own = names.select(F.col("id").cast("string").alias("name"), F.col("new_id").cast("string").alias("new"))
    has = nodes.where(F.map_contains_key("fields", F.lit(key))).select("id", F.col("fields")[key].alias("json"))
    if key in NAME_MAPS:
        parts = has.select("id", F.posexplode(F.from_json("json", "map<string,string>")).alias("at", "name", "value"))
    else:
        parts = has.select("id", F.posexplode(F.from_json("json", "array<string>")).alias("at", "name"))
    entry = F.struct("at", F.coalesce("new", "name").alias("key"), *(["value"] if key in NAME_MAPS else []))
    joined = parts.join(own, "name", "left").groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("all"), F.bool_or(F.col("new").isNotNull()).alias("hit"))
    text = F.to_json(F.map_from_entries(F.transform("all", lambda x: F.struct(x["key"], x["value"])))) if key in NAME_MAPS else F.to_json(F.transform("all", lambda x: x["key"]))
    met = nodes.join(joined.where("hit").select("id", text.alias("__json")), "id", "left")
    changed = F.map_concat(F.map_filter("fields", lambda k, _: k != key), F.create_map(F.lit(key), F.col("__json")))
    return met.withColumn("fields", F.when(F.col("__json").isNotNull(), changed).otherwise(F.col("fields"))).select(*nodes.columns)


def placed(layout: DataFrame, moves: DataFrame) -> DataFrame:
    """layout with moves (id, x, y) put in or over."""
    return layout.join(moves, "id", "left_anti").unionByName(moves)


def _one(df: DataFrame, node: str) -> bool:
    return not df.where(F.col("id") == node).isEmpty()


def apply_ops(tables: GraphTables, ops: list[dict[str, Any]]) -> tuple[GraphTables, str]:
    """The ops in order, all or none, and their summary.  Ops are a gesture's handful; the tables may be large."""
    said = []
    for op in ops:
        tables, summary = _apply(tables, op)
        said.append(summary)
    return tables, "; ".join(said)


def _fields(spark_df: DataFrame, values: dict[str, Any]) -> Any:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v if isinstance(v, str) else json.dumps(v))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")


def _apply(t: GraphTables, op: dict[str, Any]) -> tuple[GraphTables, str]:
    spark = t.nodes.sparkSession
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    kind = op["op"]
    if kind == "addNode":
        node = dict(op["node"])
        if not isinstance(node.get("id"), str):
            raise Refused("a node needs an id")
        row = spark.range(1).select(F.lit(node.pop("id")).alias("id"), F.lit(node.pop("type", None)).cast("string").alias("type"), _fields(t.nodes, node).alias("fields"))
        return replace(t, nodes=t.nodes.unionByName(row)), f"add node {op['node']['id']}"
    if kind == "addEdge":
        edge = dict(op["edge"])
        row = spark.range(1).select(*[F.lit(edge.pop(k)).alias(k) for k in ("id", "kind", "src", "dst")], _fields(t.edges, edge).alias("fields"))
        return replace(t, edges=t.edges.unionByName(row)), f"add edge {op['edge']['id']}"
    if kind == "setLayout":
        moves = spark.createDataFrame([(k, float(v["x"]), float(v["y"])) for k, v in op["nodes"].items()], "id string, x double, y double")
        return replace(t, layout=placed(t.layout, moves)), f"move {len(op['nodes'])} node(s)"
    side = "edges" if kind.endswith("Edge") else "nodes"
    target = op["id"]
    if not _one(getattr(t, side), target):
        raise Refused(f'there is no {side[:-1]} "{target}"')
    if kind == "removeEdge":
        return replace(t, edges=t.edges.join(one(target), "id", "left_anti")), f"remove edge {target}"
    if kind == "removeNode":
        if not op.get("cascadeEdges", True) and not touching(t.edges, one(target)).isEmpty():
            raise Refused(f'node "{target}" still has edges')
        return remove_nodes(t, one(target)), f"remove node {target}"
    if kind in ("updateNode", "updateEdge"):
        patch = op["patch"]
        if not patch or "id" in patch or (side == "nodes" and "type" in patch):
            raise Refused("an update changes neither id nor type, and changes something")
        pairs = [F.lit(x) for k, v in patch.items() for x in (k, None if v is None else v if isinstance(v, str) else json.dumps(v))]
        rows = one(target).withColumn("patch", F.create_map(*pairs).cast("map<string,string>"))
        before = getattr(t, side)
        after = patched(before, rows)
        same = before.where(F.col("id") == target).select(F.to_json("fields").alias("f")).exceptAll(after.where(F.col("id") == target).select(F.to_json("fields").alias("f"))).isEmpty()
        if same:
            raise Refused("the update has no effect")
        return replace(t, **{side: after}), f"update {side[:-1]} {target}"
    if kind == "renameNode":
        import re

        to = op["to"]
        if not re.match(ID_PATTERN, to):
            raise Refused(f'"{to}" is no id')
        if _one(t.nodes, to):
            raise Refused(f'there is a node "{to}" already')
        return renamed(t, spark.createDataFrame([(target, to)], "id string, new_id string"), op.get("updateReferences", True)), f"rename {target} to {to}"
    raise Refused(f"unknown op {kind}")
