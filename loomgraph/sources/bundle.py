"""A project's tables in one go: manifests, graphs, diagnostics and contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.contracts import discover
from loomgraph.operators import validation
from loomgraph.operators.graphs import closure, contract_targets
from loomgraph.sources.files import agent_table, composition_tables, documents, graph_tables


@dataclass(frozen=True)
class Bundle:
    documents: DataFrame
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    contracts: DataFrame
    services: DataFrame
    routes: DataFrame
    agents: DataFrame


def references(nodes: DataFrame) -> DataFrame:
    """(src, dst): which graph file names which other as a subgraph."""
    return nodes.where("type = 'subgraph' AND ref IS NOT NULL").select(F.col("graph_path").alias("src"), F.col("ref").alias("dst")).distinct()


def reachable(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Graph files (id, depth) that the seeds (id) use, through subgraphs."""
    return closure(seeds, references(nodes))


def load(files: DataFrame) -> Bundle:
    """files (path, content) to the project's tables.  Each graph's rules are checked under its own path."""
    docs = documents(files)
    nodes, edges = graph_tables(docs)
    scoped = lambda df, *cols: df.select(*[F.concat("graph_path", F.lit("#"), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
    own_nodes, own_edges = scoped(nodes, "id"), scoped(edges, "id", "src", "dst")
    rules = validation.validate_graph(own_nodes, own_edges, files)
    more = [validation.invalid_manifests(docs), validation.schemas(own_nodes, files), validation.containment_cycles(references(nodes))]
    services, routes = composition_tables(docs)
    in_file = lambda df, *cols: df.select(*[F.concat("file", F.lit("#"), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
    named = in_file(services, "id")
    for column in ("exposes", "calls"):
        named = named.withColumn(column, F.transform(column, lambda x: F.concat(F.col("file"), F.lit("#"), x)))
    named = named.withColumn("invocation", F.transform_keys("invocation", lambda k, _: F.concat(F.col("file"), F.lit("#"), k)))
    more.append(validation.validate_composition(named, in_file(routes, "id", "src", "dst"), files))
    for part in more:
        rules = rules.unionByName(part)
    steps = nodes.where("type = 'code' AND entrypoint IS NOT NULL").select(F.concat("graph_path", F.lit("#"), "id").alias("id"), F.col("entrypoint").alias("path"))
    read = discover(files.join(steps.select("path").distinct(), "path", "left_semi"))
    contracts = steps.join(read, "path").join(contract_targets(own_nodes.select("id"), own_edges), "id", "left")
    return Bundle(docs, nodes, edges, validation.located(rules), contracts, services, routes, agent_table(docs))
