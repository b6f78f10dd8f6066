"""Project files as tables (path, content), snapshots pinned to a commit, and the sinks that write them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import is_relative_path

#: Directories that a listing passes over; a project's own are given beside them.
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "dist")
TEXT_KINDS = r"\.(ya?ml|json|md)$"
FILES = "path string, content string"


def _under(root: str) -> Column:
    """The path below root, of Spark's own file column."""
    return F.regexp_replace(F.col("path"), r"^.*?\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + r"\E/", "")


def directory(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, size, content binary) of the files under root, without ignored directories.  Content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    names = "|".join(re.escape(x) for x in ignored) or "(?!)"
    own = files.select(_under(root).alias("path"), F.col("length").alias("size"), "content")
    return own.where(~F.col("path").rlike(rf"(^|/)({names})/"))


def one_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(path, size, content binary) of one file; no row for a path that leaves the root, or is no file."""
    inside = bool(path) and not path.startswith("/") and ".." not in path.split("/")
    return directory(spark, root, ignored=()).where((F.col("path") == path) & F.lit(inside))


def texts(files: DataFrame) -> DataFrame:
    """(path, content) of files whose bytes are UTF-8."""
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("content is not null")


def in_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), FILES)


def documents(files: DataFrame) -> DataFrame:
    """(path, document) of YAML files as JSON text; a file that does not parse has a null document."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        def one(text: str) -> str | None:
            try:
                return json.dumps(yaml.safe_load(text), default=str)
            except (yaml.YAMLError, TypeError):
                return None

        for part in parts:
            yield pd.DataFrame({"path": part["path"], "document": part["content"].map(one)})

    return files.where(F.col("path").rlike(r"\.ya?ml$")).mapInPandas(parse, "path string, document string")


#: The shape of a graph document.
GRAPH = "kind string, spec struct<nodes: array<struct<id: string, type: string, direction: string, schema: string, ref: string, entrypoint: string, include: array<string>>>, edges: array<struct<id: string, kind: string, from: struct<node: string>, to: struct<node: string, function: string>>>>"


def graph_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph documents (path, document) to nodes (graph_path, ord, id, type, ...) and edges (graph_path, ord, id, kind, src, dst, function)."""
    parsed = docs.select("path", F.from_json("document", GRAPH).alias("g")).where("g.kind = 'Graph'")
    nodes = parsed.select(F.col("path").alias("graph_path"), F.posexplode("g.spec.nodes").alias("ord", "n")).select("graph_path", "ord", "n.*")
    edges = parsed.select(F.col("path").alias("graph_path"), F.posexplode("g.spec.edges").alias("ord", "e"))
    return nodes, edges.select("graph_path", "ord", "e.id", "e.kind", F.col("e.from.node").alias("src"), F.col("e.to.node").alias("dst"), F.col("e.to.function").alias("function"))


def graph_errors(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, error) of the asked paths that are no graph: no such file, not YAML, or of another kind."""
    met = asked.select("path").join(docs.withColumn("there", F.lit(True)), "path", "left")
    kind = F.get_json_object("document", "$.kind")
    error = F.when(F.col("there").isNull(), "no such file").when(F.col("document").isNull(), "not YAML").when(~F.coalesce(kind == "Graph", F.lit(False)), "no graph")
    return met.select("path", error.alias("error")).where("error is not null")


#: The shapes of composition and agent documents.
COMPOSITION = "kind string, spec struct<nodes: array<struct<id: string, type: string, boundary: string, client: string, path: string, dev: string, exposes: array<string>, invocation: map<string, string>, calls: array<string>, impl: struct<graph: string, entrypoint: string>>>, edges: array<struct<id: string, kind: string, from: struct<node: string>, to: struct<node: string>>>>"
AGENT = "kind string, metadata struct<id: string, name: string>, spec struct<model: string, promptFile: string, maxTurns: int>"


def composition_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Composition documents (path, document) to nodes (file, ord, id, type, ..., graph, entrypoint) and edges (file, ord, id, kind, src, dst)."""
    parsed = docs.select("path", F.from_json("document", COMPOSITION).alias("c")).where("c.kind = 'Composition'")
    nodes = parsed.select(F.col("path").alias("file"), F.posexplode("c.spec.nodes").alias("ord", "n"))
    fields = ("id", "type", "boundary", "client", "path", "dev", "exposes", "invocation", "calls")
    edges = parsed.select(F.col("path").alias("file"), F.posexplode("c.spec.edges").alias("ord", "e"))
    return (
        nodes.select("file", "ord", *[f"n.{f}" for f in fields], F.col("n.impl.graph").alias("graph"), F.col("n.impl.entrypoint").alias("entrypoint")),
        edges.select("file", "ord", "e.id", "e.kind", F.col("e.from.node").alias("src"), F.col("e.to.node").alias("dst")),
    )


def agent_table(docs: DataFrame) -> DataFrame:
    """Agent documents to (path, id, name, model, prompt_file, max_turns)."""
    parsed = docs.select("path", F.from_json("document", AGENT).alias("a")).where("a.kind = 'Agent'")
    return parsed.select("path", "a.metadata.id", "a.metadata.name", "a.spec.model", F.col("a.spec.promptFile").alias("prompt_file"), F.col("a.spec.maxTurns").alias("max_turns"))


def snapshot(blobs: DataFrame, tree: DataFrame, commit: str, most_bytes: int = 2 << 20) -> DataFrame:
    """(path, content) at a commit: tree (commit_sha, path, blob_sha, size) is narrow, and only text files' blobs
    (blob_sha, content) within the size are fetched; others have null content until hydrated."""
    own = tree.where(F.col("commit_sha") == commit)
    wanted = own.where(F.col("path").rlike(TEXT_KINDS) & (F.col("size") <= most_bytes)).select("path", "blob_sha")
    fetched = wanted.join(blobs, "blob_sha").select("path", "content")
    return own.select("path").join(fetched, "path", "left")


def hydrate(files: DataFrame, tree: DataFrame, blobs: DataFrame, commit: str, paths: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """files with the content of further paths fetched."""
    own = tree.where((F.col("commit_sha") == commit) & (F.col("size") <= most_bytes)).join(paths, "path", "left_semi")
    more = own.join(blobs, "blob_sha").select("path", F.col("content").alias("fetched"))
    return files.join(more, "path", "left").select("path", F.coalesce("content", "fetched").alias("content"))


def commit(tree: DataFrame, merged: DataFrame, parent: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The next snapshot's (tree, blobs) of merged files (path, content): unchanged blobs keep their hashes and are not written again."""
    blob = F.sha1(F.concat(F.lit("blob "), F.octet_length("content").cast("string"), F.lit("\0"), F.col("content")))
    named = merged.select("path", blob.alias("blob_sha"), F.octet_length("content").cast("bigint").alias("size"), "content")
    known = tree.where(F.col("commit_sha") == parent).select("blob_sha").distinct()
    fresh = named.join(known, "blob_sha", "left_anti").groupBy("blob_sha").agg(F.first("content").alias("content"))
    return named.select(F.lit(new).alias("commit_sha"), "path", "blob_sha", "size"), fresh


def move_heads(refs: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, outcome): refs (branch, head) after moves (branch, expected, new), each made only where the head is
    still the expected one; outcome (branch, moved, head) tells a loser the head to start again from, once."""
    met = refs.join(moves, "branch", "left")
    fits = F.col("new").isNotNull() & F.col("head").eqNullSafe(F.col("expected"))
    after = met.select("branch", F.when(fits, F.col("new")).otherwise(F.col("head")).alias("head"))
    return after, met.where("new is not null").select("branch", fits.alias("moved"), F.when(fits, F.col("new")).otherwise(F.col("head")).alias("head"))


def append_absent(existing: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Template files whose paths are free: a scaffold never overwrites."""
    return in_memory(existing.sparkSession, templates).join(existing.select("path"), "path", "left_anti")


def refused_paths(files: DataFrame) -> DataFrame:
    """Paths that leave the project."""
    return files.where(~is_relative_path(F.col("path"))).select("path")


def write_through(workspace: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspace, refused): the workspace (path, content, version) with files (path, content) put in or over, each
    change a version up; paths that leave the project are refused, and then nothing is written."""
    refused = refused_paths(files)
    if not refused.isEmpty():
        return workspace, refused
    old, new = workspace.alias("o"), files.alias("n")
    met = old.join(new, "path", "full")
    changed = F.col("n.content").isNotNull() & ~F.col("n.content").eqNullSafe(F.col("o.content"))
    version = F.coalesce("o.version", F.lit(0)) + changed.cast("int")
    return met.select("path", F.coalesce("n.content", "o.content").alias("content"), version.alias("version")), refused


def write_events(events: DataFrame, path: str, **options: Any) -> None:
    """Appends events to the log's table."""
    events.write.mode("append").options(**options).parquet(path)
