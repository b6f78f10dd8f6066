"""Integrity of graph tables as joins: each rule gives rows (code, severity, node_id, edge_id, message)."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shapes import MANIFESTS, issue
from loomgraph.functions.text import is_id, is_relative_path
from loomgraph.operators.context import glob_matches
from loomgraph.operators.graphs import bounded_tasks, closure, cycles, with_ends
from loomgraph.sources.shared import stored

COLUMNS = ("code", "severity", "node_id", "edge_id", "message")


def _found(rows: DataFrame, code: str | Column, message: Column, node: Column | None = None, edge: Column | None = None, severity: str = "error") -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), (node if node is not None else none).cast("string").alias("node_id"), (edge if edge is not None else none).cast("string").alias("edge_id"), message.alias("message"))


def duplicates(rows: DataFrame, *key: str, order: list[str]) -> DataFrame:
    """Every occurrence of a key after the first, with first_ord, the first one's place."""
    by = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(by).cast("bigint")).withColumn("first_ord", F.first(F.struct(*order)).over(by)).where("nth > 1")


def duplicate_ids(rows: DataFrame, what: str) -> DataFrame:
    again = duplicates(rows, "id", order=["ord"])
    message = F.format_string(f'{what} id %s is taken by number %d', F.col("id"), F.col("first_ord.ord"))
    return _found(again, "duplicate-id", message, **{what: F.col("id")})


def unknown_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each end of an edge that is no node."""
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("src").alias("end")), F.struct(F.lit("to").alias("side"), F.col("dst").alias("end")))).alias("e")).select("id", "e.side", "e.end")
    return ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti")


def unknown_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _found(unknown_ends(edges, nodes), "unknown-node", F.format_string('edge %s ends at %s, no node', "id", "end"), edge=F.col("id"))


def composition_typing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with codes, the array of rules that their kinds and ends break."""
    a, b, kind = F.col("from_type"), F.col("to_type"), F.col("kind")
    legal = ((a == "client") & (b == "boundary")) | ((a == "boundary") & (b == "service"))
    routes = F.when(b == "process", F.array(F.lit("edge-kind-bad-target"))).when(~legal, F.array(F.lit("edge-kind-bad-source")))
    depends = F.filter(F.array(F.when(a.isin("client", "boundary"), "edge-kind-bad-source"), F.when(b != "service", "edge-kind-bad-target")), lambda x: x.isNotNull())
    known = a.isNotNull() & b.isNotNull()
    codes = F.when(known & (b == "client"), F.array(F.lit("client-is-edge-target"))).when(known & (kind == "routes-to"), routes).when(known, depends)
    return with_ends(edges, nodes).withColumn("codes", codes)


def graph_typing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for a graph's edges; nodes have direction."""
    a, b, kind = F.col("from_type"), F.col("to_type"), F.col("kind")
    grants = F.array(F.when(a != "agent", "capability-edge-bad-source"), F.when(b != "code", "capability-edge-bad-target"))
    flows = F.array(F.when((a == "io") & (F.col("from_direction") == "out"), "io-direction-violation"), F.when((b == "io") & (F.col("to_direction") == "in"), "io-direction-violation"))
    codes = F.filter(F.when(kind == "capability", grants).otherwise(flows), lambda x: x.isNotNull())
    return with_ends(edges, nodes, "direction").withColumn("codes", F.when(a.isNotNull() & b.isNotNull(), codes))


def typing(typed: DataFrame) -> DataFrame:
    bad = typed.withColumn("code", F.explode("codes"))
    return _found(bad, F.col("code"), F.format_string('%s edge %s: %s %s to %s %s', "kind", "id", "from_type", "src", "to_type", "dst"), edge=F.col("id"))


def non_services(nodes: DataFrame, column: str, code: str, verb: str) -> DataFrame:
    """Names in a node's list column that are no services; the message tells a wrong type from a missing node."""
    asked = nodes.select("id", F.col("type").alias("own"), F.explode(column).alias("target"))
    met = asked.join(nodes.select(F.col("id").alias("target"), F.col("type").alias("kind")), "target", "left").where("kind IS NULL OR kind <> 'service'")
    why = F.when(F.col("kind").isNull(), "no node").otherwise(F.format_string("a %s", "kind"))
    return _found(met, code, F.format_string(f"%s %s {verb} %s: %s", F.col("own"), F.col("id"), F.col("target"), why), node=F.col("id"))


def unexposed_invocations(nodes: DataFrame) -> DataFrame:
    asked = nodes.where("invocation IS NOT NULL").select("id", "exposes", F.explode(F.map_keys("invocation")).alias("target")).where(~F.array_contains(F.coalesce("exposes", F.array().cast("array<string>")), F.col("target")))
    return _found(asked, "exposes-non-service", F.format_string('%s invokes %s without exposing it', "id", "target"), node=F.col("id"))


def missing_files(nodes: DataFrame, files: DataFrame, column: str, code: str) -> DataFrame:
    """Nodes whose path column names no file of files (path)."""
    asked = nodes.where(F.col(column).isNotNull()).withColumn("path", F.col(column))
    return _found(asked.join(files.select("path"), "path", "left_anti"), code, F.format_string('%s %s: no file %s', "type", "id", "path"), node=F.col("id"))


def empty_includes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Include globs that match no file."""
    asked = nodes.select("id", F.explode("include").alias("pattern"))
    met = glob_matches(files, asked).select("pattern").distinct()
    return _found(asked.join(met, "pattern", "left_anti"), "unresolved-ref", F.format_string('%s includes %s: no such files', "id", "pattern"), node=F.col("id"))


def flow_without_entrypoint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Code nodes on a flow edge that declare no entrypoint."""
    on_flow = edges.where("kind = 'flow'").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.where("type = 'code' AND entrypoint IS NULL").join(on_flow, "id", "left_semi")


def need_entrypoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(flow_without_entrypoint(nodes, edges), "flow-code-node-needs-entrypoint", F.format_string('%s is in the flow without an entrypoint', "id"), node=F.col("id"))


def flow_cycles(edges: DataFrame) -> DataFrame:
    """One row a cycle: its path, at its smallest node."""
    rows = cycles(edges.where("kind = 'flow'"))
    return _found(rows, "flow-cycle", F.array_join(F.col("path").cast("array<string>"), " > "), node=F.get("path", F.lit(0)), severity="run-blocking")


def containment_cycles(references: DataFrame) -> DataFrame:
    """references (src, dst) from a graph to its subgraphs."""
    return _found(cycles(references), "subgraph-cycle", F.array_join(F.col("path").cast("array<string>"), " > "), node=F.get("path", F.lit(0)))


def located(diagnostics: DataFrame) -> DataFrame:
    """diagnostics with file, of ids (or, without ids, messages) that are scoped as file#id; the ids are then plain."""
    scope = F.coalesce("node_id", "edge_id", "message")
    plain = lambda c: F.when(F.col(c).contains("#"), F.substring_index(c, "#", -1)).otherwise(F.col(c))
    file = F.when(scope.contains("#"), F.substring_index(scope, "#", 1)).when(F.col("code") == "subgraph-cycle", F.col("node_id"))
    return diagnostics.select(file.alias("file"), "code", "severity", plain("node_id").alias("node_id"), plain("edge_id").alias("edge_id"), "message")


def of_node(diagnostics: DataFrame, file: str, node: str) -> DataFrame:
    """The located diagnostics of one node of one file."""
    return diagnostics.where((F.col("file") == file) & (F.col("node_id") == node))


NODE_FIELDS = {"io": (), "code": (), "agent": ("ref",), "subgraph": ("ref",)}
EDGE_KINDS = ("flow", "capability")


def _broken(rows: DataFrame, where: str, tests: dict[str, Column]) -> DataFrame:
    """Rows that break a shape test, with the pointer to the field."""
    issues = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(field)) for field, ok in tests.items()]), lambda x: x.isNotNull())
    bad = rows.select("graph_path", "ord", "id", F.explode(issues).alias("field"))
    return _found(bad, "invalid-manifest", F.format_string(f"%s#/spec/{where}/%d/%s", "graph_path", "ord", "field"), **{where[:-1]: F.col("id")})


def malformed(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Manifests that do not parse, and nodes and edges of the wrong shape; the message is file and JSON pointer."""
    unread = _found(documents.where("document is null"), "invalid-manifest", F.concat("path", F.lit("#")))
    kind = F.col("type")
    relative = lambda c: F.col(c).isNull() | is_relative_path(F.col(c))
    node_tests = {
        "id": is_id(F.col("id")), "type": kind.isin(*NODE_FIELDS), "direction": (kind != "io") | F.coalesce(F.col("direction").isin("in", "out"), F.lit(False)),
        "ref": ~kind.isin("agent", "subgraph") | F.coalesce(is_relative_path(F.col("ref")), F.lit(False)), "entrypoint": relative("entrypoint"), "schema": relative("schema"),
    }
    edge_tests = {"id": is_id(F.col("id")), "kind": F.col("kind").isin(*EDGE_KINDS), "from/node": is_id(F.col("src")), "to/node": is_id(F.col("dst"))}
    return _all([unread, _broken(nodes, "nodes", node_tests), _broken(edges, "edges", edge_tests)])


UNREAD = "does not parse"


def manifest_issues(documents: DataFrame) -> DataFrame:
    """(file, pointer, message, node_id, edge_id) of documents (path, document as JSON) that are no composition, graph
    or agent by their shape; a null document does not parse.  The ids are those of the node or edge with the issue."""
    parsed = documents.select(F.col("path").alias("file"), F.try_parse_json("document").alias("v"))
    found = F.when(F.col("v").isNull(), issue(F.lit(""), UNREAD)).otherwise(MANIFESTS.issues(F.col("v"), F.lit("")))
    part = lambda name: F.try_variant_get("v", f"$.spec.{name}", "array<variant>")
    rows = parsed.select("file", part("nodes").alias("nodes"), part("edges").alias("edges"), F.explode(found).alias("issue"))
    nth = lambda name: F.regexp_extract("issue.pointer", f"^/spec/{name}/(\\d+)(/|$)", 1)
    own = lambda name: F.when(nth(name) != "", F.try_variant_get(F.get(name, F.when(nth(name) != "", nth(name)).cast("int")), "$.id", "string"))
    return rows.select("file", "issue.pointer", "issue.message", own("nodes").alias("node_id"), own("edges").alias("edge_id"))


def invalid_manifests(documents: DataFrame) -> DataFrame:
    """The same as rows of a rule, one for each issue; the message is file, pointer and what is wrong, or the file alone if it does not parse."""
    message = F.when(F.col("message") == UNREAD, F.concat("file", F.lit("#"))).otherwise(F.format_string("%s#%s %s", "file", "pointer", "message"))
    return _found(manifest_issues(documents), "invalid-manifest", message, node=F.concat("file", F.lit("#"), "node_id"), edge=F.concat("file", F.lit("#"), "edge_id"))


# The simple types of JSON Schema, and keywords by the shape of their values.
JSON_TYPES = {"null", "boolean", "object", "array", "number", "integer", "string"}
SCHEMA_OF, SCHEMAS_OF, LISTS_OF = ("items", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else"), ("properties", "patternProperties", "$defs", "dependentSchemas"), ("allOf", "anyOf", "oneOf", "prefixItems")
COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")


class SchemaDocument:
    """A JSON Schema document: its own problem, and the references that lead to other documents.

    References inside the document are followed, each place once, so that schemas that refer to themselves
    or to one another end; a reference that leads nowhere is a problem.
    """

    def __init__(self, root: object) -> None:
        self.root = root
        self.outer: list[str] = []
        self.anchors: dict[str, object] = {}
        self._note(root)
        self._judged: set[int] = set()
        self.problem = self._judge(root, "")

    def _note(self, value: object) -> None:
        waiting = [value]
        while waiting:
            now = waiting.pop()
            if isinstance(now, dict):
                for key in ("$anchor", "$dynamicAnchor"):
                    if isinstance(now.get(key), str):
                        self.anchors[now[key]] = now
                waiting += now.values()
            elif isinstance(now, list):
                waiting += now

    def at(self, fragment: str) -> tuple[bool, object]:
        """Whether a reference's fragment, without its #, leads to something, and to what."""
        if fragment and not fragment.startswith("/"):
            return fragment in self.anchors, self.anchors.get(fragment)
        now = self.root
        for part in fragment.split("/")[1:]:
            key = unquote(part).replace("~1", "/").replace("~0", "~")
            if isinstance(now, dict) and key in now:
                now = now[key]
            elif isinstance(now, list) and key.isdigit() and int(key) < len(now):
                now = now[int(key)]
            else:
                return False, None
        return True, now

    def _judge(self, schema: object, at: str) -> str | None:
        waiting = [(schema, at)]
        while waiting:
            schema, at = waiting.pop()
            if isinstance(schema, bool) or id(schema) in self._judged:
                continue
            if not isinstance(schema, dict):
                return f"{at or '/'} must be an object or a boolean"
            self._judged.add(id(schema))
            wrong = _wrong_keyword(schema)
            if wrong:
                return f"{at}/{wrong}"
            for key in ("$ref", "$dynamicRef"):
                ref = schema.get(key)
                if ref is not None:
                    if not isinstance(ref, str):
                        return f"{at}/{key} has the wrong shape"
                    if not ref.startswith("#"):
                        self.outer.append(ref)
                        continue
                    there, target = self.at(ref[1:])
                    if not there:
                        return f"{at}/{key} {ref} leads nowhere"
                    waiting.append((target, ref[1:]))
            inner = [(k, schema[k]) for k in SCHEMA_OF if k in schema] + [(f"{k}/{n}", v) for k in SCHEMAS_OF for n, v in schema.get(k, {}).items()] + [(f"{k}/{n}", v) for k in LISTS_OF for n, v in enumerate(schema.get(k, []))]
            waiting += [(v, f"{at}/{k}") for k, v in reversed(inner)]
        return None


def _wrong_keyword(schema: dict) -> str | None:
    kinds = schema.get("type", [])
    if not (isinstance(kinds, (str, list)) and set(kinds if isinstance(kinds, list) else [kinds]) <= JSON_TYPES):
        return "type is not a type"
    wrong = [k for k in COUNTS if k in schema and not (isinstance(schema[k], int) and schema[k] >= 0)]
    wrong += [k for k in ("required",) if k in schema and not (isinstance(schema[k], list) and all(isinstance(x, str) for x in schema[k]) and len(set(schema[k])) == len(schema[k]))]
    wrong += [k for k in ("enum",) if k in schema and not isinstance(schema[k], list)]
    wrong += [k for k in SCHEMAS_OF if not isinstance(schema.get(k, {}), dict)] + [k for k in LISTS_OF if k in schema and not (isinstance(schema[k], list) and schema[k])]
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError):
            wrong.append("pattern")
    return f"{wrong[0]} has the wrong shape" if wrong else None


def schema_problem(schema: object) -> str | None:
    """What keeps a value from being a JSON Schema, or None."""
    return SchemaDocument(schema).problem


def _read_schemas(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files to their problem and the references to other files, as (target, fragment)."""
    for part in parts:
        problems, refs = [], []
        for path, text in zip(part["path"], part["content"], strict=True):
            try:
                document = SchemaDocument(json.loads(text))
                problems.append(document.problem)
                refs.append([{"ref": r, "target": posixpath.normpath(posixpath.join(posixpath.dirname(path), r.split("#")[0])), "fragment": r.partition("#")[2]} for r in dict.fromkeys(document.outer) if "://" not in r])
            except (ValueError, RecursionError):
                problems.append("is not valid JSON")
                refs.append([])
        yield pd.DataFrame({"path": part["path"], "problem": pd.Series(problems, dtype=object), "refs": refs})


def _leads_nowhere(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """References with their target's text to those whose fragment is not there."""
    for part in parts:
        lost = []
        for text, fragment in zip(part["content"], part["fragment"], strict=True):
            try:
                lost.append(not SchemaDocument(json.loads(text)).at(fragment)[0])
            except (ValueError, RecursionError):
                lost.append(False)  # the target's own problem
        yield part.loc[lost, ["path", "ref"]]


def schemas(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """io nodes whose schema file is missing, is no JSON, or is no JSON Schema, itself or in a file that it refers to.

    Each file is read once.  References between files may run in circles; those to other hosts are not followed.
    """
    asked = nodes.where("type = 'io' AND schema IS NOT NULL").withColumn("path", F.col("schema"))
    missing = missing_files(asked, files, "schema", "unresolved-schema")
    wanted = files.where("content is not null").join(asked.select("path").distinct().withColumn("own", F.lit(True)), "path", "left").where(F.col("own") | F.col("path").endswith(".json"))
    read = stored(wanted.select("path", "content").mapInPandas(_read_schemas, "path string, problem string, refs array<struct<ref: string, target: string, fragment: string>>"))
    refs = read.select("path", F.inline("refs"))
    said = read.where("problem is not null").select("path", "problem")
    if not refs.isEmpty():
        absent = refs.join(files.select(F.col("path").alias("target")), "target", "left_anti").select("path", F.format_string("$ref %s: no such file", "ref").alias("problem"))
        met = refs.where("fragment <> ''").join(files.select(F.col("path").alias("target"), "content"), "target").select("path", "ref", "fragment", "content")
        lost = met.mapInPandas(_leads_nowhere, "path string, ref string").select("path", F.format_string("$ref %s leads nowhere", "ref").alias("problem"))
        said = said.unionByName(absent).unionByName(lost).groupBy("path").agg(F.min("problem").alias("problem"))
        back = closure(said.select(F.col("path").alias("id")), refs.select(F.col("target").alias("src"), F.col("path").alias("dst")))
        said = said.unionByName(back.where("depth > 0").select(F.col("id").alias("path"), F.lit("refers to a schema that is wrong").alias("problem")))
    return missing.unionByName(_found(asked.join(said, "path"), "invalid-json-schema", F.format_string('%s: %s', "path", "problem"), node=F.col("id")))


def _all(parts: list[DataFrame]) -> DataFrame:
    bounded_tasks(parts[0].sparkSession)
    return reduce(DataFrame.unionByName, parts)


def validate_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """All rules on a graph's tables: nodes (ord, id, type, direction, ref, entrypoint, include), edges (ord, id, kind, src, dst)."""
    refs = nodes.where("type IN ('agent', 'subgraph')")
    return _all([
        duplicate_ids(nodes, "node"), duplicate_ids(edges, "edge"), unknown_nodes(edges, nodes), typing(graph_typing(edges, nodes)),
        missing_files(refs, files, "ref", "unresolved-ref"), missing_files(nodes.where("type = 'code'"), files, "entrypoint", "unresolved-entrypoint"),
        empty_includes(nodes.where("type = 'code'"), files), need_entrypoints(nodes, edges), flow_cycles(edges),
    ])


def validate_composition(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """All rules on a composition's tables: nodes (ord, id, type, path, exposes, invocation, calls, graph, entrypoint)."""
    services = nodes.where("type = 'service'")
    return _all([
        duplicate_ids(nodes, "node"), duplicate_ids(edges, "edge"), unknown_nodes(edges, nodes), typing(composition_typing(edges, nodes)),
        non_services(nodes.where("type = 'boundary'").unionByName(nodes.where("type <> 'boundary'").withColumn("exposes", F.lit(None).cast("array<string>"))), "exposes", "exposes-non-service", "exposes"),
        non_services(nodes, "calls", "calls-non-service", "calls"), unexposed_invocations(nodes),
        missing_files(services, files, "graph", "unresolved-ref"), missing_files(services, files, "entrypoint", "unresolved-entrypoint"),
    ])


def severity_counts(diagnostics: DataFrame, *by: str) -> DataFrame:
    return diagnostics.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "run-blocking").alias("run_blocking"))


def blocks_run(diagnostics: DataFrame) -> DataFrame:
    """One row: fatal if any error, blocked if anything at all."""
    return diagnostics.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("fatal"), (F.count(F.lit(1)) > 0).alias("blocked"))


def may_run(diagnostics: DataFrame, composition: bool) -> DataFrame:
    """One row: a graph runs if nothing stands against it; a composition runs if no error does."""
    against = diagnostics.where("severity = 'error'") if composition else diagnostics.where("severity IN ('error', 'run-blocking')")
    return against.agg((F.count(F.lit(1)) == 0).alias("may_run"))
