"""Further queries: cycles with their paths, selection of code, cancellation, ports and layout, changes of projects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.catalogue import _cases, _FILES, _KINDS, _LOG, _PLACES, _RING, _sources, base_files, log, pending, places, query, ring, table
from loomgraph.functions import agents, contracts, text
from loomgraph.operators import context, emissions, graphs, mutations, overlay, projects, runlog, splices, validation
from loomgraph.sources import files
from loomgraph.sources.shared import shared_dir
from loomgraph.streaming import reports, source, state
from loomgraph.streaming import runlog as live


@query(f"WITH {_PLACES} SELECT string_agg(n_nationkey::VARCHAR, '>' ORDER BY n_nationkey) || '>' || min(n_nationkey) AS path FROM places WHERE n_regionkey <> 2 GROUP BY n_ring")
def g10_cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cycles(ring(spark, sf_dir)).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("""SELECT 10000 + (o_orderkey // 4) * 4 AS graph, (10000 + (o_orderkey // 4) * 4) || ' > ' || (10001 + (o_orderkey // 4) * 4) || ' > ' || (10002 + (o_orderkey // 4) * 4) || ' > ' || (10003 + (o_orderkey // 4) * 4) || ' > ' || (10000 + (o_orderkey // 4) * 4) AS message
FROM orders GROUP BY o_orderkey // 4 HAVING count(*) = 4""")
def g11_containment_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between graphs: four orders in a row refer to one another in a ring, parts to suppliers upwards only."""
    part, supplier = F.col("l_partkey") * 7 % 997, F.col("l_suppkey") * 11 % 997
    upwards = table(spark, sf_dir, "lineitem").where("l_orderkey % 97 = 0").select(part.alias("src"), supplier.alias("dst")).where("src < dst").distinct()
    key = F.col("o_orderkey") + 10000
    rings = table(spark, sf_dir, "orders").select(key.alias("src"), (key + 1 - F.when(F.col("o_orderkey") % 4 == 3, 4).otherwise(0)).alias("dst"))
    return validation.containment_cycles(upwards.unionByName(rings)).select(F.col("node_id").cast("bigint").alias("graph"), "message")


def rule_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rings as flow graphs; a customer's orders are all of one type."""
    none = F.lit(None).cast("string")
    region = F.col("n_regionkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("io", "agent", "code", "subgraph", "io")]), region + 1)
    nodes = places(spark, sf_dir).select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("bigint").alias("id"), kind.alias("type"), F.when(region == 0, "in").when(region == 4, "out").alias("direction"), F.when(region == 1, F.lit("agents/bot.yaml")).alias("ref"), none.alias("entrypoint"), F.lit(None).cast("array<string>").alias("include"))
    edges = ring(spark, sf_dir).select(F.col("src").alias("ord"), F.col("src").alias("id"), F.lit("flow").alias("kind"), "src", "dst")
    return nodes, edges


@query(f"""WITH {_RING} SELECT 'io-direction-violation' AS code, 'error' AS severity, count(*)::BIGINT AS n FROM ring WHERE n_regionkey IN (0, 4) AND dst IS NOT NULL
UNION ALL SELECT 'flow-code-node-needs-entrypoint', 'error', count(*) FROM (SELECT count(*) OVER (PARTITION BY n_ring) AS m FROM places WHERE n_regionkey = 2) WHERE m > 1 UNION ALL SELECT 'unresolved-ref', 'error', count(*) FROM places WHERE n_regionkey = 1
UNION ALL SELECT 'flow-cycle', 'run-blocking', count(DISTINCT n_ring) FROM places WHERE n_regionkey <> 2""")
def g17_graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = rule_tables(spark, sf_dir)
    found = validation.validate_graph(nodes, edges, spark.createDataFrame([("other.yaml",)], "path string"))
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT c_custkey AS k FROM customer), found AS (
SELECT 'exposes-non-service' AS code FROM k WHERE k % 4 = 1 AND NOT (k % 8 = 1 AND k + 1 IN (SELECT k FROM k))
UNION ALL SELECT 'calls-non-service' FROM k WHERE k % 4 = 3 AND NOT (k % 8 = 3 AND k - 1 IN (SELECT k FROM k))
UNION ALL SELECT 'unresolved-ref' FROM k WHERE k % 4 = 2 AND k % 3 = 2
UNION ALL SELECT 'unknown-node' FROM k WHERE k % 4 = 0 AND k + 1 NOT IN (SELECT k FROM k) UNION ALL SELECT 'unknown-node' FROM k WHERE k % 8 = 0 AND k + 2 NOT IN (SELECT k FROM k)
UNION ALL SELECT 'edge-kind-bad-source' FROM k WHERE k % 8 = 0 AND k + 2 IN (SELECT k FROM k)
UNION ALL SELECT 'duplicate-id' FROM k WHERE k % 40 = 6)
SELECT code, count(*)::BIGINT AS n FROM found GROUP BY code""")
def g17_composition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clients, boundaries, services and processes in turn; some expose, call, name or meet what they must not."""
    key = F.col("c_custkey")
    named = lambda k: F.format_string("c%d", k)
    rest = key % 4
    customers = table(spark, sf_dir, "customer")
    nodes = customers.select(
        key.alias("ord"), named(key).alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("client", "boundary", "service", "process")]), (rest + 1).cast("int")).alias("type"),
        F.when(rest == 1, F.array(named(F.when(key % 8 == 1, key + 1).otherwise(key + 2)))).alias("exposes"), F.lit(None).cast("map<string,string>").alias("invocation"),
        F.when(rest == 3, F.array(named(F.when(key % 8 == 3, key - 1).otherwise(key - 2)))).alias("calls"), F.when(rest == 2, F.format_string("g%d.yaml", key % 3)).alias("graph"), F.lit(None).cast("string").alias("entrypoint"),
    )
    again = nodes.where("ord % 40 = 6").withColumn("ord", F.col("ord") + 10_000_000).withColumn("graph", F.lit("g0.yaml"))
    edge = lambda where, id_, to: customers.where(where).select(key.alias("ord"), F.format_string(id_, key).alias("id"), F.lit("routes-to").alias("kind"), named(key).alias("src"), named(to).alias("dst"))
    edges = edge("c_custkey % 4 = 0", "a%d", key + 1).unionByName(edge("c_custkey % 8 = 0", "b%d", key + 2))
    files = spark.createDataFrame([("g0.yaml",), ("g1.yaml",)], "path string")
    found = validation.validate_composition(nodes.unionByName(again), edges, files)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PLACES} SELECT EXISTS (SELECT * FROM places WHERE n_regionkey = 2) AS fatal, count(*) > 0 AS blocked FROM places")
def f14_blocks_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = rule_tables(spark, sf_dir)
    return validation.blocks_run(validation.need_entrypoints(nodes, edges).unionByName(validation.flow_cycles(edges)))


@query(f"WITH {_PLACES} SELECT 'g' || n_regionkey || '.yaml' AS file, n_nationkey::VARCHAR AS node_id, 'unresolved-entrypoint' AS code FROM places WHERE n_nationkey % 2 = 1 AND n_regionkey <> 4")
def f13_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of several graphs by file and node; the last region's are left out."""
    nation = places(spark, sf_dir)
    file = F.format_string("g%d.yaml", "n_regionkey")
    nodes = nation.select(F.concat_ws("#", file, F.col("n_nationkey").cast("string")).alias("id"), F.lit("code").alias("type"), F.format_string("steps/%d.py", "n_nationkey").alias("entrypoint"))
    files = nation.where("n_nationkey % 2 = 0").select(F.format_string("steps/%d.py", "n_nationkey").alias("path"))
    found = validation.located(validation.missing_files(nodes, files, "entrypoint", "unresolved-entrypoint"))
    return found.where("file <> 'g4.yaml'").select("file", "node_id", "code")


@query(f"WITH {_PLACES} SELECT n_nationkey::VARCHAR AS node_id, n_nationkey || ' includes none/*.py: no such files' AS message FROM places WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey::VARCHAR, 'code ' || n_nationkey || ': no file ' || n_name FROM places WHERE n_regionkey > 2")
def j10_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.col("n_regionkey")
    nation = places(spark, sf_dir)
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.lit("code").alias("type"), F.col("n_name").alias("entrypoint"), F.array(F.when(region == 1, F.lit("none/*.py")).otherwise(F.lit("N*_*"))).alias("include"))
    files = nation.where(region <= 2).select(F.col("n_name").alias("path"))
    return validation.missing_files(nodes, files, "entrypoint", "unresolved-entrypoint").unionByName(validation.empty_includes(nodes, files)).select("node_id", "message")


@query(f"WITH {_PLACES} SELECT 'g' || n_regionkey || '#/spec/nodes/' || n_nationkey || '/id' AS message FROM places WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'g' || n_regionkey || '#/spec/edges/' || n_nationkey || '/to/node' FROM places WHERE n_regionkey = 3 UNION ALL SELECT r_name || '#' FROM region WHERE r_regionkey = 1")
def g18_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes of their region's graph: even ones in capitals, which no id has; one region's edges end nowhere."""
    nation = places(spark, sf_dir)
    path, name = F.format_string("g%d", "n_regionkey"), F.lower("n_name")
    none = F.lit(None).cast("string")
    nodes = nation.select(path.alias("graph_path"), F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(name).alias("id"), F.lit("code").alias("type"), *[none.alias(c) for c in ("direction", "ref", "entrypoint", "schema")])
    edges = nation.select(path.alias("graph_path"), F.col("n_nationkey").alias("ord"), name.alias("id"), F.lit("flow").alias("kind"), name.alias("src"), F.when(F.col("n_regionkey") != 3, name).alias("dst"))
    documents = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"), F.when(F.col("r_regionkey") != 1, F.lit("{}")).alias("document"))
    return validation.malformed(documents, nodes, edges).select("message")


@query(f"WITH {_PLACES} SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 0 THEN 'unresolved-schema' ELSE 'invalid-json-schema' END AS code FROM places WHERE n_regionkey IN (0, 2, 3)")
def s13_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's schema file: missing, good, of a wrong shape, no JSON, good."""
    nation = places(spark, sf_dir)
    body = F.element_at(F.array(*[F.lit(x) for x in ("", '{"type": "string"}', '{"required": ["a", "a"]}', "{", "true")]), F.col("n_regionkey") + 1)
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.lit("io").alias("type"), F.concat("n_name", F.lit(".json")).alias("schema"))
    files = nation.where("n_regionkey > 0").select(F.concat("n_name", F.lit(".json")).alias("path"), body.alias("content"))
    return validation.schemas(nodes, files).select(F.col("node_id").cast("bigint").alias("id"), "code")


@query(f"WITH {_PLACES} SELECT n_ring AS graph, row_number() OVER (PARTITION BY n_ring ORDER BY n_nationkey % 2, n_nationkey) - 1 AS place, CASE WHEN n_nationkey < 5 THEN n_nationkey::VARCHAR ELSE n_name END AS name, CASE n_nationkey % 2 WHEN 0 THEN 'in' ELSE 'out' END AS direction FROM places")
def g14_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = places(spark, sf_dir).select(F.col("n_ring").alias("graph_path"), F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") >= 5, F.col("n_name")).alias("name"), F.lit("io").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, "in").otherwise("out").alias("direction"))
    return graphs.ports(nodes).withColumnRenamed("graph_path", "graph")


@query(f"WITH {_PLACES} SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE 60 + 200 * n_nationkey END::DOUBLE AS x, CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE 60 + 120 * (n_nationkey % 3) END::DOUBLE AS y FROM places")
def w06_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = places(spark, sf_dir).select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("ord"))
    layout = nodes.where("id % 3 = 0").select("id", F.col("id").cast("double").alias("x"), F.lit(7.0).alias("y"))
    return graphs.laid_out(nodes, layout).select("id", "x", "y")


@query("SELECT n_nationkey AS id, n_nationkey <> 3 AND n_nationkey <= 20 AS has_contract, n_nationkey IN (3, 21, 22, 23) AS has_error FROM nation")
def j17_node_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes; the contracts of all but the last were read."""
    sources = _sources(spark, sf_dir)
    read = contracts.discover(sources.where("n_nationkey < 24").select(F.col("n_nationkey").alias("id"), "content"), "id").select(F.lit("g").alias("graph_path"), "id", "contract", "error")
    shown = graphs.faces(sources.select(F.lit("g").alias("graph_path"), F.col("n_nationkey").alias("id")), read)
    return shown.select("id", F.col("contract").isNotNull().alias("has_contract"), F.col("error").isNotNull().alias("has_error"))


@query("SELECT 'n-' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'lib/' || n_name ELSE 'src/n_' || n_nationkey END || '/main.py' AS entrypoint FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 24 AND n_nationkey % 10 <> 0")
def m22_new_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as code nodes; one region's have an entrypoint, one nation has no edge, every tenth one's file is there."""
    nation = table(spark, sf_dir, "nation")
    key, name = F.col("n_nationkey"), F.format_string("n-%d", "n_nationkey")
    nodes = nation.select(name.alias("id"), F.lit("code").alias("type"), F.when(key % 2 == 0, F.array(F.concat(F.lit("lib/"), "n_name", F.lit("/**")))).alias("include"), F.when(F.col("n_regionkey") == 1, F.lit("x.py")).alias("entrypoint"))
    edges = nation.where(key != 24).select(F.lit("flow").alias("kind"), name.alias("src"), F.lit("n-0").alias("dst"))
    return graphs.new_entrypoints(edges, nodes, nation.where(key % 10 == 0).select(F.concat(F.lit("lib/"), "n_name", F.lit("/main.py")).alias("path")))


@query("""WITH f AS (SELECT 'steps/' || n_name || '.py' AS path, n_nationkey AS k FROM nation), a AS (SELECT r_regionkey AS agent, r_regionkey || '.py' AS tail FROM region),
m AS (SELECT agent, min(path) AS path FROM a LEFT JOIN f ON path LIKE '%' || tail GROUP BY agent)
SELECT agent, path, CASE WHEN k <> 3 AND k <= 20 THEN 'handle_' || k END AS name, CASE WHEN k <> 3 AND k <= 20 THEN '["value"]' END AS required FROM m LEFT JOIN f USING (path)""")
def e06_agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's agent grants the first file whose name ends in its digit."""
    tools = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("agent"), F.lit(0).alias("ord"), F.format_string("steps/*%d.py", "r_regionkey").alias("entrypoint"), F.lit(None).cast("string").alias("function"))
    found = agents.resolve_tools(tools, _sources(spark, sf_dir).select("path", "content"))
    return found.select("agent", "path", "name", F.get_json_object("schema", "$.required").alias("required"))


# --- files and changes -----------------------------------------------------------------------------------


@query(f"WITH {_PLACES} SELECT n_nationkey AS id, n_regionkey < 3 AS document FROM places")
def f07_document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.array(*[F.lit(x) for x in ("graphs/%s.yaml", "agents/%s/agent.yml", "agents/%s/prompt.md", "graphs/sub/%s.yaml", "agents/%s/more/prompt.md")])
    path = F.replace(F.element_at(shapes, F.col("n_regionkey") + 1), F.lit("%s"), F.col("n_name"))
    return places(spark, sf_dir).select(F.col("n_nationkey").alias("id"), context.is_document(path).alias("document"))


def code_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, odd ones as notes beside code, and what of them was written before."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".md"))
    files = docs.select(path.alias("path"), F.col("text").alias("content"), "doc_id")
    return files, files.where("doc_id % 10 = 0").select("path")


_CODE = "code AS (SELECT 'src/' || lang || '/' || source || '/' || doc_id || '.py' AS path, text, doc_id, lang FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0 AND lang <> 'en')"


@query(f"WITH {_CODE} SELECT path FROM code WHERE lang = 'de' OR doc_id % 7 = 0")
def f08_context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, written = code_tables(spark, sf_dir)
    code = context.code_files(every, written, "src/en")
    return context.referenced(code, every.where("doc_id % 7 = 0").select("path"), spark.createDataFrame([("src/de/",), ("src/d/",)], "path string")).select("path")


@query(f"WITH {_CODE} SELECT path FROM code WHERE octet_length(encode(text)) <= 2000 ORDER BY path LIMIT 60")
def f09_analyzer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, written = code_tables(spark, sf_dir)
    return context.capped(context.code_files(every, written, "src/en"), most_bytes=2000).select("path")


@query(f"WITH {_FILES} SELECT count(*)::BIGINT AS files, count(*) FILTER (kind = 'add')::BIGINT AS added, count(*) FILTER (kind = 'modify')::BIGINT AS modified, count(*) FILTER (kind = 'delete')::BIGINT AS deleted, 0::BIGINT AS renamed FROM pending")
def a07_pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.counts(pending(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, kind FROM pending ORDER BY path LIMIT 20")
def o03_pending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.in_order(pending(spark, sf_dir)).limit(20).select("path", "kind")


@query(f"""WITH {_FILES}, gone AS (SELECT path FROM base WHERE path LIKE 'docs/de/%' UNION ALL SELECT path FROM pending WHERE path LIKE 'bench/1%')
SELECT path, kind FROM pending WHERE path NOT IN (SELECT path FROM gone) UNION ALL SELECT path, 'delete' FROM gone WHERE path NOT LIKE 'bench/%'""")
def m11_pending_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = base_files(spark, sf_dir).where(F.col("path").startswith("docs/de/")).select("path")
    changes = pending(spark, sf_dir)
    return overlay.remove(changes, paths.unionByName(changes.where(F.col("path").startswith("bench/1")).select("path"))).select("path", "kind")


@query(f"WITH {_FILES} SELECT path, kind FROM pending WHERE path NOT LIKE 'docs/e%'")
def m11_pending_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = pending(spark, sf_dir)
    paths = changes.where(F.col("path").startswith("docs/e")).select("path")
    return overlay.status(overlay.revert(changes, paths))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS asked, c_name FROM documents JOIN customer ON c_custkey = doc_id WHERE doc_id % 3 <> 0")
def f03_ids_asked_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as ids of customers; every third is none."""
    asked = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""), F.col("doc_id").cast("string")).alias("asked"))
    return projects.with_id(table(spark, sf_dir, "customer"), "c_custkey", asked, "asked").select("asked", "c_name")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS head, c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' AS moved FROM customer")
def m20_sync_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("head"))
    return projects.sync(rows, rows.where("id % 2 = 0").select("id", F.lit("BUILDING").alias("head")))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7")
def f01_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"))
    return projects.owned(rows, "7").select("id").unionByName(projects.owned(rows, "seven").select("id"))


@query(f"WITH {_PLACES} SELECT n_nationkey AS id, 'fi1 ' || n_name AS text FROM places")
def x01_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select(F.col("n_nationkey").alias("id"), text.nfkc(F.concat(F.lit("ﬁ① "), "n_name")).alias("text"))


@query("""SELECT 'r' || n_regionkey AS id, '["' || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN 'x' || n_nationkey ELSE n_name END, '","' ORDER BY n_nationkey) || '"]' AS exposes,
'{' || string_agg('"' || CASE WHEN n_nationkey % 2 = 0 THEN 'x' || n_nationkey ELSE n_name END || '":"sync"', ',' ORDER BY n_nationkey) || '}' AS invocation FROM nation GROUP BY n_regionkey""")
def m07_rename_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region exposes and invokes its nations; even ones get new names."""
    nation = table(spark, sf_dir, "nation")
    own = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    named = nation.groupBy(F.format_string("r%d", "n_regionkey").alias("id")).agg(own.alias("names"))
    fields = F.create_map(F.lit("exposes"), F.to_json("names"), F.lit("invocation"), F.to_json(F.map_from_arrays("names", F.transform("names", lambda _: F.lit("sync")))))
    nodes = named.select("id", F.lit("boundary").alias("type"), fields.alias("fields"))
    names = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("id"), F.format_string("x%d", "n_nationkey").alias("new_id"))
    edges = spark.createDataFrame([], "id string, kind string, src string, dst string, fields map<string,string>")
    done = mutations.renamed(mutations.GraphTables(nodes, edges, spark.createDataFrame([], "id string, x double, y double")), names)
    return done.nodes.select("id", F.col("fields")["exposes"].alias("exposes"), F.col("fields")["invocation"].alias("invocation"))


@query("""SELECT 'node' AS what, n_name AS id FROM nation WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 'node', 'fresh' UNION ALL SELECT 'node', 'second'
UNION ALL SELECT 'edge', 'e' || n_nationkey FROM nation WHERE n_nationkey > 0 AND n_nationkey NOT IN (1, 2, 5) UNION ALL SELECT 'edge', 'extra'""")
def m01_op_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a chain; a batch adds, links, renames and removes."""
    nation = table(spark, sf_dir, "nation")
    none = F.create_map().cast("map<string,string>").alias("fields")
    name = lambda k: F.concat(F.lit("NATION_"), k.cast("string"))
    nodes = nation.select(F.col("n_name").alias("id"), F.lit("code").alias("type"), none)
    edges = nation.where("n_nationkey > 0").select(F.format_string("e%d", "n_nationkey").alias("id"), F.lit("flow").alias("kind"), name(F.col("n_nationkey") - 1).alias("src"), F.col("n_name").alias("dst"), none)
    tables = mutations.GraphTables(nodes, edges, spark.createDataFrame([], "id string, x double, y double"))
    ops = [
        {"op": "addNode", "node": {"id": "fresh", "type": "code"}}, {"op": "addEdge", "edge": {"id": "extra", "kind": "flow", "src": "NATION_3", "dst": "fresh"}}, {"op": "removeEdge", "id": "e5"},
        {"op": "removeNode", "id": "NATION_1"}, {"op": "renameNode", "id": "NATION_2", "to": "second"},
    ]
    done, _ = mutations.apply_ops(tables, ops)
    return done.nodes.select(F.lit("node").alias("what"), "id").unionByName(done.edges.select(F.lit("edge").alias("what"), "id"))


@query("""WITH c AS (SELECT 'r' || n_regionkey AS project, 0 AS kind, n_name AS by_, n_name AS name, 'web/' || n_name AS cwd, 'vite' AS command, n_nationkey % 4 = 0 AS install FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 15),
s AS (SELECT 'r' || n_regionkey AS project, 1, 'srv/' || n_name || '.py', CASE WHEN count(*) OVER (PARTITION BY n_regionkey) = 1 AND n_regionkey <> 1 THEN 'api' ELSE n_name END, '.', 'python srv/' || n_name || '.py', FALSE FROM nation WHERE n_nationkey >= 20 OR n_nationkey IN (15, 17)),
a AS (SELECT * FROM c UNION ALL SELECT * FROM s)
SELECT project, name, cwd, command, install, row_number() OVER (PARTITION BY project ORDER BY kind, by_) AS nth FROM a""")
def g16_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as projects, of whose nations some are clients and some emitted servers; ports are shown from 1."""
    nation = table(spark, sf_dir, "nation")
    project = F.format_string("r%d", "n_regionkey").alias("project")
    key = F.col("n_nationkey")
    clients = nation.where((key % 2 == 0) & (key < 15)).select(project, F.col("n_name").alias("id"), F.concat(F.lit("web/"), "n_name", F.lit("/")).alias("path"), F.lit("vite").alias("dev"))
    servers = nation.where((key >= 20) | key.isin(15, 17)).select(project, F.concat(F.lit("srv/"), "n_name", F.lit(".py")).alias("path"))
    apis = table(spark, sf_dir, "region").where("r_regionkey <> 1").select(F.format_string("r%d", "r_regionkey").alias("project"), F.lit("api").alias("id"))
    files = nation.where(key % 4 == 0).select(project, F.concat(F.lit("web/"), "n_name", F.lit("/package.json")).alias("path"))
    done = projects.processes(clients, servers, apis, files)
    return done.select("project", "name", "cwd", "command", "install", (F.col("port") - text.port_base(F.col("project")) + 1).alias("nth"))


@query("SELECT 'b' || n_nationkey AS branch, n_nationkey % 3 <> 0 AS moved, CASE WHEN n_nationkey % 3 <> 0 THEN 'new' ELSE 'other' END AS head FROM nation WHERE n_nationkey % 2 = 0")
def s20_move_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third branch moved since its commit was begun."""
    nation = table(spark, sf_dir, "nation")
    branch = F.format_string("b%d", "n_nationkey").alias("branch")
    refs = nation.select(branch, F.when(F.col("n_nationkey") % 3 == 0, "other").otherwise("old").alias("head"))
    return files.move_heads(refs, nation.where("n_nationkey % 2 = 0").select(branch, F.lit("old").alias("expected"), F.lit("new").alias("new")))[1]


@query(f"WITH {_PLACES} SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'name' WHEN 1 THEN 'cwd' WHEN 2 THEN 'cmd' WHEN 3 THEN 'port' END AS issue FROM places")
def f15_process_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's processes lack something else; the last one's are whole."""
    region = F.col("n_regionkey")
    spec = F.struct(F.when(region == 0, "").otherwise(F.col("n_name")).alias("name"), F.when(region == 1, "a/../../b").when(region == 4, ".").otherwise("a/b").alias("cwd"), F.when(region == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("run"))).alias("cmd"), F.when(region == 3, "x").when(region == 4, "80").alias("port"))
    return places(spark, sf_dir).select(F.col("n_nationkey").alias("id"), projects.process_issue(spec).alias("issue"))


@query("SELECT severity <> 'error' AS composition, FALSE AS graph, severity FROM (VALUES ('error'), ('run-blocking')) AS v(severity)")
def f18_may_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles alone stop a graph; missing entrypoints stop a composition too."""
    nodes, edges = rule_tables(spark, sf_dir)
    found = {"error": validation.need_entrypoints(nodes, edges), "run-blocking": validation.flow_cycles(edges)}
    rows = [validation.may_run(d, True).select(F.col("may_run").alias("composition")).crossJoin(validation.may_run(d, False).select(F.col("may_run").alias("graph"))).withColumn("severity", F.lit(s)) for s, d in found.items()]
    return rows[0].unionByName(rows[1])


@query("SELECT 'e' || r_regionkey AS emission, r_regionkey <> 2 AS api, r_regionkey < 2 AS server FROM region")
def a09_any_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    emission, key = F.format_string("e%d", "r_regionkey").alias("emission"), F.col("r_regionkey")
    documents = region.select(emission, F.lit("app.yaml").alias("path"), F.when(key == 2, "# boundary: api").otherwise("boundary: api").alias("content"))
    made = table(spark, sf_dir, "nation").select(F.format_string("e%d", "n_regionkey").alias("emission"), F.when((F.col("n_regionkey") < 2) & (F.col("n_nationkey") >= 20), "boundary-server").otherwise("agent").alias("role"))
    return emissions.serving(documents, made)


@query("SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey % 2, n_name) AS place FROM nation")
def o04_code_unit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even names begin beyond the first plane, odd ones at its end: UTF-16 has them the other way round than UTF-8."""
    named = table(spark, sf_dir, "nation").withColumn("t", F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("\U0001F600")).otherwise(F.lit("\uFFFD")), "n_name"))
    return named.select(F.col("n_nationkey").alias("id"), F.row_number().over(Window.orderBy(text.utf16_order(F.col("t")))).alias("place"))


@query("SELECT c_custkey AS sub, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def m14_upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer is unknown; even ones are seen."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sub"), F.col("c_custkey").alias("id"), F.lit("m").alias("email"), F.col("c_name").alias("name"), F.lit(1).alias("last_login"))
    seen = rows.where("sub % 2 = 0").withColumn("id", F.col("id") + 1000000).withColumn("name", F.lit("new")).withColumn("last_login", F.lit(2))
    return projects.upsert_users(rows.where("sub % 3 <> 0"), seen).select("sub", "id", "name")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
def m14_without_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"))
    return projects.without_expired(sessions, F.lit("1996-01-01").cast("timestamp_ntz")).select("id")


# --- cancellation ------------------------------------------------------------------------------------------


@query(f"WITH {_LOG} SELECT run_id, seq::BIGINT AS seq, type FROM log WHERE run_id % 5 <> 0 OR seq <= 3 UNION ALL SELECT run_id, 4, 'run.finished' FROM log WHERE run_id % 5 = 0 AND seq = 3")
def g09_cancelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth run is cancelled before its fourth event is reported."""
    events = log(spark, sf_dir)
    requests = events.where("run_id % 5 = 0").select("run_id", F.lit(3).cast("bigint").alias("seq")).distinct()
    return runlog.cancelled_at(events, requests).select("run_id", "seq", "type")


@query(f"WITH {_LOG} SELECT run_id, count(*)::BIGINT AS appended, run_id % 5 = 0 AS cancelled FROM log GROUP BY run_id")
def t03_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = log(spark, sf_dir)
    runs = events.select(F.col("run_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 5 == 0, "cancelled").otherwise("running"))
    return runlog.reports(events, runs)


# --- the log as source and stream ------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_LOG} SELECT run_id, seq, type, node_id FROM log WHERE seq > 5 AND run_id % 2 = 0")
def t01_source_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as files and read through its data source, behind an offset."""
    out = _folder(spark, "log")
    log(spark, sf_dir).select("run_id", "seq", "type", "node_id", "payload").write.parquet(out)
    source.register(spark)
    return spark.read.format("runlog").option("path", out).option("after", 3).load().where("seq > 5 AND run_id % 2 = 0").select("run_id", "seq", "type", "node_id")


@query("SELECT user_id::VARCHAR AS session, seq, line FROM (SELECT user_id, event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 20")
def t04_ring_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a session's lines: what a stream's buffers of 20 lines hold, read from its state."""
    state.with_store(spark)
    shape = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    lines = stream.select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("line"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("created_at"))
    out = _folder(spark, "lines")
    live.follow(state.ring_buffers(lines, 20, "3650 days"), lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/told"), f"{out}/progress", "update").awaitTermination()
    return state.buffered(spark, f"{out}/progress")


@query(f"""WITH {_LOG}, placed AS (SELECT run_id, type, row_number() OVER w AS nth, COALESCE(sum((type = 'run.finished')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM log WINDOW w AS (PARTITION BY run_id ORDER BY ts, type, node_id, payload))
SELECT run_id, (count(*) + CASE WHEN run_id % 7 = 0 AND NOT bool_or(type = 'run.finished') THEN 1 ELSE 0 END)::BIGINT AS appended, run_id % 7 = 0 AND NOT bool_or(type = 'run.finished') AS cancelled FROM placed WHERE ended = 0 GROUP BY run_id""")
def t03_report_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as reports of runs, every seventh asked to cancel: the answers of a batch."""
    shape = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    node = F.concat(F.lit("n"), (F.get_json_object("props", "$.k").cast("bigint") % 8).cast("string"))
    sent = stream.select(F.col("user_id").alias("run_id"), _cases(F.col("event_type"), _KINDS).alias("type"), node.alias("node_id"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))
    out = _folder(spark, "reports")
    asked = lambda s: s.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 7 = 0").select(F.col("user_id").alias("run_id"))
    live.follow(sent, reports.reporting(out, asked), f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("run_id", "appended", "cancelled")


@query("""WITH p AS (SELECT o_custkey AS graph, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
ok AS (SELECT *, o.graph % 3 <> 0 AND n >= 3 AS done FROM p o)
SELECT graph, 'node' AS what, CASE WHEN done AND nth = 2 THEN 'second' ELSE 'o' || k END AS id FROM ok WHERE NOT (done AND nth = 1) UNION ALL SELECT DISTINCT graph, 'node', 'fresh' FROM ok WHERE done
UNION ALL SELECT graph, 'edge', 'e' || k FROM ok WHERE nth > 1 AND NOT (done AND nth = 2) UNION ALL SELECT DISTINCT graph, 'edge', 'extra' FROM ok WHERE done
UNION ALL SELECT DISTINCT graph, 'refusal', CASE WHEN n < 3 THEN 'there is no node "none"' ELSE 'the update has no effect' END FROM ok WHERE NOT done""")
def m01_op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a graph, a chain; five ops on each in one log, of which some graphs' are refused."""
    from loomgraph.operators import oplog

    by = Window.partitionBy("o_custkey")
    every = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("ord"), F.row_number().over(by.orderBy("o_orderkey")).alias("nth"), F.lag("o_orderkey").over(by.orderBy("o_orderkey")).alias("before"), F.count(F.lit(1)).over(by).alias("n"))
    name = lambda k: F.concat(F.lit("o"), k.cast("string"))
    nodes = every.select("graph", "ord", name(F.col("ord")).alias("id"), F.lit("code").alias("type"), F.create_map(F.lit("size"), F.lit("1")).alias("fields"))
    edges = every.where("nth > 1").select("graph", "ord", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("id"), F.lit("flow").alias("kind"), name(F.col("before")).alias("src"), name(F.col("ord")).alias("dst"), F.create_map().cast("map<string,string>").alias("fields"))
    firsts = every.groupBy("graph").agg(F.min("ord").alias("a"), F.min(F.when(F.col("nth") == 2, F.col("ord"))).alias("b"), F.max("n").alias("n"))
    first, second = name(F.col("a")), F.when(F.col("n") >= 3, name(F.col("b"))).otherwise("none")
    texts = [
        F.lit('{"op": "addNode", "node": {"id": "fresh", "type": "io"}}'), F.format_string('{"op": "removeNode", "id": "%s"}', first), F.format_string('{"op": "renameNode", "id": "%s", "to": "second"}', second),
        F.lit('{"op": "addEdge", "edge": {"id": "extra", "kind": "flow", "src": "second", "dst": "fresh"}}'), F.when(F.col("graph") % 3 == 0, F.lit('{"op": "updateNode", "id": "second", "patch": {"size": "1"}}')).otherwise('{"op": "updateNode", "id": "second", "patch": {"size": "2"}}'),
    ]
    ops = firsts.select("graph", F.posexplode(F.array(*texts)).alias("ord", "op"))
    layout = spark.createDataFrame([], f"graph {ops.schema['graph'].dataType.simpleString()}, id string, x double, y double")
    after, links, _, outcomes = oplog.apply_op_log(nodes, edges, layout, ops)
    rows = lambda df, what, c: df.select("graph", F.lit(what).alias("what"), F.col(c).alias("id"))
    return rows(after, "node", "id").unionByName(rows(links, "edge", "id")).unionByName(rows(outcomes.where("refusal is not null"), "refusal", "refusal"))


@query(f"""WITH {_PLACES} SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 7 WHEN 1 THEN 'leads nowhere' WHEN 3 THEN 'no such file' ELSE 'refers to a schema that is wrong' END AS why FROM places WHERE n_nationkey % 7 IN (1, 3)
UNION ALL SELECT a.n_nationkey, 'refers to a schema that is wrong' FROM places a JOIN places b ON b.n_nationkey = a.n_nationkey - 1 WHERE a.n_nationkey % 7 IN (2, 4)""")
def s13_schema_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' schemas: a tree of itself, a definition that is missing, a file that is missing, and files that refer to those before them."""
    rows = places(spark, sf_dir)
    key = F.col("n_nationkey")
    kind = (key % 7).cast("int")
    tree = '{"type": "object", "properties": {"next": {"$ref": "#"}, "leaf": {"$ref": "#/$defs/leaf"}}, "$defs": {"leaf": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/leaf"}]}}}'
    before = F.format_string('{"items": {"$ref": "./NODE_%d.json"}, "allOf": [{"$ref": "#/items"}]}', key - 1)
    known = rows.select((key + 1).alias("n_nationkey"), F.lit(True).alias("has_before"))
    body = F.when(kind == 1, F.lit('{"$ref": "#/$defs/none", "$defs": {}}')).when(kind == 3, F.lit('{"not": {"$ref": "none.json"}}')).when(kind.isin(2, 4) & F.col("has_before"), before).otherwise(F.lit(tree))
    files_ = rows.join(known, "n_nationkey", "left").select(F.concat(F.lit("schemas/"), "n_name", F.lit(".json")).alias("path"), body.alias("content"))
    nodes = rows.select(key.alias("id"), F.lit("io").alias("type"), F.concat(F.lit("schemas/"), "n_name", F.lit(".json")).alias("schema"))
    return validation.schemas(nodes, files_).select(F.col("node_id").cast("bigint").alias("id"), F.regexp_extract("message", "(leads nowhere|no such file|refers to a schema that is wrong)", 1).alias("why"))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k, lang, source FROM documents), found AS (
SELECT doc_id, '/spec/nodes/1/direction' AS pointer, 'n' || doc_id AS node FROM d WHERE k = 0
UNION ALL SELECT doc_id, '/spec/edges/0/kind', NULL FROM d WHERE k = 0 AND lang <> 'en'
UNION ALL SELECT doc_id, '/spec/nodes/0/impl', 's' || doc_id FROM d WHERE k = 1
UNION ALL SELECT doc_id, '/spec/maxTurns', NULL FROM d WHERE k = 2 AND lang <> 'de'
UNION ALL SELECT doc_id, '/spec/promptFile', NULL FROM d WHERE k = 2
UNION ALL SELECT doc_id, '/kind', NULL FROM d WHERE k = 3 UNION ALL SELECT doc_id, '', NULL FROM d WHERE k = 4)
SELECT doc_id || '.yaml' AS file, pointer, node FROM found""")
def g18_manifest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each document: graphs, compositions, agents, one of another kind, one that does not parse, one that is right."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("name"))
    head = '{"apiVersion": "v1", "metadata": {"id": "m"}, "kind": "%s", "spec": %s}'
    bodies = {
        0: ("Graph", '{"nodes": [{"id": "a", "type": "code"}, {"id": "n@", "type": "io", "direction": "both"}], "edges": [{"id": "e", "kind": "@lang", "from": {"node": "a"}, "to": {"node": "a"}}]}'),
        1: ("Composition", '{"nodes": [{"id": "s@", "type": "service", "impl": {"graph": "g.yaml", "entrypoint": "m.py"}}]}'), 2: ("Agent", '{"promptFile": "/p@.md", "maxTurns": "@turns"}'), 3: ("Plan", "{}"), 5: ("Agent", '{"promptFile": "p@.md", "maxTurns": 4}'),
    }
    text = F.when(F.col("doc_id") % 6 == 4, F.lit("{"))
    for k, (kind, body) in bodies.items():
        text = text.when(F.col("doc_id") % 6 == k, F.lit(head % (kind, body)))
    turns = F.when(F.col("lang") == "de", "3").otherwise('"x"')
    text = F.replace(F.replace(F.replace(text, F.lit("@lang"), F.when(F.col("lang") == "en", "flow").otherwise("other")), F.lit('"@turns"'), turns), F.lit("@"), F.col("name"))
    found = validation.manifest_issues(docs.select(F.concat("name", F.lit(".yaml")).alias("path"), text.alias("document")))
    return found.select("file", "pointer", F.col("node_id").alias("node"))


@query("""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, doc_id % 4 AS k FROM documents)
SELECT doc_id, CASE WHEN k = 1 THEN t WHEN length(t) < 40 THEN t WHEN k = 2 THEN '<' || t || '>' ELSE 'head ' || substr(t, 1, 10) || '[' || substr(t, 21, 10) || 'x' || 'y' || substr(t, 31) END AS content,
CASE WHEN k = 1 THEN CASE WHEN length(t) < 40 THEN 'a span is outside the text' ELSE 'spans overlap' END WHEN length(t) < 40 THEN 'a span is outside the text' END AS refusal FROM d""")
def m09_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every document: replaced and inserted spans, spans that overlap, and spans beyond short texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    kind, size = F.col("path") % 4, F.greatest(F.length("content"), F.lit(40))
    edit = lambda start, end, order, text_: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(order).alias("ord"), F.lit(text_).alias("text"))
    at = F.lit
    several = F.array(edit(at(30), at(30), 1, "x"), edit(at(10), at(20), 2, "["), edit(at(30), at(30), 3, "y"), edit(at(0), at(0), 4, "head "), edit(size, size, 5, ""))
    around = F.array(edit(size, size, 1, ">"), edit(at(0), at(0), 2, "<"))
    overlap = F.array(edit(at(5), at(12), 1, "a"), edit(at(11), at(14), 2, "b"), edit(size, size, 3, ""))
    edits = docs.select("path", F.inline(F.when(kind == 1, overlap).when(kind == 2, around).otherwise(several)))
    return splices.spliced(docs, edits).join(splices.refusals(docs, edits), "path", "left").select(F.col("path").alias("doc_id"), "content", "refusal")
