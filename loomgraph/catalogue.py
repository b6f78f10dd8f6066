"""Queries by name, each beside its DuckDB SQL.

The tables stand in for the engine's own: events for run logs (run = user, node = k mod 8), documents for
files, labels and benchmark for pending changes, regions down to orders for graphs, customers and
suppliers for typed nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import agents, contracts, text
from loomgraph.operators import emissions, folds, graphs, mutations, overlay, projects, runlog, validation
from loomgraph.plans import classify
from loomgraph.plans.compile import Step, compile_graph
from loomgraph.plans.graph import Edge, Graph, Node
from loomgraph.sources.shared import shared_dir
from loomgraph.streaming import runlog as live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins -----------------------------------------------------------------------------------------

_KINDS = {"signup": "run.started", "view": "node.started", "click": "node.output", "purchase": "node.finished", "error": "node.failed"}


def _cases(column: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _sql_cases(column: str, names: dict[str, str]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in names.items())} END"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, seq, type, node_id, payload, ts, value)."""
    events = table(spark, sf_dir, "events")
    node = F.concat(F.lit("n"), (F.get_json_object("props", "$.k").cast("bigint") % 8).cast("string"))
    named = events.select(F.col("user_id").alias("run_id"), _cases(F.col("event_type"), _KINDS).alias("type"), node.alias("node_id"), F.col("props").alias("payload"), "ts", "value", "event_id")
    return runlog.number(named, "run_id", "ts", "event_id").drop("event_id")


_LOG = f"log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, {_sql_cases('event_type', _KINDS)} AS type, 'n' || ((props->>'k')::BIGINT % 8) AS node_id, props AS payload, ts, value FROM events)"


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(_doc_path().alias("path"), F.col("text").alias("content"))


def _doc_path() -> Column:
    return F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _doc_path().alias("path"))
    marks = table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").join(docs, "doc_id")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("quality") == 0, "delete").otherwise("modify")
    changed = marks.select("path", kind.alias("kind"), F.when(kind == "modify", F.concat(F.lit("rewritten "), "path")).alias("content"), none.alias("from_path"))
    added = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.lit("add").alias("kind"), F.col("text").alias("content"), none.alias("from_path"))
    return changed.unionByName(added)


_FILES = """base AS (SELECT 'docs/' || lang || '/' || doc_id || '.md' AS path, text AS content FROM documents),
pending AS (SELECT path, CASE WHEN quality = 0 THEN 'delete' ELSE 'modify' END AS kind, CASE WHEN quality <> 0 THEN 'rewritten ' || path END AS content FROM labels JOIN (SELECT doc_id, 'docs/' || lang || '/' || doc_id || '.md' AS path FROM documents) USING (doc_id) WHERE quality = 0 OR toxic = 1
 UNION ALL SELECT 'bench/' || item_id || '.md', 'add', text FROM benchmark),
live AS (SELECT path FROM base WHERE path NOT IN (SELECT path FROM pending WHERE kind = 'delete') UNION SELECT path FROM pending WHERE kind <> 'delete')"""

_TYPES = {"0": "client", "1": "boundary", "2": "service", "3": "process", "4": "service"}


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as typed nodes: their region says the type."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("bigint").alias("id"), _cases(F.col("n_regionkey").cast("string"), _TYPES).alias("type"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as an edge from the customer's nation to the supplier's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("dst"))
    kind = F.when(F.col("l_returnflag") == "N", "routes-to").otherwise("depends-on")
    joined = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey")
    return joined.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), kind.alias("kind"), "src", "dst")


_TRADE = f"""nodes AS (SELECT n_nationkey::BIGINT AS id, {_sql_cases('n_regionkey::VARCHAR', _TYPES)} AS type FROM nation),
edges AS (SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN 'routes-to' ELSE 'depends-on' END AS kind, c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
typed AS (SELECT e.*, a.type AS from_type, b.type AS to_type FROM edges e LEFT JOIN nodes a ON e.src = a.id LEFT JOIN nodes b ON e.dst = b.id)"""


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order, as names."""
    def named(name: str, key: str, up: str, parent: str, prefix: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(parent), F.col(up).cast("string")).alias("src"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("dst"))

    return named("nation", "n_nationkey", "n_regionkey", "r", "n").unionByName(named("customer", "c_custkey", "c_nationkey", "n", "c")).unionByName(named("orders", "o_orderkey", "o_custkey", "c", "o"))


_TREE = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return roots.unionByName(tree_edges(spark, sf_dir).select(F.col("dst").alias("id")))


# --- dataflow graph ------------------------------------------------------------------------------------

_SPACE = r"[\s\x0B\x1C-\x1F]+"
_CLASSIFIED = rf"""n AS (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS body FROM documents),
w AS (SELECT *, len(list_filter(string_split(body, ' '), lambda x: x <> '')) AS word_count, lower(body) AS low FROM n),
c AS (SELECT doc_id, word_count, CASE WHEN contains(low, 'licen') THEN 'contract' WHEN contains(low, '@') THEN 'correspondence' WHEN contains(low, '$') THEN 'invoice' ELSE 'other' END AS category, CASE WHEN word_count > 100 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM w)"""


@query(f"""WITH {_CLASSIFIED}
SELECT doc_id, doc_id::VARCHAR AS id, category, confidence, CASE WHEN category = 'other' THEN '' ELSE category || '-index' END AS enriched_from, FALSE AS failed FROM c""")
def g03_classify_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify.classify(table(spark, sf_dir, "documents")).result("doc_id")
    return done.select("doc_id", "ledger.id", "ledger.category", "ledger.confidence", F.array_join("ledger.related", ",").alias("enriched_from"), F.col("failed").isNotNull().alias("failed"))


@query(f"""WITH {_CLASSIFIED}, steps AS (SELECT * FROM (VALUES (0, 'run.started', NULL, NULL), (1, 'node.started', 'tidy', NULL), (2, 'node.finished', 'tidy', NULL), (3, 'node.started', 'sorter', NULL), (4, 'node.finished', 'sorter', NULL), (5, 'node.started', 'filing', NULL), (6, 'node.started', 'shelve', '{classify.FILING}'), (7, 'node.finished', 'shelve', '{classify.FILING}'), (8, 'node.output', 'filed', '{classify.FILING}'), (9, 'node.finished', 'filing', NULL), (10, 'node.output', 'ledger', NULL), (11, 'node.output', 'trace', NULL), (12, 'run.finished', NULL, NULL)) AS v(seq, type, node_id, graph_path))
SELECT doc_id AS run_id, seq::BIGINT AS seq, type, node_id, graph_path, CASE WHEN node_id IN ('filing') AND type = 'node.finished' THEN category END AS category FROM c CROSS JOIN steps""")
def g03_graph_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = classify.classify(table(spark, sf_dir, "documents")).log("doc_id")
    shown = F.when((F.col("node_id") == "filing") & (F.col("type") == "node.finished"), F.get_json_object("payload", "$.output.category"))
    return events.select("run_id", "seq", "type", "node_id", "graph_path", shown.alias("category"))


@query(rf"""SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS body FROM documents""")
def x02_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("body"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F]+'), lambda x: x <> ''))::BIGINT AS word_count FROM documents")
def x03_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("word_count"))


_DOORS = ("n0", "n1", "n2")


@query(f"""WITH {_LOG}, v AS (SELECT run_id, node_id, sum(value) AS s FROM log WHERE node_id IN ('n0', 'n1', 'n2') GROUP BY ALL)
SELECT run_id, max(CASE WHEN node_id = 'n0' THEN round(s, 4) END) AS n0, max(CASE WHEN node_id = 'n1' THEN round(s, 4) END) AS n1, max(CASE WHEN node_id = 'n2' THEN round(s, 4) END) AS n2 FROM v GROUP BY run_id""")
def j13_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled graph with three doors, whose output gets their values side by side."""
    rows = log(spark, sf_dir).where(F.col("node_id").isin(*_DOORS)).groupBy("run_id")
    of = lambda n: F.round(F.sum(F.when(F.col("node_id") == n, F.col("value"))), 4).alias(n)
    runs = rows.agg(F.struct(*[of(n) for n in _DOORS]).alias("input"))
    doors = Graph((*[Node(n, "io", {"direction": "in"}) for n in _DOORS], Node("out", "io", {"direction": "out"})), tuple(Edge(n, "flow", n, "out") for n in _DOORS))
    return compile_graph(runs, "g", {"g": doors}, {}).result("run_id").select("run_id", "out.*")


# --- run log ---------------------------------------------------------------------------------------------


@query(f"WITH {_LOG} SELECT run_id, seq::BIGINT AS seq, type, node_id FROM log")
def w01_event_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("run_id", "seq", "type", "node_id")


@query(f"WITH {_LOG} SELECT run_id, seq::BIGINT AS seq, type FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS p FROM log WHERE seq > 10) WHERE p <= 20")
def t01_events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.after(log(spark, sf_dir), 10, 20).select("run_id", "seq", "type")


@query(f"WITH {_LOG} SELECT run_id, node_id, arg_max(CASE type WHEN 'node.started' THEN 'running' WHEN 'node.failed' THEN 'failed' ELSE 'finished' END, seq) AS state FROM log WHERE type LIKE 'node.%' GROUP BY ALL")
def a01_node_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.node_states(log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT run_id, CASE WHEN count(*) FILTER (type = 'node.failed') > 0 THEN 'finished' WHEN count(*) FILTER (type = 'run.started') > 0 THEN 'running' ELSE 'queued' END AS status, count(*)::BIGINT AS events FROM log GROUP BY run_id")
def a02_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_status(log(spark, sf_dir), finished="node.failed")


@query(f"WITH {_LOG}, ends AS (SELECT run_id, min(seq) AS e FROM log WHERE type = 'node.failed' GROUP BY run_id) SELECT run_id, count(*)::BIGINT AS n_events, max(seq)::BIGINT AS last_seq FROM log LEFT JOIN ends USING (run_id) WHERE e IS NULL OR seq <= e GROUP BY run_id")
def t07_without_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = runlog.without_late(log(spark, sf_dir), "node.failed")
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_events"), F.max("seq").alias("last_seq"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE::VARCHAR AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def o01_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.latest_runs(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("created"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p <= 10")
def w03_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.tail(table(spark, sf_dir, "events"), "user_id", "event_id", 10).select("user_id", "event_id")


@query(f"WITH {_LOG} SELECT run_id, count(*) FILTER (seq > 10)::BIGINT AS n_lines, COALESCE(max(seq) FILTER (seq > 10), 10)::BIGINT AS last_seq FROM log GROUP BY run_id")
def a13_lines_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.lines_after(log(spark, sf_dir), "run_id", "seq", 10)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts) + INTERVAL 1 HOUR)::BIGINT AS end_us, count(*)::BIGINT AS touches FROM s GROUP BY user_id, k""")
def t05_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    done = runlog.idle_sessions(events, "user_id", "ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    return done.select("user_id", us("start"), us("end"), "touches")


@query(f"WITH {_LOG} SELECT run_id, node_id, arg_max(CASE type WHEN 'node.started' THEN 'running' WHEN 'node.failed' THEN 'failed' ELSE 'finished' END, seq) AS state FROM log WHERE type LIKE 'node.%' GROUP BY ALL")
def t06_live_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states, kept by a stream over the event files; read from the table that its last batch wrote."""
    shape = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    node = F.concat(F.lit("n"), (F.get_json_object("props", "$.k").cast("bigint") % 8).cast("string"))
    events = stream.select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("seq"), _cases(F.col("event_type"), _KINDS).alias("type"), node.alias("node_id"))
    out = f"{shared_dir(spark)}/loomgraph/states-{uuid.uuid4().hex}"
    live.follow(live.live_states(events), lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table"), f"{out}/progress", "complete").awaitTermination()
    return spark.read.parquet(f"{out}/table")


# --- overlay ---------------------------------------------------------------------------------------------


@query(f"WITH {_FILES} SELECT path FROM live")
def u01_overlay_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.listing(base_files(spark, sf_dir), pending(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path FROM live WHERE regexp_full_match(path, '(?:.*/)?e[^/]/[^/]*\\.md')")
def u02_overlay_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.listing(base_files(spark, sf_dir), pending(spark, sf_dir), "**/e?/*.md")


@query(f"WITH {_FILES}, a AS (SELECT unnest(['docs', 'docs/en', 'docs/xx', 'bench', 'bench/0.md', 'nothing']) AS path UNION ALL SELECT path FROM base) SELECT path, (path IN (SELECT path FROM live) OR path IN ('docs', 'docs/en', 'bench')) AS exists FROM a")
def u03_overlay_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_files(spark, sf_dir)
    asked = spark.createDataFrame([(p,) for p in ("docs", "docs/en", "docs/xx", "bench", "bench/0.md", "nothing")], "path string").unionByName(base.select("path"))
    return overlay.exists(base, pending(spark, sf_dir), asked)


@query(f"WITH {_FILES} SELECT COALESCE(p.path, b.path) AS path, sha256(COALESCE(p.content, b.content)) AS content_sha, COALESCE(p.kind, 'base') AS origin FROM base b FULL JOIN pending p ON b.path = p.path WHERE COALESCE(p.kind, '') <> 'delete'")
def j02_overlay_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.read(base_files(spark, sf_dir), pending(spark, sf_dir)).select("path", F.sha2("content", 256).alias("content_sha"), "origin")


@query(f"WITH {_FILES} SELECT path FROM base WHERE path NOT IN (SELECT path FROM pending WHERE content IS NOT NULL OR kind = 'delete')")
def j04_to_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.to_hydrate(base_files(spark, sf_dir).select("path"), pending(spark, sf_dir))


@query(f"WITH {_FILES} SELECT p.path, p.kind, length(b.content)::BIGINT AS chars_before, length(p.content)::BIGINT AS chars_after FROM pending p LEFT JOIN base b USING (path)")
def j05_overlay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = overlay.diff(base_files(spark, sf_dir), pending(spark, sf_dir))
    return done.select("path", "kind", F.length("before").cast("bigint").alias("chars_before"), F.length("after").cast("bigint").alias("chars_after"))


@query(f"""WITH {_FILES}, saves AS (SELECT path, 'modify' AS kind, 'saved' AS content FROM base WHERE path LIKE 'docs/de/%')
SELECT COALESCE(p.path, s.path) AS path, CASE WHEN s.path IS NULL THEN p.kind WHEN p.kind = 'delete' THEN 'modify' ELSE COALESCE(p.kind, s.kind) END AS kind, CASE WHEN s.path IS NULL THEN length(p.content) ELSE 5 END::BIGINT AS chars FROM pending p FULL JOIN saves s ON p.path = s.path""")
def m10_pending_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = base_files(spark, sf_dir).where(F.col("path").startswith("docs/de/")).select("path", F.lit("modify").alias("kind"), F.lit("saved").alias("content"), F.lit(None).cast("string").alias("from_path"))
    return overlay.upsert(pending(spark, sf_dir), saves).select("path", "kind", F.length("content").cast("bigint").alias("chars"))


@query("SELECT c_custkey AS key, 'old' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, min(o_orderpriority) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def m12_memo_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("origin"))
    return overlay.insert_absent(memo, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("origin")), "key")


# --- validation and graphs ---------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, nth, first_part FROM (SELECT *, row_number() OVER w AS nth, first_value(l_partkey) OVER w AS first_part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)) WHERE nth > 1""")
def a03_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    found = validation.duplicates(lines, "l_orderkey", "l_linenumber", order=["l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "nth", F.col("first_ord.l_partkey").alias("first_part"))


@query("""SELECT o_orderkey AS id, 'to' AS side, o_custkey AS "end" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def j06_unknown_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges from themselves to customers, of whom only those in credit are nodes."""
    orders = table(spark, sf_dir, "orders")
    nodes = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    edges = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("src"), F.col("o_custkey").alias("dst"))
    return validation.unknown_ends(edges, nodes).where("side = 'to'").select("id", "side", "end")


@query(f"""WITH {_TRADE} SELECT n.id, n.type || ' ' || n.id || ' exposes ' || (n.id + 1) || ': ' || CASE WHEN t.type IS NULL THEN 'no node' ELSE 'a ' || t.type END AS message FROM nodes n LEFT JOIN nodes t ON t.id = n.id + 1 WHERE t.type IS NULL OR t.type <> 'service'""")
def j07_non_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation exposes the next one, which may be no service, or none at all."""
    nodes = trade_nodes(spark, sf_dir)
    found = validation.non_services(nodes.withColumn("exposes", F.array(F.col("id") + 1)), "exposes", "exposes-non-service", "exposes")
    return found.select(F.col("node_id").cast("bigint").alias("id"), "message")


@query(f"""WITH {_TRADE}, bad AS (SELECT *, CASE WHEN to_type = 'client' THEN ['client-is-edge-target'] WHEN kind = 'routes-to' AND to_type = 'process' THEN ['edge-kind-bad-target']
 WHEN kind = 'routes-to' AND NOT ((from_type = 'client' AND to_type = 'boundary') OR (from_type = 'boundary' AND to_type = 'service')) THEN ['edge-kind-bad-source'] WHEN kind = 'routes-to' THEN []
 ELSE list_concat(CASE WHEN from_type IN ('client', 'boundary') THEN ['edge-kind-bad-source'] ELSE [] END, CASE WHEN to_type <> 'service' THEN ['edge-kind-bad-target'] ELSE [] END) END AS codes FROM typed)
SELECT code, from_type, to_type, kind, count(*)::BIGINT AS edges FROM (SELECT *, unnest(codes) AS code FROM bad) GROUP BY ALL""")
def j08_edge_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = validation.composition_typing(trade_edges(spark, sf_dir), trade_nodes(spark, sf_dir))
    return typed.withColumn("code", F.explode("codes")).groupBy("code", "from_type", "to_type", "kind").agg(F.count(F.lit(1)).alias("edges"))


_GRAPH_TYPES = {"0": "io", "1": "agent", "2": "code", "3": "subgraph", "4": "io"}
_GRAPH = f"""gn AS (SELECT n_nationkey::BIGINT AS id, {_sql_cases('n_regionkey::VARCHAR', _GRAPH_TYPES)} AS type, CASE n_regionkey WHEN 0 THEN 'in' WHEN 4 THEN 'out' END AS direction FROM nation)"""


@query(f"""WITH {_TRADE}, {_GRAPH}, t AS (SELECT e.*, CASE WHEN e.kind = 'routes-to' THEN 'flow' ELSE 'capability' END AS k, a.type AS ft, b.type AS tt, a.direction AS fd, b.direction AS td FROM edges e JOIN gn a ON a.id = e.src JOIN gn b ON b.id = e.dst),
bad AS (SELECT *, CASE WHEN k = 'capability' THEN list_concat(CASE WHEN ft <> 'agent' THEN ['capability-edge-bad-source'] ELSE [] END, CASE WHEN tt <> 'code' THEN ['capability-edge-bad-target'] ELSE [] END)
 ELSE list_concat(CASE WHEN ft = 'io' AND fd = 'out' THEN ['io-direction-violation'] ELSE [] END, CASE WHEN tt = 'io' AND td = 'in' THEN ['io-direction-violation'] ELSE [] END) END AS codes FROM t)
SELECT code, ft AS from_type, tt AS to_type, count(*)::BIGINT AS edges FROM (SELECT *, unnest(codes) AS code FROM bad) GROUP BY ALL""")
def j09_graph_edge_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.col("n_regionkey").cast("string")
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), _cases(region, _GRAPH_TYPES).alias("type"), _cases(region, {"0": "in", "4": "out"}).alias("direction"))
    edges = trade_edges(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "routes-to", "flow").otherwise("capability"))
    typed = validation.graph_typing(edges, nodes)
    return typed.withColumn("code", F.explode("codes")).groupBy("code", "from_type", "to_type").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT p_partkey AS id FROM part WHERE p_size < 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')")
def j11_flow_needs_entrypoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts declare no entrypoint; line items not returned are flow edges."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    nodes = part.select(F.col("p_partkey").alias("id"), F.lit("code").alias("type"), F.when(F.col("p_size") >= 10, F.col("p_name")).alias("entrypoint"))
    edges = lines.select(F.when(F.col("l_returnflag") == "N", "flow").otherwise("capability").alias("kind"), F.lit(None).cast("bigint").alias("src"), F.col("l_partkey").alias("dst"))
    return validation.flow_without_entrypoint(nodes, edges).select("id")


@query("SELECT s_suppkey AS agent, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber, l_partkey) AS tools FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY s_suppkey")
def j12_agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"), F.when(F.col("l_returnflag") == "R", "capability").otherwise("flow").alias("kind"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(None).cast("string").alias("function"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("entrypoint"))
    return graphs.tools_of_agents(nodes, edges).select("agent", F.array_join(F.transform("tools", lambda t: t["node"].cast("string")), ",").alias("tools"))


@query("SELECT p_partkey AS id, (SELECT arg_max(l_returnflag || l_linestatus, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS function FROM part")
def j14_contract_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("ord"), F.lit("capability").alias("kind"), F.col("l_partkey").alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("function"))
    return graphs.contract_targets(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges)


@query("SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n_in FROM customer")
def a04_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.in_degree(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dst")))


@query(f"WITH RECURSIVE {_TREE}, d(id, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT dst, depth + 1 FROM d JOIN edges ON src = id) SELECT id, max(depth)::BIGINT AS depth FROM d GROUP BY id")
def g02_topo_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.depths(tree_nodes(spark, sf_dir), tree_edges(spark, sf_dir))


#: Orders as nodes of their customer's graph; the customers are of five kinds, by n_regionkey.
_PLACES = "places AS (SELECT o_orderkey AS n_nationkey, (o_custkey % 5)::INTEGER AS n_regionkey, 'NODE_' || o_orderkey AS n_name, o_custkey AS n_ring FROM orders)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n_nationkey"), (F.col("o_custkey") % 5).cast("int").alias("n_regionkey"), F.format_string("NODE_%d", "o_orderkey").alias("n_name"), F.col("o_custkey").alias("n_ring"))


_RING = f"{_PLACES}, ring AS (SELECT n_nationkey AS src, COALESCE(lead(n_nationkey) OVER (PARTITION BY n_ring ORDER BY n_nationkey), CASE WHEN n_regionkey <> 2 THEN min(n_nationkey) OVER (PARTITION BY n_ring) END) AS dst, n_ring, n_regionkey FROM places)"


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in a ring, but those of one kind of customers in chains: (src, dst, n_ring, n_regionkey)."""
    from pyspark.sql import Window

    by = Window.partitionBy("n_ring")
    back = F.when(F.col("n_regionkey") != 2, F.min("n_nationkey").over(by))
    rows = places(spark, sf_dir).select(F.col("n_nationkey").alias("src"), F.coalesce(F.lead("n_nationkey").over(by.orderBy("n_nationkey")), back).alias("dst"), "n_ring", "n_regionkey")
    return rows.where("dst is not null")


@query(f"WITH RECURSIVE {_RING}, w(a, b, n) AS (SELECT src, dst, 1 FROM ring WHERE dst IS NOT NULL UNION ALL SELECT a, dst, n + 1 FROM w JOIN ring ON src = b WHERE n < 60 AND a <> b AND dst IS NOT NULL) SELECT DISTINCT a::BIGINT AS id FROM w WHERE a = b")
def g10_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.on_cycles(ring(spark, sf_dir))


@query(f"WITH RECURSIVE {_TREE}, d(id, depth) AS (SELECT 'r0', 0 UNION ALL SELECT dst, depth + 1 FROM d JOIN edges ON src = id) SELECT id, min(depth)::BIGINT AS depth FROM d GROUP BY id")
def g12_reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(spark.createDataFrame([("r0",)], "id string"), tree_edges(spark, sf_dir))


@query(f"""WITH {_TRADE} SELECT DISTINCT src, dst, CASE WHEN to_type IN ('client', 'process') THEN '' WHEN from_type = 'client' THEN CASE WHEN to_type = 'boundary' THEN 'routes-to' ELSE '' END WHEN from_type = 'boundary' THEN CASE WHEN to_type = 'service' THEN 'routes-to' ELSE '' END WHEN to_type <> 'service' THEN '' ELSE 'depends-on' END AS kind,
CASE WHEN to_type = 'client' THEN 'clients have no callers' WHEN to_type = 'process' THEN 'processes have no callers' WHEN from_type = 'client' AND to_type <> 'boundary' THEN 'clients call boundaries only'
WHEN from_type = 'boundary' AND to_type <> 'service' THEN 'boundaries call services only' WHEN from_type NOT IN ('client', 'boundary') AND to_type <> 'service' THEN 'dependencies are services' END AS refusal FROM typed""")
def g13_edge_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_edges(spark, sf_dir).select("src", "dst").distinct().withColumn("id", F.concat_ws("-", "src", "dst"))
    return graphs.composition_edge_kind(edges, trade_nodes(spark, sf_dir)).select("src", "dst", "kind", "refusal")


# --- folds -------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT source, list_sort(list({'path': lpad(doc_id::VARCHAR, 10, '0'), 'size': octet_length(encode(text))::BIGINT})) AS items FROM documents GROUP BY source),
f AS (SELECT source, list_reduce(list_transform(items, lambda y: {'total': 0::BIGINT, 'taken': []::VARCHAR[], 'path': y.path, 'size': y.size}),
 lambda acc, x: CASE WHEN x.size <= 8000 AND acc.total + x.size <= 40000 THEN {'total': (acc.total + x.size)::BIGINT, 'taken': list_append(acc.taken, x.path), 'path': '', 'size': 0::BIGINT} ELSE acc END,
 {'total': 0::BIGINT, 'taken': []::VARCHAR[], 'path': '', 'size': 0::BIGINT}) AS r FROM s)
SELECT source, unnest(r.taken) AS path FROM f""")
def a05_greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), F.octet_length("text").alias("size"))
    return folds.greedy_select(files, ["source"], "path", F.col("size"), 8_000, 40_000)


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents WHERE octet_length(encode(text)) <= 204800) WHERE p <= 60")
def a06_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.octet_length("text") <= 200 * 1024)
    return folds.first_n(docs, ["source"], "doc_id", 60).select("source", "doc_id")


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 204800 ORDER BY lpad(doc_id::VARCHAR, 10, '0') LIMIT 400")
def s19_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), "text")
    return folds.session_files(files, "path", "text").select("doc_id")


@query("SELECT source, sha256(string_agg(path || chr(0) || text || chr(0), '' ORDER BY path) || 'patterns' || chr(0) || 'model' || chr(0) || '3') AS input_hash FROM (SELECT source, lpad(doc_id::VARCHAR, 10, '0') AS path, text FROM documents) GROUP BY source")
def a08_input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), "text")
    return folds.fingerprint(files, ["source"], "path", "text", "patterns", "model", "3")


@query("SELECT o_custkey AS case_id, arg_min(o_orderstatus, s) AS branch, min(n)::BIGINT AS issues FROM (SELECT *, lpad(n::VARCHAR, 8, '0') || o_orderstatus AS s FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)) GROUP BY o_custkey")
def a12_best_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("branch"), F.lit(1).alias("n"))
    return folds.best_branch(issues, "case_id", "branch")


_URL_PATH = r"regexp_replace(url, '^[a-z]+://[^/]+/', '')"


@query(f"WITH p AS (SELECT DISTINCT {_URL_PATH} AS path FROM pages) SELECT regexp_extract(path, '^(.*)/', 1) AS dir, string_agg(path, '|' ORDER BY path) AS files FROM p GROUP BY ALL")
def a14_files_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^[a-z]+://[^/]+/", "").alias("path")).distinct()
    return folds.by_directory(paths, "path").select("dir", F.array_join("files", "|").alias("files"))


@query("SELECT lang, count(*) FILTER (quality = 0)::BIGINT AS errors, count(*) FILTER (quality = 1)::BIGINT AS run_blocking FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a15_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return validation.severity_counts(found.withColumn("severity", F.when(F.col("quality") == 0, "error").otherwise("run-blocking")), "lang")


@query("SELECT o_custkey AS session, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'running' WHEN bool_and(o_orderstatus = 'F') THEN 'exited' ELSE 'starting' END AS phase FROM orders GROUP BY o_custkey")
def a16_session_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _cases(F.col("o_orderstatus"), {"O": "running", "F": "exited", "P": "starting"})
    return folds.session_phase(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), state.alias("state")), "session", "state")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_partkey LIMIT 30")
def f17_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(text.search(F.col("p_name"), "RE")).orderBy("p_partkey").limit(30).select("p_partkey", "p_name")


@query("""WITH h AS (SELECT s_suppkey, s_nationkey, s_name, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(s_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS f FROM supplier)
SELECT s_suppkey, (42000 + (f % 400) * 20)::BIGINT AS base FROM h""")
def x09_port_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.port_base(F.col("s_name")).cast("bigint").alias("base"))


@query("SELECT s_suppkey, (42000 + s_nationkey * 20 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1)::BIGINT AS port FROM supplier")
def w02_port_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return folds.ports(rows, "s_nationkey", 42000 + F.col("s_nationkey") * 20, "s_name").select("s_suppkey", "port")


@query("SELECT l_suppkey AS supp, (SELECT min(n) FROM range(1, 52) r(n) WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = l.l_suppkey AND x.l_quantity::BIGINT = n))::BIGINT AS next FROM (SELECT DISTINCT l_suppkey FROM lineitem) l")
def w04_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("bigint").alias("n"))
    return folds.next_id(taken, "supp", "n")


@query("SELECT c_custkey AS id, (o IS NULL OR c_acctbal < 0 OR m IS NULL OR m <> 'OK') AS stale FROM (SELECT c_custkey, c_acctbal, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o, CASE WHEN c_mktsegment = 'BUILDING' THEN 'OK' END AS m FROM customer)")
def m18_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("state"))
    rows = table(spark, sf_dir, "customer").join(latest, "c_custkey", "left").select(F.col("c_custkey").alias("id"), "state", (F.col("c_acctbal") < 0).alias("flagged"), F.lit("x").alias("head"), F.lit("x").alias("seen_head"), F.when(F.col("c_mktsegment") == "BUILDING", "OK").alias("patterns"))
    return rows.select("id", folds.stale(rows).alias("stale"))


# --- text ----------------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_full_match(url, 'https://(?:.*/)?en/[^/]*') AS hit FROM pages")
def f10_glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.matches_glob(F.col("url"), "https://**/en/*").alias("hit"))


@query(r"SELECT page_id, regexp_extract(replace(url, '/en/', '/*/'), '^([^*?\[]*/)', 1) AS prefix FROM pages")
def x14_glob_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.glob_prefix(F.replace("url", F.lit("/en/"), F.lit("/*/"))).alias("prefix"))


@query("""SELECT event_id, (s::JSON->>'k')::BIGINT AS k FROM (SELECT event_id, substr(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) AS s FROM (SELECT event_id, 'so: ' || props || ' done' AS t FROM events))""")
def x06_conclude_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("so: "), "props", F.lit(" done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.conclude(said), "$.k").cast("bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '…' ELSE text END AS shown FROM documents")
def x07_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("shown"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'broken ' || user_id WHEN 'click' THEN 'find ' || user_id WHEN 'view' THEN user_id::VARCHAR WHEN 'purchase' THEN 'done' END AS detail FROM events""")
def x08_event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    when = lambda k, v: F.when(kind == k, v)
    payload = F.to_json(F.struct(when("error", F.concat(F.lit("broken "), user)).alias("error"), when("click", F.lit("find")).alias("tool"), when("click", user).alias("input"), F.when(kind.isin("view", "error"), user).alias("value"), when("purchase", F.lit("done")).alias("status")))
    return table(spark, sf_dir, "events").select("event_id", text.event_detail(payload).alias("detail"))


@query("SELECT p_partkey, substr(CASE WHEN regexp_matches(s, '^[a-z]') THEN s ELSE 'project-' || s END, 1, 64) AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def x11_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


_EXTENSIONS = ("py", "tsx", "yml", "md", "bin")


@query("SELECT doc_id, 'f' || doc_id AS stem, CASE length(text) % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'yaml' WHEN 3 THEN 'markdown' ELSE 'plaintext' END AS language FROM documents")
def x13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (F.length("text") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), kinds)
    return table(spark, sf_dir, "documents").select("doc_id", text.stem(path).alias("stem"), text.language(path).alias("language"))


@query("SELECT page_id, replace(replace('~' || url, '~', '~0'), '/', '~1') AS pointer FROM pages")
def x15_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.pointer_escape(F.concat(F.lit("~"), "url")).alias("pointer"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, octet_length(encode(text)) <= 4096 AS fits, sha256(text) AS sha FROM documents")
def x16_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), text.fits_inline(F.col("text"), 4096).alias("fits"), F.sha2("text", 256).alias("sha"))


@query(r"SELECT page_id, regexp_matches(url, '\.ya?ml$') AS graph, url <> '' AND NOT starts_with(url, '/') AND NOT contains(url, '..') AS relative, regexp_matches(split_part(url, '/', 4), '^[a-z][a-z0-9_-]{0,63}$') AS id FROM pages")
def x17_path_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.is_graph_document(u).alias("graph"), text.is_relative_path(u).alias("relative"), text.is_id(F.split_part("url", F.lit("/"), F.lit(4))).alias("id"))


# --- changes ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def m05_remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the orders when customers in debt go."""
    none = F.create_map().cast("map<string,string>").alias("fields")
    customers = table(spark, sf_dir, "customer")
    nodes = customers.select(F.col("c_custkey").alias("id"), F.lit("code").alias("type"), none)
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("flow").alias("kind"), F.lit(None).cast("bigint").alias("src"), F.col("o_custkey").alias("dst"), none)
    layout = nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    gone = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return mutations.remove_nodes(mutations.GraphTables(nodes, edges, layout), gone).edges.select("id")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' END AS state FROM customer")
def m06_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    rows = customers.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("fields"))
    patches = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("segment"), F.lit(None).cast("string"), F.lit("state"), F.lit("debt")).alias("patch"))
    done = mutations.patched(rows, patches)
    return done.select("id", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("name", "segment", "state")])


@query(f"WITH {_TRADE} SELECT CASE WHEN from_type = 'client' THEN src + 100 ELSE src END AS src, CASE WHEN to_type = 'client' THEN dst + 100 ELSE dst END AS dst, count(*)::BIGINT AS edges FROM typed GROUP BY ALL")
def m07_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trade_nodes(spark, sf_dir)
    layout = nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    names = nodes.where("type = 'client'").select("id", (F.col("id") + 100).alias("new_id"))
    done = mutations.renamed(mutations.GraphTables(nodes, trade_edges(spark, sf_dir), layout), names)
    return done.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, c_nationkey::DOUBLE AS y FROM customer")
def m08_set_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    place = lambda x: [F.col("c_custkey").alias("id"), F.lit(x).alias("x"), F.col("c_nationkey").cast("double").alias("y")]
    return mutations.placed(customers.select(*place(0.0)), customers.where("c_acctbal < 0").select(*place(1.0)))


@query("SELECT count(*)::BIGINT AS edges FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus <> 'F'")
def a17_cascade_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("src"), F.col("o_custkey").alias("dst"))
    doomed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return mutations.cascade(edges, doomed, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))).agg(F.count(F.lit(1)).alias("edges"))


@query("WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'removeNode' AS op, c_custkey AS id FROM g UNION ALL SELECT 'removeEdge', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM g)")
def m21_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("src"), F.col("o_custkey").alias("dst"))
    doomed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return mutations.delete_plan(edges, doomed, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


# --- contracts and agents ----------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS given FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(['system', 'user'], lambda x: NOT list_contains(given, x)), ',') AS missing, array_to_string(list_filter(given, lambda x: NOT list_contains(['system', 'user'], x)), ',') AS unexpected,
CASE WHEN list_contains(given, 'system') AND list_contains(given, 'user') AND len(given) = 2 THEN NULL ELSE 'call to chat does not match its contract: ' || concat_ws('; ', CASE WHEN NOT (list_contains(given, 'system') AND list_contains(given, 'user')) THEN 'missing ' || array_to_string(list_filter(['system', 'user'], lambda x: NOT list_contains(given, x)), ', ') END, CASE WHEN list_contains(given, 'assistant') THEN 'unexpected assistant' END) END AS complaint FROM a""")
def e07_tool_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's roles as the argument names of a call that wants a system and a user."""
    calls = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("given"))
    wanted = F.array(F.lit("system"), F.lit("user"))
    complaint = contracts.argument_complaint(F.lit("chat"), F.col("given"), wanted, wanted, F.lit(True))
    return calls.select("conv_id", F.array_join(F.array_except(wanted, "given"), ",").alias("missing"), F.array_join(F.array_except("given", wanted), ",").alias("unexpected"), complaint.alias("complaint"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant')::BIGINT AS turns, count(*) FILTER (role = 'assistant') > 2 AS over FROM conversations GROUP BY conv_id")
def e08_turn_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent with three turns, whose client calls a tool as often as the conversation has answers."""

    async def client(messages: list, tools: list) -> agents.Reply:
        answered = sum(m["role"] == "assistant" for m in messages)
        return agents.Reply(calls=((str(answered), "echo", {}),)) if answered < int(messages[1]["content"]) else agents.Reply("done")

    turns = F.count_if(F.col("role") == "assistant")
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("input"))
    graph = Graph((Node("in", "io", {"direction": "in"}), Node("bot", "agent", {"ref": "bot"}), Node("out", "io", {"direction": "out"})), (Edge("a", "flow", "in", "bot"), Edge("b", "flow", "bot", "out")))
    bot = Step(batch=agents.in_lockstep(agents.awaited(client), "answer", [agents.Tool("echo", lambda given: given)], most_turns=3), returns="string", deterministic=False)
    done = compile_graph(runs, "g", {"g": graph}, {}, {"bot": bot}).result("conv_id", "input")
    return done.select("conv_id", F.col("input").alias("turns"), F.col("failed").isNotNull().alias("over"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as Python files: a step with a typed argument, some with a second public function, some broken."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("str", "int", "list[str]", "Optional[float]", "dict[str, Any]")]), F.col("n_regionkey") + 1)
    body = F.format_string('"""Step %s."""\ndef handle_%d(value: %s, *, extra: bool = False) -> %s:\n    return value\n', "n_name", "n_nationkey", kind, kind)
    second = F.when(F.col("n_nationkey") > 20, "def other(x):\n    return x\n").otherwise("")
    broken = F.when(F.col("n_nationkey") == 3, "def (\n").otherwise("")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("steps/"), "n_name", F.lit(".py")).alias("path"), F.concat(body, second, broken).alias("content"), "n_nationkey")


_E03 = """WITH n AS (SELECT *, ['str', 'int', 'list[str]', 'Optional[float]', 'dict[str, Any]'][n_regionkey + 1] AS t,
['{"type": "string"}', '{"type": "integer"}', '{"type": "array", "items": {"type": "string"}}', '{"anyOf": [{"type": "number"}, {"type": "null"}]}', '{"type": "object"}'][n_regionkey + 1] AS s FROM nation)
SELECT 'steps/' || n_name || '.py' AS path, CASE WHEN n_nationkey = 3 OR n_nationkey > 20 THEN NULL ELSE 'handle_' || n_nationkey END AS name,
CASE WHEN n_nationkey = 3 OR n_nationkey > 20 THEN NULL ELSE '{"name": "handle_' || n_nationkey || '", "description": "Step ' || n_name || '.", "isAsync": false, "inputs": [{"name": "value", "type": "' || t || '", "schema": ' || s || ', "required": true}, {"name": "extra", "type": "bool", "schema": {"type": "boolean"}, "required": false}], "output": {"type": "' || t || '", "schema": ' || s || '}}' END AS contract,
CASE WHEN n_nationkey = 3 THEN 'line 4 is not Python: invalid syntax' WHEN n_nationkey > 20 THEN '2 public functions and no handler: handle_' || n_nationkey || ' other' END AS error FROM n"""


@query(_E03)
def e03_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.discover(_sources(spark, sf_dir))


@query("""WITH f AS (SELECT 'e' || n_regionkey AS emission, n_name || '.py' AS path, n_nationkey % 3 AS k, n_nationkey FROM nation)
SELECT emission, path, CASE k WHEN 0 THEN 'vendor module openai' ELSE 'run() branches' END AS issue FROM f WHERE k < 2
UNION ALL SELECT emission, path, 'path belongs to the project' FROM f WHERE path LIKE '%1.py'
UNION ALL SELECT 'e' || r_regionkey, NULL, 'no file serves the api boundary' FROM region
UNION ALL SELECT emission, NULL, '6 graphs, ' || count(*) FILTER (k > 0) || ' files with run()' FROM f GROUP BY emission HAVING count(*) FILTER (k > 0) < 6""")
def e12_emission_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as one emission; some import a vendor's module or branch in run()."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    content = F.when(key % 3 == 0, "import openai\n").when(key % 3 == 1, "def run(x):\n    if x:\n        return x\n").otherwise("def run(x):\n    return x\n")
    files = nation.select(F.concat(F.lit("e"), F.col("n_regionkey").cast("string")).alias("emission"), F.concat("n_name", F.lit(".py")).alias("path"), content.alias("content"), F.lit("orchestration").alias("role"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("e"), F.col("r_regionkey").cast("string")).alias("emission"))
    documents = regions.select("emission", F.lit("app.yaml").alias("path"), F.lit("nodes:\n  - { boundary: api }\n").alias("content"))
    six = regions.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    documents = documents.unionByName(six.select("emission", F.format_string("graphs/%d.yaml", "k").alias("path"), F.lit("nodes: []\n").alias("content")))
    context = files.where(F.col("path").endswith("1.py")).select("emission", "path")
    return emissions.emission_issues(files, documents, context)


# --- projects, runs, sessions ------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS session, c_name AS user FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1995-06-01'")
def j01_touch_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("user"))
    now = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    return projects.touch(sessions, users, now, now).select("session", "user")


@query("SELECT l_orderkey AS graph, l_suppkey AS ref, min(l_linenumber)::INT AS line FROM lineitem GROUP BY ALL")
def j15_first_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_suppkey").alias("ref"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("ord"))
    return projects.first_by(rows, ["graph", "ref"], "ord")


@query("SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS opened FROM customer")
def j18_already_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return projects.flagged(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), opened, "id", "opened")


_OLD_PROJECTS = "SELECT c_nationkey::BIGINT AS owner_id, 'local' AS kind, c_mktsegment AS key, min(c_custkey) AS id, 'old' AS name, NULL AS head FROM customer GROUP BY ALL"


@query(f"WITH o AS ({_OLD_PROJECTS}), n AS (SELECT s_nationkey::BIGINT AS owner_id, 'local' AS kind, 'BUILDING' AS key, min(s_suppkey) AS id, 'new' AS name, 'h' AS head FROM supplier GROUP BY ALL) SELECT owner_id, kind, key, COALESCE(o.id, n.id) AS id, COALESCE(n.name, o.name) AS name, COALESCE(n.head, o.head) AS head FROM o FULL JOIN n USING (owner_id, kind, key)")
def m13_upsert_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("owner_id"), F.lit("local").alias("kind"), F.col("c_mktsegment").alias("key")).agg(F.min("c_custkey").alias("id"))
    new = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("owner_id")).agg(F.min("s_suppkey").alias("id")).select("owner_id", F.lit("local").alias("kind"), F.lit("BUILDING").alias("key"), "id", F.lit("new").alias("name"), F.lit("h").alias("head"), F.lit(2).alias("created_at"))
    old = old.select("owner_id", "kind", "key", "id", F.lit("old").alias("name"), F.lit(None).cast("string").alias("head"), F.lit(1).alias("created_at"))
    return projects.upsert_projects(old, new).drop("created_at")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'cancelled' ELSE CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'finished' END END AS status FROM orders")
def m16_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    runs = orders.select(F.col("o_orderkey").alias("id"), _cases(F.col("o_orderstatus"), {"O": "queued", "P": "running", "F": "finished"}).alias("status"))
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return projects.cancel(runs, orders.join(debtors, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id")))


@query("SELECT o_orderkey AS id, o_custkey AS owner_id, 'queued' AS status, sha256('t' || o_orderkey) AS token_hash FROM orders")
def m17_new_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.lit("g").alias("graph"))
    runs, _ = projects.new_runs(asked, F.concat(F.lit("t"), F.col("id").cast("string")))
    return runs.drop("graph")


@query("SELECT DISTINCT lang || '/' || source AS path FROM documents")
def u05_emitted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all memo rows, each row a map of path to content."""
    memo = table(spark, sf_dir, "documents").select(F.create_map(F.concat_ws("/", "lang", "source"), F.lit("x")).alias("files"))
    return overlay.emitted(memo, "files")


@query("SELECT p_partkey AS id, p_brand AS a, CASE WHEN p_size > 10 THEN p_type ELSE p_name END AS b FROM part")
def u08_file_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_name"))
    right = F.when(F.col("p_size") > 10, F.create_map(F.lit("b"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>"))
    done = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), projects.merged_files(left, right).alias("m"))
    return done.select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("""WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END || lang AS path, CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'odd' ELSE 'add' END AS kind FROM labels JOIN documents USING (doc_id)),
r AS (SELECT path, unnest(list_concat(CASE WHEN kind = 'odd' THEN ['kind'] ELSE [] END, CASE WHEN kind = 'delete' THEN ['delete has no content'] ELSE [] END, CASE WHEN path LIKE '/%' THEN ['relative path'] ELSE [] END)) AS rule FROM p) SELECT rule, count(*)::BIGINT AS n FROM r GROUP BY rule""")
def f12_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as changes, half of them with an absolute path, all of them with content."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    kind = F.when(F.col("quality") == 0, "delete").when(F.col("toxic") == 1, "odd").otherwise("add")
    changes = rows.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "/").otherwise(""), "lang").alias("path"), kind.alias("kind"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("from_path"))
    return overlay.violations(changes).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT array_to_string(list_sort([o_orderpriority, o_orderstatus, c_mktsegment]), ',') AS nodes, min(array_to_string([o_orderpriority, o_orderstatus, c_mktsegment], ',')) AS path FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a11_cycle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a cycle of three names; of cycles with the same names one is reported."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    found = folds.distinct_cycles(orders.select(F.array("o_orderpriority", "o_orderstatus", "c_mktsegment").alias("path")), "path")
    return found.select(F.array_join(F.array_sort("path"), ",").alias("nodes"), F.array_join("path", ",").alias("path"))


@query("SELECT emission, path, CASE WHEN nth > 1 THEN 'path is there already' WHEN role NOT IN ('agent', 'orchestration', 'boundary-server', 'other') THEN 'unknown role ' || role END AS issue FROM (SELECT l_orderkey::VARCHAR AS emission, l_linenumber::VARCHAR AS path, CASE WHEN l_returnflag = 'R' THEN 'odd' ELSE 'agent' END AS role, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem) WHERE nth > 1 OR role = 'odd'")
def e13_emission_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as emitted entries; returned ones carry a role that is not known."""
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(F.col("l_orderkey").cast("string").alias("emission"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"), F.col("l_linenumber").cast("string").alias("path"), F.lit("x").alias("content"), F.when(F.col("l_returnflag") == "R", "odd").otherwise("agent").alias("role"))
    return emissions.parsed(entries)[1]


from loomgraph import catalogue_more  # noqa: E402, F401  registers its queries here
