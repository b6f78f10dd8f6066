"""An example graph: tidy a letter, sort it, and file it in a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import collapse, normalize, related_ids, word_count
from loomgraph.plans.compile import Compiled, Step, compile_graph
from loomgraph.plans.graph import Edge, Graph, Node

POST, FILING = "graphs/post.yaml", "graphs/filing.yaml"


def _chain(*names: str) -> tuple[Edge, ...]:
    return tuple(Edge(f"{a}-{b}", "flow", a, b) for a, b in zip(names, names[1:], strict=False))


GRAPHS = {
    POST: Graph(
        (Node("letter", "io", {"direction": "in"}), Node("tidy", "code", {"entrypoint": "tidy"}), Node("sorter", "agent", {"ref": "sorter"}), Node("filing", "subgraph", {"ref": FILING}), Node("ledger", "io", {"direction": "out"}), Node("lexicon", "code"), Node("trace", "io", {"direction": "out"})),
        (*_chain("letter", "tidy", "sorter", "filing", "ledger"), Edge("looks-up", "capability", "sorter", "lexicon", "define")),
    ),
    FILING: Graph((Node("sorted", "io", {"direction": "in"}), Node("shelve", "code", {"entrypoint": "shelve"}), Node("filed", "io", {"direction": "out"})), _chain("sorted", "shelve", "filed")),
}


def normalize_step(document: Column, unicode: bool = True) -> Column:
    body = (normalize if unicode else collapse)(document["body"])
    return F.struct(document["id"].alias("id"), body.alias("body"), word_count(body).alias("word_count"))


def classify_stub(document: Column) -> Column:
    """A fixed rule in place of a model: by words and marks of the text."""
    body, n = F.lower(document["body"]), document["word_count"]
    category = F.when(body.contains("licen"), "contract").when(body.contains("@"), "correspondence").when(body.contains("$"), "invoice").otherwise("other")
    return F.struct(document["id"].alias("id"), category.alias("category"), F.when(n > 100, 0.9).otherwise(0.5).alias("confidence"))


def enrich_step(record: Column) -> Column:
    return F.struct(record["id"].alias("id"), record["category"].alias("category"), record["confidence"].alias("confidence"), related_ids(record["category"]).alias("related"))


def classify(documents: DataFrame, unicode: bool = True) -> Compiled:
    """documents (doc_id, text) as runs of the example graph."""
    runs = documents.select("doc_id", F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")).alias("input"))
    steps = {"tidy": Step(native=lambda c: normalize_step(c, unicode)), "shelve": Step(native=enrich_step)}
    return compile_graph(runs, POST, GRAPHS, steps, {"sorter": Step(native=classify_stub)})
