"""Helpers shared by the training-data operators: lineage cuts, row keys, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import checkpointed, shared_dir


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches of at most so many MB in this session: what a Python worker holds of the texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def written(df: DataFrame, name: str) -> DataFrame:
    """Large intermediate: a compressed Parquet table in the shared folder, read back column by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefixed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_hash(column: str) -> Column:
    """64 bits of a text; a null counts as the empty text.  Used beside the id, never alone, as a row key."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """One round of large-star then small-star on edges (a, b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of the graph with edges (a long, b long).

    Returns (node, root) for each node that has an edge to another, the root itself left out; root is
    the component's smallest node.  Alternating large-star and small-star rounds: each one is joins and
    aggregates that are linear in the edges, and its result is checkpointed.
    """
    spark = edges.sparkSession
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if new == mark or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, now = new, checkpointed(star(spark, now))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def join_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merges, in place, the groups that the links u[i] - v[i] connect; labels[i] is the smallest index of i's group."""
    while True:
        a, b = labels[u], labels[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped
