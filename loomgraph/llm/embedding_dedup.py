"""Embedding near-duplicates by sorted projection passes.

Vectors are taken relative to their label's mean, so that the projections part what crowds about it.  Each
pass gives a vector the signs of random projections, read as one number; vectors of a label are put in the
order of that number, so that near vectors come to stand near one another, and each is compared with the
WINDOW vectors before it.  Verified pairs of all passes are united to components.  Within a component all
pairs are then compared exactly, block by block, so that no link is lost to the window where vectors
crowd; only counts of links leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, components, join_labels, written

LEAST_COSINE = 0.98
#: Passes for labels of up to PASSES_FOR vectors; the number grows with the fourth root of a label's vectors
#: over one less their mean cosine, as crowded vectors are harder to part.
PASSES = 12
PASSES_FOR = 100_000
BITS = 32
WINDOW = 256
#: Vectors of a component in one block of exact comparison, and rows of a block that are compared at a time.
BLOCK = 4096
STEP = 512
#: Rows of the sorted passes in one partition: far more than a window, and bounded.
LEAST_ROWS, MOST_ROWS = 8 * WINDOW, 500_000
SEED = 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def projections(dim: int, nth: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, nth, dim]).standard_normal((dim, bits))


def order_keys(x: np.ndarray, nth: int) -> np.ndarray:
    """The concatenated signs of the pass's projections of x, first one first."""
    signs = (x @ projections(x.shape[1], nth) > 0).astype(np.int64)
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _packed(element: str) -> object:
    """Vectors to their bytes; null for one that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                v = v.as_py()
                x = np.array(v, dtype=element) if v and None not in v else None
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("label"), pa.array(out, pa.binary())], names=["i", "label", "v"])

    return run


def _matrix(column: pa.Array, element: str) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=element).astype(np.float64).reshape(len(column), -1)


def _sums(element: str) -> object:
    """Vectors to the sums of their unit vectors, by group and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            for g in np.unique(grp):
                own = batch.filter(pa.array(grp == g))
                total = unit(_matrix(own.column("v"), element)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), g)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), len(own)))], names=["grp", "place", "total", "n"])

    return run


def _keyed(element: str, passes: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                mean = np.stack(own.column("mean").to_numpy(zero_copy_only=False))
                x = unit(_matrix(own.column("v"), element)) - mean
                for nth in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), nth, np.int32)), own.column("grp"), pa.array(order_keys(x, nth)), own.column("node"), own.column("v")], names=["nth", "grp", "key", "node", "v"])

    return run


def _near(nth: np.ndarray, grp: np.ndarray, node: np.ndarray, x: np.ndarray, since: int, least: float, window: int) -> tuple[list[int], list[int]]:
    """A spanning star of the verified links between each row from `since` on and the window before it."""
    u, v = [], []
    run = np.cumsum(np.concatenate(([0], (np.diff(nth) != 0) | (np.diff(grp) != 0))))
    for at in range(since, len(node), window):
        low, end = max(0, at - window), min(at + window, len(node))
        rows, cols = np.arange(at, end), np.arange(low, end)
        lag = rows[:, None] - cols
        near = (x[at:end] @ x[low:end].T >= least) & (lag > 0) & (lag <= window) & (run[rows, None] == run[cols])
        i, j = np.nonzero(near)
        u.append(i + at)
        v.append(j + low)
    labels = np.arange(len(node))
    if u:
        join_labels(labels, np.concatenate(u), np.concatenate(v))
    away = np.flatnonzero(labels != np.arange(len(node)))
    return node[labels[away]].tolist(), node[away].tolist()


def _parts(batches: Iterator[pa.RecordBatch], element: str) -> Iterator[tuple]:
    """(nth, grp, node, unit vectors, bytes) of runs of rows with vectors of one length."""
    for batch in batches:
        v = batch.column("v").to_pylist()
        sizes = np.array([len(b) for b in v])
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(sizes)) + 1, [len(v)])).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                yield part.column("nth").to_numpy(), part.column("grp").to_numpy(), part.column("node").to_numpy(), unit(_matrix(part.column("v"), element)), v[a:b]


def _sweep(element: str, least: float, window: int) -> object:
    """Sorted rows to links (side 0), and the rows at both ends of the partition (side 1: first, 2: last) for what crosses its border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["side", "place", "a", "b", "nth", "grp", "v"]

        def edge(side: int, where: int, rows: list[tuple]) -> pa.RecordBatch:
            n = len(rows)
            cols = [[side] * n, [where] * n, [r[2] for r in rows], list(range(n)), [r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        head: list[tuple] = []
        tail: list[tuple] = []
        kept = None
        for nth, grp, node, x, raw in _parts(batches, element):
            rows = list(zip(nth.tolist(), grp.tolist(), node.tolist(), raw, strict=True))
            head += rows[: max(0, window - len(head))]
            tail = [*tail, *rows[-window:]][-window:]
            since = 0
            if kept is not None and kept[3].shape[1] == x.shape[1]:
                since = len(kept[2])
                nth, grp, node, x = (np.concatenate([o, n]) for o, n in zip(kept, (nth, grp, node, x), strict=True))
            a, b = _near(nth, grp, node, x, since, least, window)
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[0] * n, [0] * n, a, b, [0] * n, [0] * n, [None] * n], kinds, strict=True)], names=names)
            kept = (nth[-window:], grp[-window:], node[-window:], x[-window:])
        if head:
            yield edge(1, place, head)
            yield edge(2, place + 1, tail)

    return run


def _border(element: str, least: float, window: int) -> object:
    """The last rows of a partition and the first of the next to their links; at most two windows of rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "descending"), ("b", "ascending")])
        a: list[int] = []
        b: list[int] = []
        if len(set(table.column("side").to_pylist())) == 2:
            v = table.column("v").to_pylist()
            last = table.column("side").to_numpy() == 2
            size = len(v[int(last.sum()) - 1])
            own = np.array([len(x) == size for x in v])
            part = table.filter(pa.array(own))
            x = unit(_matrix(part.column("v").combine_chunks(), element))
            a, b = _near(part.column("nth").to_numpy(), part.column("grp").to_numpy(), part.column("a").to_numpy(), x, 0, least, window)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _count(element: str, least: float) -> object:
    """Rows sorted by (root, i, j) to (node, links): exact comparison of block i with block j of a component."""

    def links(rows: pa.Table, i: int, j: int) -> pa.RecordBatch:
        block, node, copies = (rows.column(c).to_numpy() for c in ("block", "node", "copies"))
        x = unit(_matrix(rows.column("v").combine_chunks(), element))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        count = np.zeros(len(node), np.int64)
        for at in range(0, len(left), STEP):
            own = left[at : at + STEP]
            near = x[own] @ x[right].T >= least
            if i == j:
                near &= own[:, None] != right
            count[own] += near @ copies[right]
            if i != j:
                count[right] += copies[own] @ near
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(count.astype(np.int64))], names=["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("root", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1 if len(batch) else []
            ends = np.concatenate(([0], cuts, [len(batch)])).astype(int)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b == a:
                    continue
                key = tuple(int(k[a]) for k in keys)
                if waiting and key != now:
                    yield links(pa.Table.from_batches(waiting), *now[1:])
                    waiting = []
                now = key
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield links(pa.Table.from_batches(waiting), *now[1:])

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors link if their labels and lengths are equal, the label is not null, and their cosine in double
    precision is least or more.  A vector that is null, empty, zero, or holds a null or non-finite
    component has no link and is its own component.  Repeated rows are vectors of their own and link; a
    null id is never a component's smallest unless there is no other.  Equal vectors travel as one.

    passes: how many; by default PASSES, and more for large or crowded labels.
    """
    bounded_batches(vectors.sparkSession)
    element = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    wide = F.col(vector_col) if element == "<f4" else F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), wide.alias("v"))
    kind = given.schema["i"].dataType.simpleString()
    rows = given.mapInArrow(_packed(element), f"i {kind}, label {given.schema['label'].dataType.simpleString()}, v binary")
    rows = written(rows.withColumn("v", F.when(F.col("label").isNotNull(), F.col("v"))), "vectors")
    distinct = rows.where("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("i").alias("low"))
    groups = F.xxhash64("label", F.octet_length("v"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("grp", groups).withColumn("dim", F.octet_length("v")), "nodes")

    spark = vectors.sparkSession
    sums = nodes.select("grp", "v").mapInArrow(_sums(element), "grp bigint, place int, total double, n bigint").groupBy("grp", "place").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    means = written(sums.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("mean"), F.max("n").alias("n")), "means")
    spread = F.greatest(1 - F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x), F.lit(0.01))
    crowd, total = means.agg(F.coalesce(F.max(F.col("n") / spread), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    passes = passes or max(PASSES, math.ceil(PASSES * (crowd / PASSES_FOR) ** 0.25))
    keyed = nodes.join(means.select("grp", "mean"), "grp").select("node", "grp", "dim", "v", "mean").mapInArrow(_keyed(element, passes), "nth int, grp bigint, key bigint, node bigint, v binary")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, total * passes // LEAST_ROWS))
    parts = max(parts, -(-total * passes // MOST_ROWS), 1)
    order = ["nth", "grp", "key", "node"]
    swept = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep(element, least, window), "side int, place int, a bigint, b bigint, nth int, grp bigint, v binary")
    swept = written(swept, "sweeps")
    across = swept.where("side > 0").groupBy("place").applyInArrow(_border(element, least, window), "a bigint, b bigint")
    found = components(swept.where("side = 0").select("a", "b").union(across))

    roots = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = nodes.join(found.union(roots), "node").select("root", "node", "copies", "low", "v")
    members = written(members, "members")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("low").alias("component"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "v")
    counted = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(_count(element, least), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    named = members.join(sizes, "root").select("node", "component")
    known = nodes.join(counted, "node", "left").join(named, "node", "left").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "low").alias("component"))
    met = rows.join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("w").isNull(), F.col("i")).otherwise(F.col("component"))
    return met.select(F.col("i").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("i").eqNullSafe(component).alias("kept"))
