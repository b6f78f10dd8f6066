"""SimHash near-duplicates of a Jaccard similarity: anchor-point covering, then exact comparison.

Texts of Jaccard similarity 0.8 differ in 0.15 of a plain SimHash's bits, far more than a covering of
moderate radius reaches.  So a text gets BLOCKS further fingerprints of 32 bits, each the SimHash of
SAMPLE of its shingles, those of the least hashes under the block's own seed: two texts sample alike with
a probability of about similarity ** SAMPLE, and then their bits are equal.  Of a block, the codewords of
the Hamming (31, 26) code with the 32nd bit are the anchors; a fingerprint goes to the anchor that covers
it.  At an anchor, all texts are compared by size and by their plain 64-bit SimHash, and those that may be
similar are tied together; only a spanning forest of the ties leaves the task.  What ties connect is a
family, and in a family all pairs are compared on their whole shingle sets, by matrix products, block by
block.  Anchors and families of any size are dealt to pairs of blocks, so that every pair meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, components, join_labels, text_hash, written
from loomgraph.llm.simhash import covering_anchor, only_rows, row_rank, words_of

SHINGLE = 5
LEAST = 0.8
BLOCKS = 12
SAMPLE = 5
#: Bits of 64 in which the plain fingerprints of a proposed pair differ at most: at similarity 0.8 the mean is 9.7, the deviation 2.9.
MOST_BITS = 20
#: Texts at an anchor that one task compares; of more, each pair of blocks is a task's work.
MOST_AT_ANCHOR = 20_000
#: Texts, and bytes of shingle sets, in one block of a family.
FAMILY_BLOCK, FAMILY_BYTES = 1024, 4 << 20
#: Columns of the matrix products at a time.
COLUMNS = 2048
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BLOCKS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def _majority(h: np.ndarray) -> np.ndarray:
    """SimHash of each row of hashes, over the last axis."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(*h.shape, 8), axis=-1, bitorder="little")
    over = 2 * bits.sum(axis=-2, dtype=np.int32) > h.shape[-1]
    return np.packbits(over, axis=-1, bitorder="little").view("<u8")[..., 0]


def blocks_of(shingles: np.ndarray) -> np.ndarray:
    """The 32-bit fingerprints of the blocks."""
    if not len(shingles):
        return np.zeros(BLOCKS, np.uint64)
    ranks = _mixed(shingles[None, :] ^ _SEEDS[:, None])
    n = min(SAMPLE, len(shingles))
    return _majority(_mixed(np.partition(ranks, n - 1, axis=1)[:, :n] + np.uint64(1))) & np.uint64(0xFFFFFFFF)


def _prints(shingle: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim, size, anchors = [], [], []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), shingle)
                sim.append(int(_majority(own[None, :])[0]) if len(own) else 0)
                size.append(len(own))
                anchors.append(covering_anchor(blocks_of(own)).view(np.int64).tolist())
            plain = pa.array(np.array(sim, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "h", "m")], plain, pa.array(size, pa.int32()), pa.array(anchors, pa.list_(pa.int64()))], names=["id", "h", "m", "sim", "n", "anchors"])

    return run


def ties(sim: np.ndarray, n: np.ndarray, side: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (i, j) of an anchor's texts that may be similar.

    side: 0 where all texts are compared with all; else those of side 1 are compared with those of side 2.
    """
    rows, cols = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(sim)),) * 2
    labels = np.arange(len(sim))
    step = max(1, 400_000 // max(1, len(cols)))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        small, large = np.minimum(n[own, None], n[cols]), np.maximum(n[own, None], n[cols])
        near = (np.bitwise_count(sim[own, None] ^ sim[cols]) <= MOST_BITS) & (small >= least * large)
        i, j = np.nonzero(near)
        join_labels(labels, own[i], cols[j])
    away = np.flatnonzero(labels != np.arange(len(sim)))
    return labels[away], away


def _tied(least: float) -> object:
    """Rows sorted by anchor to ties of nodes."""

    def pairs(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, side, node, sim, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(anchor)])).tolist(), strict=True):
            if e - s > 1:
                i, j = ties(sim[s:e].view(np.uint64), n[s:e], side[s:e], least)
                a.append(node[s:e][i])
                b.append(node[s:e][j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = tuple(batch.column(c).to_numpy() for c in ("anchor", "side", "node", "sim", "n"))
            if not len(batch):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if last:
                yield pairs([*waiting, tuple(r[:last] for r in rows)])
                waiting = []
            elif waiting and waiting[-1][0][-1] != rows[0][0]:
                yield pairs(waiting)
                waiting = []
            waiting.append(tuple(r[last:].copy() for r in rows))
        if waiting:
            yield pairs(waiting)

    return run


def in_block_pairs(rows: DataFrame, blocks: str, node: str = "node") -> DataFrame:
    """rows with i, j and side: a key's rows dealt to `blocks` blocks, once for each pair of blocks they are in.

    side is 0 for a block with itself, else 1 for rows of the pair's first block and 2 for those of its second.
    """
    part = rows.withColumn("part", F.pmod(F.xxhash64(node), F.col(blocks)))
    met = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return met.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": side}).drop("part", "other", blocks)


def _spread(nodes: DataFrame, most: int) -> DataFrame:
    """(anchor, side, node, sim, n); an anchor with over `most` nodes becomes one for each pair of its blocks."""
    every = nodes.select("node", "sim", "n", F.posexplode("anchors").alias("block", "at")).withColumn("anchor", F.xxhash64("block", "at"))
    every = written(every.select("anchor", "node", "sim", "n"), "anchors")
    crowded = written(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("anchor", F.ceil(F.col("c") / most).alias("blocks")), "crowded-anchors")
    plain = every.join(crowded, "anchor", "left_anti").select("anchor", F.lit(0).alias("side"), "node", "sim", "n")
    met = in_block_pairs(every.join(crowded, "anchor"), "blocks")
    return plain.unionByName(met.select(F.xxhash64("anchor", "i", "j").alias("anchor"), "side", "node", "sim", "n"))


def _sets(shingle: int) -> object:
    """Texts to their shingle sets as sorted 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.unique(shingle_set(t.as_py(), shingle).astype(np.uint32)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(packed, pa.binary())], names=["node", "root", "grams"])

    return run


def links_of(sets: list[np.ndarray], side: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (i, j) of shingle sets with the similarity; two empty sets have it.

    Sides are those of ties().  Common shingles are counted by products of 0-1 matrices, COLUMNS shingles at a time.
    """
    rows, cols = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(sets)),) * 2
    size = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    common = times[column] > 1
    owner, column = owner[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(rows), len(cols)))
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        s, e = np.searchsorted(column, [at, at + COLUMNS])
        hit = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        hit[owner[s:e], column[s:e] - at] = 1
        both += hit[rows] @ hit[cols].T
    i, j = np.nonzero(both >= least * (size[rows, None] + size[cols] - both))
    labels = np.arange(len(sets))
    join_labels(labels, rows[i], cols[j])
    away = np.flatnonzero(labels != np.arange(len(sets)))
    return labels[away], away


def _linked(least: float) -> object:
    """Rows sorted by (root, i, j) to the links of each such group."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        a, b = links_of([np.frombuffer(r[1], np.uint32) for r in rows], np.array([r[2] for r in rows]), least)
        return [rows[k][0] for k in a.tolist()], [rows[k][0] for k in b.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, []
        for batch in batches:
            a, b = [], []
            for root, i, j, *row in zip(*[batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "grams", "side")], strict=True):
                if (root, i, j) != key and waiting:
                    x, y = links(waiting)
                    a += x
                    b += y
                    waiting = []
                key = (root, i, j)
                waiting.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if waiting:
            a, b = links(waiting)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, most_at_anchor: int = MOST_AT_ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(rows, lows): rows (id, h, m) of docs, by text m; lows (m, low) with the least (n, id, h) of the text's group."""
    bounded_batches(docs.sparkSession, 4)
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.unhex(F.md5(text)).alias("m"), text.cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    prints = written(given.mapInArrow(_prints(shingle), f"id {kind}, h bigint, m binary, sim bigint, n int, anchors array<bigint>"), "prints")
    nodes = prints.groupBy("m").agg(F.min(row_rank()).alias("low"), F.min("sim").alias("sim"), F.min("n").alias("n"), F.min("anchors").alias("anchors"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")

    at_anchors = _spread(nodes, most_at_anchor).repartition("anchor").sortWithinPartitions("anchor", "node")
    tied = components(at_anchors.mapInArrow(_tied(least), "a bigint, b bigint"))
    families = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    wanted = families.join(nodes.select("node", "low"), "node").select("node", "root", F.col("low.id").alias("wid"), F.col("low.h").alias("wh"))
    found = given.select("id", "h", "text").join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh"))).select("node", "root", "text")
    sets = written(found.mapInArrow(_sets(shingle), "node bigint, root bigint, grams binary").groupBy("node", "root").agg(F.min("grams").alias("grams")), "shingle-sets")
    sizes = sets.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / FAMILY_BLOCK, F.sum(F.octet_length("grams")) / FAMILY_BYTES, F.lit(1.0))).alias("blocks"))
    meeting = in_block_pairs(sets.join(sizes, "root"), "blocks").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    links = meeting.select("root", "i", "j", "node", "grams", "side").mapInArrow(_linked(least), "a bigint, b bigint")
    grouped = nodes.join(components(links), "node", "left").select("m", "low", F.coalesce("root", "node").alias("root"))
    grouped = written(grouped, "groups")
    lows = grouped.groupBy("root").agg(F.min("low").alias("first"))
    return prints.select("id", "h", "m"), grouped.join(lows, "root").select("m", F.col("first").alias("low"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """One row per row of docs: id, component_id, the least id of the texts that verified links reach.

    Texts link at a Jaccard similarity of their sets of word shingles of `least` or more; equal texts are
    one.  Null and empty texts have no shingle and are alike.  Null ids are the largest.  Repeated rows
    each get their row; further columns are not read; an empty table gives an empty result.
    """
    rows, lows = similar_groups(docs, id_col, text_col, **settings)
    return rows.join(lows, "m").select(F.col("id").alias(id_col), F.col("low.id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest id stays, once.

    Ties on the id are broken by the text's hash; of rows equal in both, one stays.  The columns are those of docs.
    """
    _, lows = similar_groups(docs, id_col, text_col, **settings)
    return only_rows(docs, lows.select("low"), id_col, text_col)
