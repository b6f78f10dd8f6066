"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two halves of 32 bits.  Two fingerprints at distance 3 or less have a half at
distance 1 or less.  The anchors of a half are the codewords of the perfect Hamming (31, 26) code with
the 32nd bit as it is: covering radius 1.  A fingerprint goes to every anchor within covering radius
plus threshold, 1 + 1 = 2, of each half: up to 34 anchors out of 2 x 2^27.  If x and y have a half at
distance 1, x's nearest anchor is within 1 of x, so within 2 of y: both are there, and are compared.

Only distinct fingerprints travel.  Each anchor's fingerprints are compared in one pass over rows
sorted by anchor; an anchor emits a spanning star for each group of linked fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, components, join_labels, text_hash, written

THRESHOLD = 3
#: A-Z to a-z, the white space \x09-\x0D to a space, all else as it is.
_FOLD = bytes(0x20 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE = np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is set if over half of the shingles' XXH64 values have it; no words: 0."""
    words = words_of(text)
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, dtype=np.int64)
    pairs = list(zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    for at in range(0, len(pairs), 1 << 16):
        h = np.array([digest(whole[a:b], 42) for a, b in pairs[at : at + (1 << 16)]], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > len(pairs)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], names=["id", "h", "fp"])


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the bits to flip to reach each codeword within 2; unused places are False in the mask."""
    flips, used = np.zeros((32, 16), dtype=np.uint64), np.zeros((32, 16), dtype=bool)
    used[:, 0] = True
    for s in range(1, 32):
        flips[s, 0] = 1 << (s - 1)
        pairs = [(p, p ^ s) for p in range(1, 32) if p < p ^ s]
        for k, (p, q) in enumerate(pairs, 1):
            flips[s, k] = (1 << (p - 1)) | (1 << (q - 1))
            used[s, k] = True
    return flips, used


_FLIPS, _USED = _flips()
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(x.shape, dtype=np.int64)
    for j, mask in enumerate(_CHECKS):
        s |= (np.bitwise_count(x & np.uint64(mask)).astype(np.int64) & 1) << j
    return s


def covering_anchor(x: np.ndarray) -> np.ndarray:
    """The anchor within 1 of each uint64 value of 32 bits: the codeword nearest to it."""
    return x ^ _FLIPS[_syndrome(x), 0]


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within 2 of each half of the uint64 fingerprints."""
    rows, anchors = [], []
    for half in (0, 1):
        x = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        s = _syndrome(x)
        near = x[:, None] ^ _FLIPS[s]
        row, at = np.nonzero(_USED[s])
        home = near[:, 0] ^ np.uint64(1 << 31)
        tag = np.uint64(half << 32)
        rows += [row, np.arange(len(fp))]
        anchors += [near[row, at] | tag, home | tag]
    return np.concatenate(rows), np.concatenate(anchors)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for at in range(0, len(fp), 20_000):
            part = fp[at : at + 20_000]
            row, anchor = anchors_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[row])], names=["anchor", "fp"])


def link_group(fp: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Labels of the groups that links within the threshold make among distinct uint64 fingerprints.

    A large anchor is split again: of the four bytes of either half, one is equal in any linked pair,
    so only fingerprints with an equal byte of the same place are compared, block by block.
    """
    labels = np.arange(len(fp))
    if len(fp) <= 512:
        u, v = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold, 1))
        join_labels(labels, u, v)
        return labels
    for place in range(8):
        byte = (fp >> np.uint64(8 * place)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        cuts = np.flatnonzero(np.diff(byte[order])) + 1
        for own in np.split(order, cuts):
            step = max(1, 4_000_000 // len(own))
            for at in range(0, len(own), step):
                u, v = np.nonzero(np.bitwise_count(fp[own[at : at + step], None] ^ fp[None, own]) <= threshold)
                join_labels(labels, own[at + u], own[v])
    return labels


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to the links found: (a, b) of a spanning star for each linked group."""
    kept_anchor, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(anchor)]))
        size = ends - starts
        two = starts[size == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD
        a, b = [x[near]], [y[near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            own = fp[s:e]
            labels = link_group(own.view(np.uint64))
            away = labels != np.arange(len(own))
            a.append(own[labels[away]])
            b.append(own[away])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    waiting = []
    for batch in batches:
        anchor, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(anchor):
            continue
        if len(kept_anchor) and anchor[-1] == kept_anchor[0]:
            waiting.append((anchor, fp))
            continue
        anchor = np.concatenate([kept_anchor, *[w[0] for w in waiting], anchor])
        fp = np.concatenate([kept_fp, *[w[1] for w in waiting], fp])
        waiting = []
        last = int(np.searchsorted(anchor, anchor[-1], side="left"))
        kept_anchor, kept_fp = anchor[last:].copy(), fp[last:].copy()
        if last:
            yield links(anchor[:last], fp[:last])
    if len(kept_anchor):
        yield links(np.concatenate([kept_anchor, *[w[0] for w in waiting]]), np.concatenate([kept_fp, *[w[1] for w in waiting]]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) of each row: h is the text's hash, fp the fingerprint as a signed long.  Written to the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(_fingerprints, f"id {kind}, h bigint, fp bigint"), "fingerprints")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root) of each distinct fingerprint: root is the smallest fingerprint of its group."""
    # Dealt anew, as a row becomes up to 34 and the few bytes of fingerprints would make few tasks.
    distinct = prints.select("fp").distinct().repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = distinct.mapInArrow(_to_anchors, "anchor bigint, fp bigint")
    links = spread.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare, "a bigint, b bigint")
    found = components(links)
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest id reachable by links,
    the row's own included.  A null text has no words: fingerprint zero, linked like any other.  Null ids
    are never the smallest unless a component has no other.  Repeated rows each get their row.  An empty
    table gives an empty result; further columns are not read.
    """
    prints = fingerprints(docs, id_col, text_col)
    lows = prints.groupBy("fp").agg(F.min("id").alias("low"))
    labelled = lows.join(groups(prints), "fp")
    least = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without texts of linked fingerprints: of each component the row with the smallest id stays, once."""
    prints = fingerprints(docs, id_col, text_col)
    lows = prints.groupBy("fp").agg(F.min(row_rank()).alias("low")).join(groups(prints), "fp")
    return only_rows(docs, lows.groupBy("root").agg(F.min("low").alias("low")), id_col, text_col)


def row_rank() -> Column:
    """The order of rows (id, h): by id, a null one last, then by the text's hash."""
    return F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("h").alias("h"))


def only_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stay (low: a row's rank) names; of rows equal in id and text, one.  The columns are those of docs."""
    named = stay.select(F.col("low.id").alias("__loom_sid"), F.col("low.h").alias("__loom_sh")).distinct()
    keyed = docs.withColumn("__loom_h", text_hash(text_col))
    kept = keyed.join(named, F.col("__loom_h").eqNullSafe(F.col("__loom_sh")) & F.col(id_col).eqNullSafe(F.col("__loom_sid")))
    once = kept.withColumn("__loom_n", F.row_number().over(Window.partitionBy("__loom_h", id_col).orderBy(F.lit(1))))
    return once.where("__loom_n = 1").select(*[docs[c] for c in docs.columns])
