"""Exact top-k search by inner product with a pivot table.

Vectors become whole numbers, and each gets its distances to PIVOTS pivots, the origin among them.  For a
query q and a candidate x the largest |d(q, p) - d(x, p)| over the pivots p bounds their distance from
below, and so their inner product, (|q|^2 + |x|^2 - d^2) / 2, from above.  Candidates are evaluated in
the order of that bound until none that is left can reach the query's k-th score.

The table is cut into blocks of near vectors.  A query starts in its own block; the k-th score found there
and the blocks' intervals of pivot distances tell to which other blocks it has to go.  Queries meet the
blocks on a grid of directories, and a block that many queries ask for is copied for groups of them, so
neither side is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, written

K = 10
SCALE = 1024
#: Rows whose id is divisible by this are the queries.
EVERY = 100
PIVOTS = 32
#: Pivots are chosen among so many rows, those of the least hashes, with at most SAMPLE_DIM components: 16 MB.
SAMPLE, SAMPLE_DIM = 512, 4096
#: A block's rows and bytes of vectors.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Blocks in a directory, and packs of queries that one copy of a block serves.
DIRECTORY, PACKS = 512, 256
#: Candidates evaluated at a time.
STEP = 64
_EXACT = float(1 << 53)

_SIDE = "dim int, n int, rows binary, ids binary, known binary, data binary, dists binary, least binary"
_ARRAYS = {"rows": "<i8", "ids": "<i8", "known": "?", "least": "<f8"}


def _quantised(scale: int) -> object:
    """Vectors to whole numbers as doubles; rows that take no part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            n = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            ends = np.cumsum(n)
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - n])
            whole = np.floor(flat * scale)
            keep = np.flatnonzero(ok)
            data = [whole[e - m : e].tobytes() for e, m in zip(ends[keep].tolist(), n[keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), pa.array(n[keep], pa.int32()), pa.array(data, pa.binary())], names=["id", "dim", "v"])

    return run


def choose_pivots(sample: list[np.ndarray], pivots: int = PIVOTS) -> list[np.ndarray]:
    """The origin and, one by one, the vector of the sample farthest from all chosen ones; shorter vectors end in zeros."""
    chosen = [np.empty(0)]
    if not sample:
        return chosen
    padded = np.zeros((len(sample), max(map(len, sample))))
    for row, v in zip(padded, sample, strict=True):
        row[: len(v)] = v
    away = np.full(len(sample), np.inf)
    now = padded.mean(axis=0)
    for _ in range(pivots):
        away = np.minimum(away, ((padded - now) ** 2).sum(axis=1))
        far = int(away.argmax())
        if not away[far] > 0:
            break
        now = padded[far]
        chosen.append(sample[far])
        if len(chosen) == 2:  # the mean was only the first one's measure
            away[:] = np.inf
    return chosen


def distances(x: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Rows of x to their distances to the pivots; what one of two lacks counts as zeros."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        m = min(len(p), x.shape[1])
        d = ((x[:, :m] - p[:m]) ** 2).sum(axis=1) + (x[:, m:] ** 2).sum(axis=1) + (p[m:] ** 2).sum()
        out[:, k] = np.sqrt(d)
    return out


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim)


def _placed(pivots: list[np.ndarray]) -> object:
    """Rows with their pivot distances, and with the nearest pivot and its distance as their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                d = distances(_matrix(own.column("v").to_pylist(), dim), pivots)
                near = d[:, 1:].argmin(axis=1) + 1 if len(pivots) > 1 else np.zeros(len(own), np.int64)
                cols = [own.column("id"), own.column("dim"), own.column("v"), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(own)), near])]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "dim", "v", "dists", "near", "far"])

    return run


def _side(dim: int, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, data: np.ndarray, dists: np.ndarray, least: np.ndarray | None) -> dict:
    """One row of _SIDE: a block of candidates, or a pack of queries with their least scores."""
    return {"dim": dim, "n": len(ids), "rows": rows.tobytes(), "ids": ids.tobytes(), "known": known.tobytes(), "data": data.tobytes(), "dists": dists.tobytes(), "least": None if least is None else least.tobytes()}


class Side:
    """A row of _SIDE with its arrays."""

    def __init__(self, row: dict) -> None:
        for name, kind in _ARRAYS.items():
            setattr(self, name, None if row[name] is None else np.frombuffer(row[name], kind))
        self.dim, n = row["dim"], row["n"]
        self.data = np.frombuffer(row["data"], "<f8").reshape(n, self.dim)
        self.dists = np.frombuffer(row["dists"], "<f8").reshape(n, -1)
        self.squares = self.dists[:, 0] ** 2  # the origin is the first pivot

    def search(self, q: np.ndarray, q_dists: np.ndarray, k: int, least: float, skip: int = -1) -> tuple[np.ndarray, list[int]]:
        """(places, scores) of the k best candidates for q that have `least` or more, best first; without the place `skip`.

        Candidates come in the order of their upper bounds, up to the first that cannot reach the k-th score.
        """
        span = float(q_dists.max() + self.dists.max()) if len(self.dists) else 0.0
        low = np.nan_to_num(np.abs(self.dists - q_dists).max(axis=1) - 1e-12 * span, nan=0.0).clip(0)
        bound = (q_dists[0] ** 2 + self.squares - low * low) / 2
        bound += 1e-9 * (q_dists[0] ** 2 + self.squares) + 1
        if skip >= 0:
            bound[skip] = -np.inf
        order = np.argsort(-bound, kind="stable")
        end = len(order) - (skip >= 0)
        exact = float(q_dists[0] * np.sqrt(self.squares.max())) < _EXACT if end else True
        whole = None if exact else [int(c) for c in q]
        scores: list[np.ndarray] = []
        at = 0
        while at < end and bound[order[at]] >= least:
            step = order[at : min(end, at + STEP)]
            if exact:
                scores.append(self.data[step] @ q)
            else:
                scores.append(np.array([sum(a * int(b) for a, b in zip(whole, self.data[i], strict=True)) for i in step], dtype=object))
            at += len(step)
            if at >= k:
                least = max(least, np.sort(np.concatenate(scores))[-k])
        found = np.concatenate(scores) if scores else np.empty(0)
        places = order[:at]
        good = np.flatnonzero(found >= least)
        best = sorted(good.tolist(), key=lambda i: (-found[i], not self.known[places[i]], self.ids[places[i]]))[:k]
        return places[best], [int(found[i]) for i in best]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their places to blocks, each with the interval of its distances to every pivot."""
    from pyspark import TaskContext

    own = TaskContext.get().partitionId() << 24
    made = 0
    names = ["block", "low", "high", *[part.split()[0] for part in _SIDE.split(", ")]]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 6]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal made
        block, dim = own + made, rows[0][1]
        made += 1
        known = np.array([r[0] is not None for r in rows])
        ids = np.array([r[0] or 0 for r in rows], np.int64)
        d = np.frombuffer(b"".join(r[3] for r in rows), "<f8").reshape(len(rows), -1)
        side = _side(dim, block * BLOCK_ROWS + np.arange(len(rows), dtype=np.int64), ids, known, _matrix([r[2] for r in rows], dim), d, None)
        values = [block, d.min(axis=0).tobytes(), d.max(axis=0).tobytes(), *side.values()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    waiting: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("id", "dim", "v", "dists")], strict=True):
            if waiting and (waiting[0][1] != row[1] or len(waiting) >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * row[1] + 1)))):
                yield block(waiting)
                waiting = []
            waiting.append(row)
    if waiting:
        yield block(waiting)


_FOUND = "found array<struct<row: bigint, query_id: bigint, known: boolean, vec_id: bigint, score: bigint>>"


def _found(row: int, query: int, block: Side, places: np.ndarray, scores: list[int]) -> list[dict]:
    return [{"row": row, "query_id": query, "known": bool(block.known[p]), "vec_id": int(block.ids[p]), "score": s} for p, s in zip(places.tolist(), scores, strict=True)]


def _found_type() -> pa.DataType:
    return pa.list_(pa.struct([("row", pa.int64()), ("query_id", pa.int64()), ("known", pa.bool_()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def _at_home(k: int, every: int) -> object:
    """Blocks to their queries as packs, with what each found in its own block and the k-th score of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pack", *[part.split()[0] for part in _SIDE.split(", ")], "found"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, _found_type()]
        for batch in batches:
            for row in batch.to_pylist():
                block = Side(row)
                asks = np.flatnonzero(block.known & (block.ids % every == 0))
                if not len(asks):
                    continue
                found, least = [], np.full(len(asks), -np.inf)
                for j, i in enumerate(asks.tolist()):
                    places, scores = block.search(block.data[i], block.dists[i], k, -np.inf, skip=i)
                    found += _found(int(block.rows[i]), int(block.ids[i]), block, places, scores)
                    if len(scores) == k:
                        least[j] = scores[-1]
                side = _side(block.dim, block.rows[asks], block.ids[asks], block.known[asks], block.data[asks], block.dists[asks], least)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([row["block"], *side.values(), found], kinds, strict=True)], names=names)

    return run


def _routed(copies: int) -> object:
    """Packs with a directory of blocks to the queries that must go to each block, as smaller packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "copy", *[part.split()[0] for part in _SIDE.split(", ")]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
        for batch in batches:
            for row in batch.to_pylist():
                pack = Side(row)
                for entry in row["blocks"]:
                    if entry["dim"] != pack.dim or entry["block"] == row["pack"]:
                        continue
                    low, high = (np.frombuffer(entry[c], "<f8") for c in ("low", "high"))
                    span = pack.dists.max(axis=1) + high.max()
                    apart = np.maximum(low - pack.dists, pack.dists - high).max(axis=1) - 1e-12 * span
                    apart = np.nan_to_num(apart, nan=0.0).clip(0)
                    total = pack.squares + high[0] ** 2
                    goes = np.flatnonzero((total - apart * apart) / 2 + 1e-9 * total + 1 >= pack.least)
                    if len(goes):
                        side = _side(pack.dim, pack.rows[goes], pack.ids[goes], pack.known[goes], pack.data[goes], pack.dists[goes], pack.least[goes])
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([entry["block"], row["pack"] % copies, *side.values()], kinds, strict=True)], names=names)

    return run


def _away(k: int) -> object:
    """Rows sorted by block and copy, the block before the packs that ask it, to what the queries find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                now = (row["block"], row["copy"])
                if row["least"] is None:
                    block, key = Side(row), now
                    continue
                if key != now:
                    raise RuntimeError("a pack of queries came without its block")
                pack = Side(row)
                for i in range(len(pack.ids)):
                    found += _found(int(pack.rows[i]), int(pack.ids[i]), block, *block.search(pack.data[i], pack.dists[i], k, pack.least[i]))
            yield pa.RecordBatch.from_arrays([pa.array([found], _found_type())], names=["found"])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: the k best rows for each query.

    A component x counts as floor(scale * x) in double precision.  Queries are the rows whose id, a whole
    number, is divisible by `every`; candidates are all other rows with as many components.  Equal scores
    go by smaller id, a null id last.  A row without a vector, or with a null or non-finite component,
    takes no part.  Repeated rows are rows of their own: they find one another, and each query row gets its
    result.  A query with fewer candidates gets them all; without queries, or rows, the result is empty.
    Further columns are not read.  A score beyond 64 bits fails the job.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(given.mapInArrow(_quantised(scale), "id bigint, dim int, v binary"), "whole-vectors")
    sample = rows.where(F.col("dim") <= SAMPLE_DIM).orderBy(F.xxhash64("id", "v")).select("v").limit(SAMPLE).collect()
    pivots = choose_pivots([np.frombuffer(r.v, "<f8") for r in sample])

    placed = rows.mapInArrow(_placed(pivots), "id bigint, dim int, v binary, dists binary, near int, far double")
    order = ["dim", "near", "far", "id"]
    blocks = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, f"block bigint, low binary, high binary, {_SIDE}"), "blocks")
    packs = written(blocks.drop("low", "high").mapInArrow(_at_home(k, every), f"pack bigint, {_SIDE}, {_FOUND}"), "packs")

    n_blocks, n_packs = blocks.count(), packs.count()
    directories, copies = max(1, -(-n_blocks // DIRECTORY)), max(1, -(-n_packs // PACKS))
    listed = blocks.select(F.pmod(F.xxhash64("block"), F.lit(directories)).alias("directory"), F.struct("block", "dim", "low", "high").alias("entry"))
    listed = listed.groupBy("directory").agg(F.collect_list("entry").alias("blocks"))
    asked = packs.drop("found").withColumn("directory", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(directories - 1).cast("bigint"))))
    routed = asked.join(listed, "directory").drop("directory").mapInArrow(_routed(copies), f"block bigint, copy int, {_SIDE}")
    sides = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), *[part.split()[0] for part in _SIDE.split(", ")])
    meeting = sides.unionByName(routed).withColumn("asks", F.col("least").isNotNull()).repartition("block", "copy").sortWithinPartitions("block", "copy", "asks").drop("asks")
    found = packs.select("found").unionByName(meeting.mapInArrow(_away(k), _FOUND)).select(F.inline("found"))

    vec_id = F.when(F.col("known"), F.col("vec_id"))
    order_of = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("known"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order_of)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", vec_id.alias("vec_id"), "score")


def top_k_sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.rid <> v.rid AND len(q.e) = len(v.e) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= {k}"""
