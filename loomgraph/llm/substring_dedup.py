"""Substring dedup by a compacted de Bruijn graph over words.

Every run of WINDOW words is an edge of the graph (from its first to its last WINDOW - 1 words).  As the
edges of a text far outnumber its words' bytes, they are made in compacted form at once: consecutive
edges of a document with the same minimizer, the smallest hash among the edge's K-word pieces, are one
path, named by a 128-bit hash of its words as they stand in the text; equal edges have equal minimizers,
so they meet in one bucket.

Spark joins then compact and decide the buckets.  Where all paths of a repeated minimizer are equal, the
path does not branch: all its edges are repeated.  Where paths differ, equal paths are compacted to one,
and only then are single edges compared, by a 128-bit hash of their words in the source text.  The source
coordinates (document, first word, edges) of the repeated edges give the words to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, text_hash, written

WINDOW = 35
#: Words of the pieces among which the minimizer is chosen.
K = 9
_FOLD = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 28) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Rolled:
    """Hashes of any word range of one text, from prefix sums."""

    def __init__(self, words: list[bytes], table: WordHashes) -> None:
        h = np.array([table[w] for w in words], dtype=np.uint64)
        up, self.down = _power(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(h * up[: len(words)], out=self.sums[1:])

    def every(self, n: int) -> np.ndarray:
        """Of every range of n words."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


class Spans:
    """128-bit hashes of word ranges of one text, words joined by one space."""

    def __init__(self, words: list[bytes]) -> None:
        self.text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.begins, self.ends = np.concatenate(([0], ends[:-1] + 1)), ends

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves, for ranges from word `start` up to `end`."""
        text, digest = self.text, xxhash.xxh3_128_digest
        raw = b"".join([digest(text[a:b]) for a, b in zip(self.begins[start].tolist(), self.ends[end - 1].tolist(), strict=True)])
        both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def paths(words: list[bytes], table: WordHashes, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """(first edge, edges, minimizer, and the halves of the hash of the path's words) of each path of a text."""
    none = np.empty(0, np.int64)
    if len(words) < window:
        return none, none, none, none, none
    pieces = Rolled(words, table).every(k)
    ranked = (pieces & ~_PLACE) | np.arange(len(pieces), dtype=np.uint64)  # ties: the leftmost
    low = (_sliding_min(ranked, window - k + 1) & _PLACE).astype(np.int64)
    cuts = np.flatnonzero(np.diff(low)) + 1
    start = np.concatenate(([0], cuts))
    end = np.concatenate((cuts, [len(low)]))
    return start, end - start, pieces[low[start]].view(np.int64), *Spans(words).hashes(start, end - 1 + window)


def _to_paths(window: int, k: int) -> object:
    names = ["start", "n", "mini", "span", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            got = [paths(words_of(t.as_py()), table, window, k) for t in batch.column(2)]
            at = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            cols = [np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(len(names))]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds, strict=True)]], names=["id", "h", *names])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [press.compress(t.as_py() or b"") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["id", "h", "blob"])


def _unpack(blob: bytes) -> list[bytes]:
    return words_of(zstandard.ZstdDecompressor().decompress(blob))


def _edges(window: int) -> object:
    """Rows of a text and its branching paths to a row for each edge: (mini, edge, check, id, h, start, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, minis, starts, counts, edges, checks = [], [], [], [], [], []
            for k in range(len(batch)):
                spans = Spans(_unpack(batch.column("blob")[k].as_py()))
                own = batch.column("paths")[k].as_py()
                n = np.array([p["n"] for p in own])
                at = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in own])
                edge, check = spans.hashes(at, at + window)
                rows.append(np.full(len(at), k))
                minis.append(np.repeat(np.array([p["mini"] for p in own]), n))
                starts.append(at.astype(np.int32))
                counts.append(np.repeat(np.array([p["c"] for p in own]), n))
                edges.append(edge)
                checks.append(check)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in (minis, edges, checks)], batch.column("id").take(at), batch.column("h").take(at), *[pa.array(np.concatenate(x)) for x in (starts, counts)]], names=["mini", "edge", "check", "id", "h", "start", "c"])

    return run


def covered(spans: list[dict], n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words the edges of the spans (start, n) cover."""
    steps = np.zeros(n_words + 1, np.int64)
    for s in spans:
        steps[s["start"]] += 1
        steps[s["start"] + s["n"] - 1 + window] -= 1
    return np.cumsum(steps)[:-1] > 0


def _clean(window: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept_text = [], [], []
            for blob, spans in zip(batch.column("blob"), batch.column("spans"), strict=True):
                words, spans = _unpack(blob.as_py()), spans.as_py()
                kept = words
                if spans:
                    out = covered(spans, len(words), window)
                    kept = [words[i] for i in np.flatnonzero(~out).tolist()]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                kept_text.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs (id, h, text binary) to (id, h, start, n): runs of edges that also start elsewhere."""
    kind = docs.schema["id"].dataType.simpleString()
    path, edge = ["mini", "span", "check"], ["mini", "edge", "check"]
    all_paths = written(docs.mapInArrow(_to_paths(window, k), f"id {kind}, h bigint, start int, n int, mini bigint, span bigint, check bigint"), "paths")
    ends = [f(c).alias(f"{name}_{c}") for c in ("span", "check") for name, f in (("low", F.min), ("high", F.max))]
    buckets = all_paths.groupBy("mini").agg(F.count(F.lit(1)).alias("paths"), *ends).where("paths > 1").select("mini", F.expr("low_span <> high_span OR low_check <> high_check").alias("branches"))
    buckets = written(buckets, "buckets")  # joined as a table, so that the paths of a very common minimizer can be split
    repeated = written(all_paths.join(buckets, "mini"), "repeated-paths")
    plain = repeated.where("not branches").select("id", "h", "start", "n")

    forks = repeated.where("branches").select("id", "h", "start", "n", *path)
    compact = written(forks.groupBy(*path).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "h", "start", "n")).alias("p")), "compacted-paths")
    equal = forks.join(compact.where("c > 1").select(*path), path, "left_semi").select("id", "h", "start", "n")
    asked = compact.select("p.id", "p.h", F.struct("p.start", "p.n", "mini", "c").alias("path")).groupBy("id", "h").agg(F.collect_list("path").alias("paths"))
    # Paths of rows that are repeated whole have c > 1, so meeting each such row changes no count from 1.
    met = _join(docs.mapInArrow(_pack, f"id {kind}, h bigint, blob binary"), asked, "inner").select("id", "h", "blob", "paths")
    edges = written(met.mapInArrow(_edges(window), f"mini bigint, edge bigint, check bigint, id {kind}, h bigint, start int, c bigint"), "edges")
    twice = written(edges.groupBy(*edge).agg(F.sum("c").alias("total")).where("total > 1").select(*edge), "repeated-edges")
    single = edges.where("c = 1").join(twice, edge, "left_semi").select("id", "h", "start", F.lit(1).alias("n"))
    return plain.unionByName(equal).unionByName(single)


def _join(packed: DataFrame, side: DataFrame, how: str) -> DataFrame:
    renamed = side.withColumnsRenamed({"id": "sid", "h": "sh"})
    return packed.join(renamed, packed["id"].eqNullSafe(renamed["sid"]) & (packed["h"] == renamed["sh"]), how)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if it is in a run of window words that also starts anywhere else, in the same document
    too; runs are judged on the input.  A null text has no words; texts shorter than the window lose
    nothing; repeated rows are repeats of each other.  Empty tables give an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeated_spans(rows, window, k).groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    met = _join(rows.mapInArrow(_pack, f"id {kind}, h bigint, blob binary"), spans, "left").select("id", "blob", "spans")
    return met.mapInArrow(_clean(window), f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs, id_col, text_col, **settings).select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def by_brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The report from a dictionary of all windows, for tests."""
    texts = [(i, words_of(t.encode() if t else None)) for i, t in rows]
    seen: dict[tuple, int] = {}
    for _, w in texts:
        for a in range(len(w) - window + 1):
            g = tuple(w[a : a + window])
            seen[g] = seen.get(g, 0) + 1
    out = []
    for i, w in texts:
        gone = {x for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for x in range(a, a + window)}
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
