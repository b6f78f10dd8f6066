"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items go into one automaton; each training text is streamed through it
and the longest match that ends at each word is tracked.  Where it reaches the window length, or holds
a whole short item, the words of that window are hit and the window's items are noted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, written

WINDOW = 10
#: Words of test items in one automaton (about 700 bytes each on the driver and each worker).  More
#: items make more automata, each scanned in a stage of its own, so that no worker holds two.
BLOCK_WORDS = 200_000
#: Of a document's words, the share hit above which cut_hits drops it whole.
MOST_COVERAGE = 0.5
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over words; knows which items have each window."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: By state: the items whose windows of the full length are the state's word sequence of that length.
        self.full: dict[int, set[str | None]] = {}
        #: By state: the shorter items that are one of the state's word sequences, as (words, item).
        self.short: dict[int, set[tuple[int, str | None]]] = {}
        self.least = window
        self.items: list[tuple[list[bytes], str | None]] = []

    def add(self, words: list[bytes], item: str | None) -> None:
        """Adds an item's words; item None marks words without naming an item."""
        last = 0
        for w in words:
            last = self._extend(last, w)
        if words:
            self.items.append((words, item))

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, edges: dict[bytes, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A copy of q for the sequences that are no longer than p's with w behind."""
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def freeze(self) -> Automaton:
        """Notes each window's items at its state, once all words are in."""
        for words, name in self.items:
            at, n = 0, 0
            for i, w in enumerate(words):
                at, n = self.next[at][w], n + 1
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                n = min(n, self.length[at])
                if n >= self.window:
                    self.full.setdefault(at, set()).add(name)
                if i == len(words) - 1 and len(words) < self.window:
                    self.short.setdefault(at, set()).add((len(words), name))
                    self.least = min(self.least, len(words))
        self.items.clear()
        return self

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The windows found, as (first word, end) in order of their ends, and the items that have them."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        named: set[str | None] = set()
        at = n = 0
        root = nxt[0]
        for i, w in enumerate(words):
            to = nxt[at].get(w)
            if to is None:
                if w not in root:  # most words of a text: they are in no item
                    at = n = 0
                    continue
                while to is None:
                    at = link[at]
                    to = nxt[at].get(w)
                n = length[at]
            at, n = to, n + 1
            if n >= least:
                if n >= window:
                    s = at
                    while length[link[s]] >= window:
                        s = link[s]
                    spans.append((i - window + 1, i + 1))
                    found.add(s)
                if self.short:
                    s = at
                    while s > 0:
                        for k, name in self.short.get(s, ()):
                            if k <= n:
                                spans.append((i - k + 1, i + 1))
                                named.add(name)
                        s = link[s]
        for s in found:
            named |= self.full.get(s, set())
        return spans, named - {None}


def marked(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word spans as disjoint runs in order."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def blocks_needed(items: DataFrame, text_col: str, block_words: int) -> int:
    """How many blocks of block_words words the items fill."""
    total = items.agg(F.sum(F.regexp_count(text_col, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    return max(1, -(-int(total) // block_words))


def automata(items: DataFrame, id_col: str, text_col: str, window: int, blocks: int) -> Iterator[Automaton]:
    """One frozen automaton for each of `blocks` blocks of items, one block's words on the driver at a time.

    Items are dealt to blocks by hash, so that blocks are of about one size.
    """
    dealt = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"), F.pmod(F.xxhash64(text_col), F.lit(blocks)).alias("block"))
    for k in range(blocks):
        now = Automaton(window)
        for row in dealt.where(F.col("block") == k).select("id", "text").toLocalIterator():
            words = words_of(bytes(row.text) if row.text is not None else None)
            now.add(words, row.id)
        yield now.freeze()


def _scan(shared: object, hits_only: bool) -> object:
    """Rows with __loom_text to the rows with __loom_spans (flat starts and ends) and __loom_items; only those with hits, without text, if so asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            spans, items = [], []
            for text in batch.column("__loom_text"):
                got, named = automaton.hits(words_of(text.as_py()))
                spans.append([x for run in marked(got) for x in run])
                items.append(sorted(named))
            names = [c for c in batch.schema.names if not (hits_only and c == "__loom_text")]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[*names, "__loom_spans", "__loom_items"])
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

    return run


_HITS = "__loom_spans array<int>, __loom_items array<string>"


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __loom_text (binary), __loom_spans (flat starts and ends of hit runs) and __loom_items (names of the items hit).

    With one automaton that is one pass over docs; with more, each writes its hits, and those of a row are
    put together, so that its spans may overlap.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    given = docs.withColumn("__loom_text", F.col(text_col).cast("binary"))
    blocks = blocks_needed(items, item_text, block_words)
    made = automata(items, id_col, item_text, window, blocks)
    if blocks == 1:
        schema = given.withColumn("__loom_spans", F.lit(None).cast("array<int>")).withColumn("__loom_items", F.lit(None).cast("array<string>")).schema
        return given.mapInArrow(_scan(spark.sparkContext.broadcast(next(made)), False), schema)
    given = written(given.withColumn("__loom_row", F.monotonically_increasing_id()), "numbered")
    hits = []
    for automaton in made:
        shared = spark.sparkContext.broadcast(automaton)
        hits.append(written(given.select("__loom_row", "__loom_text").mapInArrow(_scan(shared, True), f"__loom_row bigint, {_HITS}"), "hits"))
        shared.destroy()
    merged = reduce(DataFrame.unionByName, hits).groupBy("__loom_row").agg(F.flatten(F.collect_list("__loom_spans")).alias("__loom_spans"), F.array_distinct(F.flatten(F.collect_list("__loom_items"))).alias("__loom_items"))
    return given.join(merged, "__loom_row", "left").drop("__loom_row")


def _runs(flat: list[int] | None) -> list[tuple[int, int]]:
    flat = flat or []
    return marked(list(zip(flat[::2], flat[1::2], strict=True)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": []}
        for text, flat, items in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            items = sorted(items.as_py() or [])
            rows["n_words"].append(len(words_of(text.as_py())))
            rows["n_hit"].append(sum(b - a for a, b in _runs(flat.as_py())))
            rows["n_items"].append(len(items))
            rows["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in rows.values()]], names=["id", *rows])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; an item with null or empty text has no window; an item with a null id marks
    words but isn't counted; repeated items count once; repeated documents each get their row.  Without
    items nothing is hit.  Item ids are listed once, sorted as strings.
    """
    found = find_hits(docs.select(F.col(doc_id).alias("id"), F.col(text_col).alias("text")), items, item_id, item_text, "text", window, block_words)
    kind = found.schema["id"].dataType.simpleString()
    rows = found.select("id", "__loom_text", "__loom_spans", "__loom_items").mapInArrow(_digest, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    return rows.select(F.col("id").alias(doc_id), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _cut(most_coverage: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, flat in zip(batch.column("__loom_text"), batch.column("__loom_spans"), strict=True):
                raw, runs = text.as_py(), _runs(flat.as_py())
                if not runs:
                    texts.append(raw.decode() if raw is not None else None)
                    stay.append(True)
                    continue
                at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
                stay.append(sum(b - a for a, b in runs) <= most_coverage * len(at))
                cut, end = [], 0
                for a, b in runs:
                    cut.append(raw[end : at[a][0]])
                    end = at[b - 1][1]
                texts.append(b"".join([*cut, raw[end:]]).decode())
            names = [c for c in batch.schema.names if not c.startswith("__loom_") or c == "__loom_cut"]
            columns = [pa.array(texts, pa.string()) if c == "__loom_cut" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay))

    return run


def cut_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_coverage: float = MOST_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit spans; a document of whose words more than most_coverage are hit is dropped.

    The rows and columns are otherwise those of docs; a text without hits, a null one too, is unchanged.
    """
    narrow = docs.withColumn("__loom_cut", F.lit(None).cast("string"))
    found = find_hits(narrow.withColumnRenamed(text_col, "__loom_src"), items, item_id, item_text, "__loom_src", window, block_words).drop("__loom_src")
    cols = [c for c in found.columns if not c.startswith("__loom_") or c == "__loom_cut"]
    out = found.mapInArrow(_cut(most_coverage), found.select(*[f"`{c}`" for c in cols]).schema)
    return out.select(*[F.col("__loom_cut").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
