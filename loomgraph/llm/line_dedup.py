"""Line dedup by pairwise alignment through shared rare line hashes.

A line of LEAST_WORDS words or more counts alone; shorter ones count together with their neighbours, as
the shortest runs of lines that have the words.  Lines and runs are hashed to seeds.  A pair of documents is
aligned on every seed that the two share, with patience diff; what is aligned goes from the later one.  A
block that stands elsewhere in the earlier document stays, unless it is aligned with another one.

A document loses all that any earlier one with a common seed is aligned on, but not all pairs need a look: of
the documents that have a seed, the first FIRST propose themselves to all later ones; then, to the documents
where a line of the seed is still left, MORE times as many of the others, and so on until no such line
or no holder is left.  So a rare seed pairs all that have it, and a common one few more than it has documents.

Of texts with the same lines only the first takes part; the others are aligned with it as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, text_hash, written

#: A common block of fewer words is too common by chance to go.
LEAST_WORDS = 5
#: Documents that a seed proposes to later ones at first, and the factor of each further round.
FIRST, MORE = 4, 8
#: Documents that a seed proposes to later ones in all; None: every one.
HOLDERS: int | None = None
#: Characters of scripts without spaces between words; two count as a word.
_WIDE = re.compile(r"[⺀-鿿豈-﫿\U00020000-\U0003ffff]")


def units_of(text: str | None, least: int) -> list[tuple[int, int, int, str]]:
    """(first line, end, words, line) of each line that is not blank, with the blank ones behind it.

    Blank lines at the head belong to the first unit.  Words are counted up to `least`; white space runs are one space.
    """
    out: list[tuple[int, int, int, str]] = []
    for i, line in enumerate(text.split("\n") if text else []):
        words = line.split()
        if words:
            n = len(words)
            if n < least and not line.isascii():
                n += len(_WIDE.findall(line)) // 2
            out.append((i if out else 0, i + 1, min(n, least), " ".join(words)))
        elif out:
            out[-1] = (out[-1][0], i + 1, *out[-1][2:])
    return out


def seeds_of(text: str | None, least: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """(first line, end, hash) of the text's seeds: from each line and up to each line the shortest run of
    lines that has `least` words.  A text of fewer words is one seed, which equals only whole texts."""
    units = units_of(text, least)
    if not units:
        return []
    runs: dict[tuple[int, int], None] = {}
    end, words = 0, 0
    for i, (_, _, n, _) in enumerate(units):
        while words < least and end < len(units):
            words += units[end][2]
            end += 1
        if words < least:
            break
        runs[i, end] = None
        words -= n
    begin, words = len(units), 0
    for j in range(len(units), 0, -1):
        while words < least and begin > 0:
            begin -= 1
            words += units[begin][2]
        if words < least:
            break
        runs[begin, j] = None
        words -= units[j - 1][2]
    whole = "" if runs else "\0"
    spans = runs or {(0, len(units)): None}
    return [(units[a][0], units[b - 1][1], xxhash.xxh3_128_digest(whole + "\n".join(u[3] for u in units[a:b]))) for a, b in spans]


def patience(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Index pairs that patience diff aligns: what is unique in both anchors by longest increasing
    subsequence; the gaps between anchors are aligned in the same way, after equal heads and tails."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {h: j for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1 and in_a.get(h) == 1}
        once = [(i, where[h]) for i, h in enumerate(a[a0:a1], a0) if h in where]
        anchors = _increasing(once)
        pa_, pb = a0, b0
        for i, j in anchors:
            found.append((i, j))
            stack.append((pa_, i, pb, j))
            pa_, pb = i + 1, j + 1
        if anchors:
            stack.append((pa_, a1, pb, b1))
    return sorted(found)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, which ascend by the first, that ascends by the second."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned_blocks(shared: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int, int]]:
    """The blocks (start, end, first_start, first_end) of lines that patience diff aligns.

    shared: for each seed of a pair its places in the later and in the first document, as flat starts and
    ends.  Aligned seeds that touch or overlap in both documents make one block.
    """
    later, first = (sorted((p[i], p[i + 1], k) for k, seed in enumerate(shared) for p in (seed[side],) for i in range(0, len(p), 2)) for side in (0, 1))
    blocks: list[list[int]] = []
    for i, j in patience([x[2] for x in first], [x[2] for x in later]):
        (start, end, _), (f_start, f_end, _) = later[j], first[i]
        now = blocks[-1] if blocks else None
        if now and start <= now[1] and f_start <= now[3]:
            now[1], now[3] = max(now[1], end), max(now[3], f_end)
        else:
            blocks.append([start, end, f_start, f_end])
    return [tuple(b) for b in blocks]


_SEED = {"row": pa.int64(), "whole": pa.binary(), "last": pa.int32(), "hash": pa.binary(), "places": pa.list_(pa.int32())}


def _explode(least: int) -> object:
    """Texts to their distinct seeds with all their places; the first seed of each has the hash and the end of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, rows = [], []
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                places: dict[bytes, list[int]] = {}
                for start, end, digest in seeds_of(text, least):
                    places.setdefault(digest, []).extend((start, end))
                row += 1
                for nth, (digest, at) in enumerate(places.items()):
                    units = None if nth else units_of(text, least)
                    whole = None if nth else xxhash.xxh3_128_digest("\n".join(u[3] for u in units))
                    owner.append(k)
                    rows.append((row, whole, None if nth else units[-1][1], digest, at))
            at = pa.array(owner, pa.int32())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_SEED)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(cols, _SEED.values(), strict=True)]], names=["id", "h", *_SEED])

    return run


_BLOCK = ("start", "end", "first_start", "first_end")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair, with its shared seeds, to the pair's aligned blocks."""
    for batch in batches:
        owner, rows = [], []
        for k, seeds in enumerate(batch.column("seeds")):
            got = aligned_blocks([(s["places"], s["first_places"]) for s in seeds.as_py()])
            owner += [k] * len(got)
            rows += got
        at = pa.array(owner, pa.int32())
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_BLOCK)
        yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("first_row").take(at), *[pa.array(c, pa.int32()) for c in cols]], names=["row", "first_row", *_BLOCK])


def _blocks(pairs: DataFrame, mine: DataFrame) -> DataFrame:
    """The aligned blocks of pairs (row, first_row) of documents, by their seeds mine (row, hash, places)."""
    theirs = mine.select(F.col("row").alias("first_row"), "hash", F.col("places").alias("first_places"))
    met = pairs.join(mine, "row").join(theirs, ["first_row", "hash"])
    seeds_of_pair = met.groupBy("row", "first_row").agg(F.collect_list(F.struct("places", "first_places")).alias("seeds"))
    return seeds_of_pair.mapInArrow(_align, "row bigint, first_row bigint, start int, end int, first_start int, first_end int")


def _pairs(met: DataFrame) -> DataFrame:
    """(row, first_row) of places own and first, where first is the earlier document."""
    return met.where("first < own").select(F.col("own.row").alias("row"), F.col("first.row").alias("first_row")).distinct()


def _left(seeds: DataFrame, blocks: DataFrame) -> DataFrame:
    """Those of seeds (own, hash, places) that have a line which is in none of the blocks."""
    gone = blocks.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("line")).distinct()
    spans = F.transform(F.sequence(F.lit(0), F.size("places") - 2, F.lit(2)), lambda i: F.sequence(F.get("places", i), F.get("places", i + 1) - 1))
    lines = seeds.select(F.col("own.row").alias("row"), "hash", F.explode(F.flatten(spans)).alias("line"))
    open_ = lines.join(gone, ["row", "line"], "left_anti").select("row", "hash").distinct()
    return seeds.withColumn("row", F.col("own.row")).join(open_, ["row", "hash"], "left_semi").select("own", "hash", "places")


def _with_others(shared: DataFrame, mine: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks with those by holders beyond the first ones, until no further one can add a line.

    A seed's further holders take turns in an order by hash, so that each round spreads over all of them.
    """
    open_ = written(_left(shared.where("beyond < own").select("own", "hash", "places"), blocks), "open-seeds")
    if open_.isEmpty():
        return blocks
    further = shared.where("beyond <= own").select("hash", F.col("own").alias("first")).join(open_.select("hash").distinct(), "hash", "left_semi")
    counts = further.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    further = written(further.join(counts, "hash").select("hash", "first", F.pmod(F.xxhash64("first.row"), F.col("n")).alias("turn")), "further-holders")
    last = further.agg(F.max("turn")).first()[0]
    begin, end = 0, FIRST * MORE
    while begin <= last and not open_.isEmpty():
        met = open_.join(further.where((F.col("turn") >= begin) & (F.col("turn") < end)), "hash")
        fresh = written(_blocks(written(_pairs(met), "further-pairs"), mine), "blocks")
        blocks = blocks.unionByName(fresh)
        open_ = written(_left(open_, fresh), "open-seeds")
        begin, end = end, end * MORE
    return blocks


def common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, holders: int | None = HOLDERS) -> DataFrame:
    """(id, h, first_id, first_h, start, end, first_start, first_end): blocks of lines that a document is
    aligned on with earlier ones, in lines from 0; h is the text's hash, (id, h) names a document.  They hold
    every line that an earlier document is aligned on, not every document that is aligned on it."""
    bounded_batches(docs.sparkSession, 4)
    given = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    every = written(given.mapInArrow(_explode(least_words), f"id {kind}, h bigint, row bigint, whole binary, last int, hash binary, places array<int>"), "seeds")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "h", "row")

    heads = every.where("whole is not null").select("id", "h", "row", "whole", "last", place.alias("own"))
    leads = heads.groupBy("whole").agg(F.min("own").alias("lead"))
    others = written(heads.join(leads, "whole").where("row <> lead.row").select("row", "id", "h", "last", F.col("lead.id").alias("first_id"), F.col("lead.h").alias("first_h")), "line-copies")
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    copies = others.where(~same).select("id", "h", "first_id", "first_h", F.lit(0).alias("start"), F.col("last").alias("end"), F.lit(0).alias("first_start"), F.col("last").alias("first_end")).distinct()

    seeds = every.join(others.select("row"), "row", "left_anti").select("hash", place.alias("own"), "places")
    most = FIRST if holders is None else holders
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("own"))
    first = seeds.select("hash", "own").withColumn("nth", nth).where(F.col("nth") <= most + 1)
    first = first.groupBy("hash").agg(F.array_sort(F.collect_list("own")).alias("firsts")).where(F.size("firsts") > 1)
    first = first.select("hash", F.slice("firsts", 1, most).alias("firsts"), F.get("firsts", F.lit(most)).alias("beyond"))
    first = written(first, "holders")  # joined as a table, so that the rows of a very common line can be split
    shared = written(seeds.join(first, "hash"), "shared-seeds")

    mine = shared.select(F.col("own.row").alias("row"), "hash", "places")
    blocks = _blocks(_pairs(shared.select("own", F.explode("firsts").alias("first"))), mine)
    if holders is None:
        blocks = _with_others(shared, mine, written(blocks, "blocks"))
    names = heads.select("row", "id", "h")
    named = blocks.join(names, "row").join(names.select(F.col("row").alias("first_row"), F.col("id").alias("first_id"), F.col("h").alias("first_h")), "first_row")
    return named.select(*copies.columns).unionByName(copies)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_removed = [], [], []
        for text, spans in zip(batch.column("__loom_text"), batch.column("__loom_spans"), strict=True):
            text, spans = text.as_py(), spans.as_py()
            lines = kept = text.split("\n") if text else []
            if spans:
                gone = {i for s in spans for i in range(s["start"], s["end"])}
                kept = [x for i, x in enumerate(lines) if i not in gone]
            texts.append(text if len(kept) == len(lines) else "\n".join(kept))
            n_lines.append(len(lines))
            n_removed.append(len(lines) - len(kept))
        names = [c for c in batch.schema.names if c not in ("__loom_text", "__loom_spans")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "__loom_kept", "__loom_lines", "__loom_removed"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, holders: int | None = HOLDERS) -> DataFrame:
    """docs with the deduplicated text in place, and __loom_lines and __loom_removed (counts of lines).

    A line goes if it is in a block, a run of lines with least_words words in all, on which patience diff
    aligns the document with an earlier one.  The earlier ones are all that have one of its seeds or, if
    `holders` is given, of each of its seeds the first so many documents that have it.  What two documents share in another order is aligned as far as the
    order allows, and the rest stays.  Blank lines do not part a block and go with the line before them (at
    the head, with the first line).  Lines are compared with white space runs as one space.  A copy of an
    earlier text keeps no line: its text is empty; texts of fewer words go only as such copies.

    An earlier document is one with a smaller id, a null id being the largest; of documents with one id,
    the text's hash decides; rows equal in id and text are one document and are treated alike.  Lines
    repeated inside one document stay if no earlier one has them.  A null, empty or blank text is unchanged.
    """
    blocks = common_blocks(docs, id_col, text_col, least_words, holders)
    gone = blocks.groupBy(F.col("id").alias("__loom_i"), F.col("h").alias("__loom_hh")).agg(F.collect_set(F.struct("start", "end")).alias("__loom_spans"))
    keyed = docs.withColumn("__loom_h", text_hash(text_col))
    met = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__loom_i")) & (F.col("__loom_h") == F.col("__loom_hh")), "left")
    rest = [c for c in docs.columns if c != text_col]
    ready = met.select(*[docs[c] for c in rest], docs[text_col].alias("__loom_text"), "__loom_spans")
    schema = docs.select(*[docs[c] for c in rest], F.lit(None).cast("string").alias("__loom_kept"), F.lit(0).cast("bigint").alias("__loom_lines"), F.lit(0).cast("bigint").alias("__loom_removed")).schema
    out = ready.mapInArrow(_apply, schema)
    return out.select(*[F.col("__loom_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], "__loom_lines", "__loom_removed")


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int | None) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, kept_sha256 (of the kept text; null: empty)."""
    done = line_dedup(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **settings)
    return done.select(F.col("id").alias(id_col), F.col("__loom_lines").alias("n_lines"), F.col("__loom_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
