"""Phrase collocations with generalised suffix automata, one for each shard of text.

A shard is what a task reads until its distinct runs of words reach SHARD_WORDS.  They go into a generalised
suffix automaton; counts of end positions, handed up the suffix links, count each word sequence of the
shard, and the states name all sequences of bounded length.  The shards' counts are summed over all.

Before that, one pass counts hashes of words and word pairs.  No frequent phrase holds a rare pair, so the
automata need not see them: texts are cut into runs between rare pairs.  The pass leaves a bit array of
bounded size; where two hashes meet in a bit, a run is longer than it need be, and no count changes.

A phrase's suffix link leads to the phrase without its first word, its mirror image to that without its
last.  Counts only fall along the way to longer phrases, so a phrase lies inside a longer one of a given
count if and only if one of those that link to it has the count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, written

MOST_WORDS = 4
LEAST_COUNT = 30
#: In hundredths: a phrase goes if a longer one around it has this share of its count.
SHARE = 80
TOP = 2000
SCALE = 2_000_000
NO_LANG = "und"
#: Distinct words of runs in one automaton, some 500 bytes each.
SHARD_WORDS = 100_000
#: Words of text and distinct words that a task gathers before it works them off.
BATCH_WORDS, VOCABULARY = 1_000_000, 250_000
#: Bits of the array of frequent hashes: so many for each, within bounds (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27
#: Bits of the array that one row holds.
CHUNK = 1 << 15
_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that are split into words at a time.
PART = 1 << 20


def tokens(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts' words in parts, with _BREAK wherever a piece ends."""
    blob = _BREAK.join(texts).translate(_FOLD)
    at = 0
    while at < len(blob):
        cut = blob.find(b" ", at + PART) if at + PART < len(blob) else -1
        cut = len(blob) if cut < 0 else cut
        yield blob[at:cut].replace(_BREAK, b" \xff ").split()
        at = cut
    yield [_BREAK]


class Words:
    """Numbers for the words of one language; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[_BREAK]
        self._keys = np.empty(0, np.uint64)

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        parts = [np.fromiter(map(self.number.__getitem__, part), np.int32, len(part)) for part in tokens(texts)]
        return np.concatenate(parts)

    def keys(self, lang: str) -> np.ndarray:
        """A hash of each word and the language, in order of the numbers."""
        seed, known = xxhash.xxh64_intdigest(lang), len(self._keys)
        if known < len(self.number):
            digest = xxhash.xxh64_intdigest
            fresh = list(self.number)[known:]
            self._keys = np.concatenate((self._keys, np.fromiter((digest(w, seed) for w in fresh), np.uint64, len(fresh))))
        return self._keys


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language, some BATCH_WORDS words at a time."""
    waiting: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if text:
                waiting[lang].append(text)
                size += len(text)
            if size > 6 * BATCH_WORDS:
                yield from waiting.items()
                waiting, size = defaultdict(list), 0
    yield from waiting.items()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts of words and pairs by their hash, and to the number of all words by language."""
    names = ["lang", "key", "n"]
    for lang, texts in _gathered(batches):
        words = Words()
        ids = words.numbers(texts)
        keys = words.keys(lang)
        counts = np.bincount(ids, minlength=len(keys))
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        codes, pairs = np.unique(ids[:-1][both].astype(np.int64) * len(keys) + ids[1:][both], return_counts=True)
        of_pairs = pair_keys(keys[codes // len(keys)], keys[codes % len(keys)])
        key = np.concatenate((keys[1:], of_pairs)).view(np.int64)
        n = np.concatenate((counts[1:], pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.string()), pa.array(key), pa.array(n)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.int64()), pa.array([int(counts[1:].sum())], pa.int64())], names=names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's bits to the chunk as bytes."""
    for batch in batches:
        out = []
        for bits in batch.column("bits").to_pylist():
            row = np.zeros(CHUNK, np.uint8)
            row[bits] = 1
            out.append(np.packbits(row, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "bytes"])


def frequent_bits(frequent: DataFrame) -> np.ndarray:
    """A bit array in which each key (key) has its bit; a power of two of bits, MOST_BITS at most."""
    bits = LEAST_BITS
    wanted = BITS_EACH * frequent.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = frequent.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    chunks = place.groupBy(F.floor(F.col("bit") / CHUNK).cast("int").alias("chunk")).agg(F.collect_set((F.col("bit") % CHUNK).cast("int")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in chunks.mapInArrow(_packed, "chunk int, bytes binary").collect():
        out[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(row.bytes, np.uint8)
    return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Automaton:
    """Generalised suffix automaton over numbered words, with a weight for each run that is added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends, self.place = [-1], [0], [0], [0]
        self.words: list[int] = []

    def add(self, run: list[int], weight: int) -> None:
        last, ends = 0, self.ends
        for word in run:
            last = self._extended(last, word, len(self.words))
            self.words.append(word)
            ends[last] += weight

    def _state(self, edges: dict[int, int], length: int, place: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.ends.append(0)
        self.place.append(place)
        return len(self.next) - 1

    def _extended(self, last: int, word: int, place: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        to = nxt[last].get(word)
        if to is not None:
            return to if length[to] == length[last] + 1 else self._parted(last, word, to)
        new = self._state({}, length[last] + 1, place)
        p = last
        while p >= 0:
            edges = nxt[p]
            if word in edges:
                to = edges[word]
                link[new] = to if length[to] == length[p] + 1 else self._parted(p, word, to)
                break
            edges[word] = new
            p = link[p]
        return new

    def _parted(self, p: int, word: int, to: int) -> int:
        """The part of state `to` whose sequences are no longer than p's with the word behind."""
        nxt, link = self.next, self.link
        part = self._state(dict(nxt[to]), self.length[p] + 1, self.place[to])
        link[part], link[to] = link[to], part
        while p >= 0 and nxt[p].get(word) == to:
            nxt[p][word] = part
            p = link[p]
        return part

    def sequences(self, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, rows of k words, counts) for each k up to most_words: every sequence of k words once."""
        ends, link, length = self.ends, self.link, np.array(self.length)
        for state in np.argsort(-length, kind="stable").tolist():
            if state:
                ends[link[state]] += ends[state]
        above = length[np.array(link)]  # the root's entry is not used
        n, place, words = np.array(ends, np.int64), np.array(self.place), np.array(self.words, np.int32)
        for k in range(1, most_words + 1):
            own = np.flatnonzero((above < k) & (length >= k))
            own = own[own > 0]
            yield k, words[place[own][:, None] + np.arange(1 - k, 1)], n[own]


def _shards(shared: object, most_words: int) -> object:
    """Texts to (lang, k, phrase, n): what each shard's automaton counts."""

    def shard(lang: str, words: Words, runs: Counter, single: np.ndarray) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for run, weight in runs.items():
            automaton.add(np.frombuffer(run, np.int32).tolist(), weight)
        for word in np.flatnonzero(single).tolist():
            automaton.add([word], int(single[word]))
        text = list(words.number)
        for k, rows, n in automaton.sequences(most_words):
            for at in range(0, len(n), 100_000):
                phrases = [b" ".join([text[w] for w in row]) for row in rows[at : at + 100_000].tolist()]
                m = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(np.full(m, k, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n[at : at + m])], names=["lang", "k", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        known: dict[str, Words] = defaultdict(Words)
        runs: dict[str, Counter] = defaultdict(Counter)
        single: dict[str, np.ndarray] = {}
        size = vocabulary = 0
        for lang, texts in _gathered(batches):
            words, own = known[lang], runs[lang]
            before = len(words.number)
            ids = words.numbers(texts)
            keys = words.keys(lang)
            vocabulary += len(keys) - before
            common = _in(bits, keys)
            common[0] = False
            fits = common[ids]
            tied = fits[:-1] & fits[1:]
            at = np.flatnonzero(tied)
            tied[at] = _in(bits, pair_keys(keys[ids[at]], keys[ids[at + 1]]))
            starts = np.flatnonzero(fits & ~np.concatenate(([False], tied)))
            ends = np.flatnonzero(fits & ~np.concatenate((tied, [False]))) + 1
            alone = ends - starts == 1
            seen = np.bincount(ids[starts[alone]], minlength=len(keys))
            seen[: len(single.get(lang, ()))] += single.get(lang, 0)
            single[lang] = seen
            raw = ids.tobytes()
            for s, e in zip((4 * starts[~alone]).tolist(), (4 * ends[~alone]).tolist(), strict=True):
                key = raw[s:e]
                if key in own:
                    own[key] += 1
                else:
                    own[key] = 1
                    size += (e - s) // 4
            if size > SHARD_WORDS or vocabulary > VOCABULARY:
                for name in known:
                    yield from shard(name, known[name], runs[name], single[name])
                known, runs, single, size, vocabulary = defaultdict(Words), defaultdict(Counter), {}, 0, 0
        for name in known:
            yield from shard(name, known[name], runs[name], single[name])

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of up to most_words words that occur `least` times, and (lang, n) of all words."""
    bounded_batches(docs.sparkSession)
    given = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    hashed = given.mapInArrow(_hashed, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    sums = written(hashed.where(F.col("lang").isNotNull() | (F.col("n") >= least)), "hash-counts")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_bits(sums.where("lang is null").select("key")))
    counted = given.mapInArrow(_shards(shared, most_words), "lang string, k int, phrase string, n bigint").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return written(counted.where(F.col("n") >= least), "phrases"), sums.where("lang is not null").select("lang", "n")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and bytes.

    A phrase of 2 to most_words words inside one piece (between any of .,;:!? and line ends) that occurs
    a >= least times scores floor(scale * a / (l + r)) at the cut, after its first word or a later one,
    where that is least; l and r count the two parts.  A phrase inside a longer one that has `share`
    hundredths of its count is left out.  n counts the words of the language; a null language is `und`.
    Only A to Z are lowered.  Null and empty texts have no words; repeated rows count each; further
    columns are not read; an empty table gives an empty result.
    """
    counts, totals = phrase_counts(docs, text_col, lang_col, most_words, least)
    own = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    links = own.where("k > 2").select("lang", "a", F.explode(F.array(joined(2, F.col("k") - 1), joined(1, F.col("k") - 1))).alias("phrase"))
    around = links.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    left = own.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("a") * share)).drop("around")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(1, F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    met = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"CAST({scale} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))")
    lowest = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    ranked = lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(most_words: int = MOST_WORDS, least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP, scale: int = SCALE) -> str:
    lengths = ", ".join(f"({k})" for k in range(1, most_words + 1))
    return rf"""WITH pieces AS (SELECT COALESCE(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
several AS (SELECT lang, piece, count(*) AS m FROM pieces GROUP BY lang, piece),
w AS (SELECT lang, m, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM several),
totals AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES {lengths}) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, sum(m)::BIGINT AS n FROM grams GROUP BY lang, k, phrase HAVING sum(m) >= {least}),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT c.lang, c.a AS longer, array_to_string(c.w[i.i:i.i + j.k - 1], ' ') AS phrase FROM c, (VALUES {lengths}) AS i(i), (VALUES {lengths}) AS j(k) WHERE j.k > 1 AND j.k < c.k AND i.i + j.k - 1 <= c.k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.lang = c.lang AND inner_.phrase = c.phrase AND 100::HUGEINT * longer >= {share}::HUGEINT * a)),
parts AS (SELECT kept.lang, kept.phrase, a, t.j, array_to_string(kept.w[1:t.j], ' ') AS head, array_to_string(kept.w[t.j + 1:], ' ') AS tail FROM kept JOIN (VALUES {lengths}) AS t(j) ON t.j < kept.k),
cuts AS (SELECT parts.lang, parts.phrase, a, parts.j, l.n AS l, r.n AS r, ({scale}::HUGEINT * a // (l.n + r.n))::BIGINT AS score FROM parts
  JOIN f l ON l.lang = parts.lang AND l.phrase = parts.head JOIN f r ON r.lang = parts.lang AND r.phrase = parts.tail),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
