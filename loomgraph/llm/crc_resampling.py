"""Importance resampling towards a target distribution, with features from a streaming CRC ring.

One scan of a text keeps the running CRC-32 states of the last MOST_WORDS starts; every word extends each
state by a space and the word, starts one more, and all states emit the buckets of the runs that end there.
Bucket counts of all documents and all target texts give each bucket a gain; a document's weight is the sum
of its features' gains, and seeded Gumbel noise on top makes the highest scores a sample without
replacement.  Ranks come from a range-partitioned order and the sizes of its parts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, written
from loomgraph.llm.decontaminate import words_of

#: Features are runs of 1 to MOST_WORDS words.
MOST_WORDS = 1
#: So many counters are held by each task and by the driver.
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a text whose words are split at a time.
PART = 1 << 20


def words_in_parts(text: bytes | None, size: int = PART) -> Iterator[list[bytes]]:
    """The text's words in lists; a long text is cut between words."""
    at, end = 0, len(text) if text else 0
    while at < end:
        cut = text.find(b" ", at + size) if at + size < end else -1
        cut = end if cut < 0 else cut
        yield words_of(text[at:cut])
        at = cut


def ring_states(text: bytes | None, most_words: int) -> tuple[int, array]:
    """How many words the text has, and the CRC-32 of each run of 1 to most_words of them, repeats included."""
    crc, out, ring, n = zlib.crc32, array("I"), [], 0
    for words in words_in_parts(text):
        n += len(words)
        if most_words == 1:
            out.extend(map(crc, words))
            continue
        for word in words:
            more = b" " + word
            ring = [crc(more, state) for state in ring]
            ring.append(crc(word))
            out.extend(ring)
            if len(ring) == most_words:
                del ring[0]
    return n, out


def _scan(most_words: int, buckets: int) -> object:
    """Texts to n_words, n_features and the buckets they emit, each with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, emitted, counts = [], [], [], []
            for text in batch.column("text"):
                n, states = ring_states(text.as_py(), most_words)
                bucket, count = np.unique(np.frombuffer(states, np.uint32) % np.uint32(buckets) if len(states) else np.empty(0, np.uint32), return_counts=True)
                n_words.append(n)
                n_features.append(len(states))
                emitted.append(bucket.astype("<u4").tobytes())
                counts.append(count.astype("<u4").tobytes())
            cols = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(emitted, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_features", "emitted", "counts"])

    return run


def _summed(buckets: int) -> object:
    """Emitted buckets to one sum for each bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            emitted = np.frombuffer(b"".join(batch.column("emitted").to_pylist()), "<u4")
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4")
            np.add.at(total, emitted, counts.astype(np.int64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return run


def scanned(texts: DataFrame, id_col: str, text_col: str, most_words: int, buckets: int) -> DataFrame:
    given = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(_scan(most_words, buckets), f"id {kind}, n_words bigint, n_features bigint, emitted binary, counts binary")


def bucket_counts(scans: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has; one number a bucket comes to the driver."""
    sums = scans.select("emitted", "counts").mapInArrow(_summed(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: the floor of 1000 times the log of its smoothed target share over its smoothed share."""
    n = len(source)
    s_all, t_all = int(source.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(name: str, seed: int) -> int:
    """Gumbel noise in thousandths, from the hash of seed and name."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, scores = [], []
            for name, emitted, counts in zip(*[batch.column(c).to_pylist() for c in ("name", "emitted", "counts")], strict=True):
                weights.append(int(gain[np.frombuffer(emitted, "<u4")] @ np.frombuffer(counts, "<u4").astype(np.int64)))
                scores.append(weights[-1] + noise(name or "", seed))
            cols = [batch.column(c) for c in ("id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], names=["id", "n_words", "n_features", "weight", "score"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their partition and, from 1, their place in it."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        places = np.arange(seen + 1, seen + n + 1)
        seen += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(places)], names=[*batch.schema.names, "part", "place"])


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, 1, 2, 3... in the order given; no task holds more than a range of it.

    The driver gets the size of each range partition.
    """
    spark = rows.sparkSession
    keys = [F.expr(o) if " " not in o else F.expr(o.split()[0]).desc() for o in order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_numbered, f"{schema}, part int, place bigint"), "ranges")
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, before bigint")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (null where it is not drawn), all long but the id.

    Of the documents with at least least_words words, the floor of `percent` in a hundred with the highest
    scores are drawn; equal scores go by smaller id, a null id last.  A null or empty text has no features
    and the weight 0; a null id has the noise of an empty one.  Repeated rows have one score and are drawn
    one by one.  Without target texts all buckets count alike there; an empty table gives an empty result.
    Further columns are not read.
    """
    bounded_batches(docs.sparkSession)
    scans = written(scanned(docs, id_col, text_col, most_words, buckets), "scans")
    wanted = scanned(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", most_words, buckets)
    gain = gains(bucket_counts(scans, buckets), bucket_counts(wanted, buckets))
    kind = scans.schema["id"].dataType.simpleString()
    named = scans.select("id", F.col("id").cast("string").alias("name"), "n_words", "n_features", "emitted", "counts")
    scores = written(named.mapInArrow(_scored(gain, seed), f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"), "scores")
    able = F.col("n_words") >= least_words
    pool = ranked(scores.where(able).withColumn("unnamed", F.col("id").isNull()), "score desc", "unnamed", "id", "n_features", "weight").drop("unnamed")
    drawn = pool.withColumn("rank", F.when(F.col("rank") <= percent * scores.where(able).count() // 100, F.col("rank")))
    rest = scores.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample_sql(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """For runs of one word.  CRC-32 bit by bit: a byte is xored in, then eight steps, marked -1, shift it out."""
    words = r"COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
f AS (SELECT rid, x, count(*) AS c FROM (SELECT rid, unnest(w) AS x FROM d) GROUP BY rid, x),
g AS (SELECT x, count(*) AS c FROM (SELECT unnest({words}) AS x FROM benchmark) GROUP BY x),
vocabulary AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)),
steps AS (SELECT x, list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(h) // 2), lambda i: [('0x' || substr(h, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS s FROM vocabulary),
code AS (SELECT x, xor(list_reduce(s, lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % {buckets} AS bucket FROM steps),
s AS (SELECT bucket, sum(c)::BIGINT AS n FROM f JOIN code USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(c)::BIGINT AS n FROM g JOIN code USING (x) GROUP BY bucket),
total AS (SELECT (SELECT COALESCE(sum(n), 0) FROM s)::DOUBLE + {buckets} AS s_all, (SELECT COALESCE(sum(n), 0) FROM t)::DOUBLE + {buckets} AS t_all),
gain AS (SELECT s.bucket, floor(1000 * ln((COALESCE(t.n, 0) + 1)::DOUBLE * s_all / ((s.n + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
weights AS (SELECT rid, sum(c * gain)::BIGINT AS weight FROM f JOIN code USING (x) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, COALESCE(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{seed}:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (rid)),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
pool AS (SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= {least_words}) OVER () AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank FROM pool"""
