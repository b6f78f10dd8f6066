"""Importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from loomgraph.llm import crc_resampling

DOCS = "doc_id long, text string, rank string, part string"
TARGET = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, most):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for texts, into in ((docs, s), (target, t)):
        for _, text in texts:
            for f in features(text, most):
                into[f % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        own = features(text, most)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % buckets] for f in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def made(rng, n):
    pool = [f"w{k}" for k in range(60)] + ["Ünder", "naïve", "DON'T", "x2", "日本"]
    return " ".join(rng.choice(pool) + rng.choice(["", ".", ", ", "\n"]) for _ in range(n))


def result(spark, docs, target, **settings):
    got = crc_resampling.resample(spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS), spark.createDataFrame(target, TARGET), **settings)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (3, 10_000, 35), (2, 7, 100)])
def test_resample_is_brute_force(spark, monkeypatch, most, buckets, percent):
    monkeypatch.setattr(crc_resampling, "PART", 64)
    rng = random.Random(most)
    docs = [(i, made(rng, rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " \n. "), (None, made(rng, 30)), (None, None), (503, made(rng, 5000))]
    docs += [docs[7], docs[7], (900, docs[8][1])] + [(1000 + i, made(random.Random(9), 40)) for i in range(50)]
    target = [(1, made(rng, 50)), (1, made(rng, 8)), (2, None), (None, "w1 w2 w3")]
    assert result(spark, docs, target, most_words=most, buckets=buckets, percent=percent) == brute(docs, target, most, buckets, percent=percent)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = made(random.Random(3), 3000).encode()
    assert [w for part in crc_resampling.words_in_parts(text, 40) for w in part] == [w.encode() for w in words(text.decode())]
    assert list(crc_resampling.words_in_parts(None)) == list(crc_resampling.words_in_parts(b"")) == []
    n, states = crc_resampling.ring_states(text, 4)
    assert n == len(words(text.decode())) and sorted(states) == sorted(features(text.decode(), 4))


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b")]) == []
    docs = [(i, "one two " * 15) for i in range(20)]
    assert result(spark, docs, []) == brute(docs, [])


def test_ranks_over_equal_scores(spark):
    """Rows that are equal in every key still get ranks 1, 2, 3..."""
    rows = spark.createDataFrame([(5, k % 3) for k in range(300)] + [(9, 1)], "score long, id long")
    got = crc_resampling.ranked(rows.repartition(7), "score desc", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 302))
    assert [(r.score, r.id) for r in got] == sorted(((r.score, r.id) for r in got), key=lambda x: (-x[0], x[1]))
