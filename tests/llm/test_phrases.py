"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import phrases

DOCS = "doc_id long, lang string, text string, phrase string, n string"


def brute(docs, most=4, least=30, share=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    around = Counter()
    for (lang, w), a in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i : i + k]] = max(around[lang, w[i : i + k]], a)
    rows = []
    for (lang, w), a in held.items():
        if 100 * around[lang, w] >= share * a:
            continue
        score, cut = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows.append((lang, " ".join(w), a, f[lang, w[:cut]], f[lang, w[cut:]], n[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, out = Counter(), []
    for r in rows:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            out.append((r[0], seen[r[0]], *r[1:]))
    return out


def result(spark, docs, **settings):
    frame = spark.createDataFrame([(i, lang, text, "x", "y") for i, (lang, text) in enumerate(docs)], DOCS)
    got = phrases.collocations(frame, **settings)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string")] + [(c, "bigint") for c in ("a", "l", "r", "n", "score")]
    return sorted(tuple(r) for r in got.collect())


def made(rng, n, words):
    out = []
    for _ in range(n):
        out.append(rng.choice(["new york city", "in spite of", "as well as", "The End", *words, *words]))
        out.append(rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ; "]))
    return "".join(out)


@pytest.mark.parametrize(("seed", "shard", "most", "least"), [(1, 150_000, 4, 30), (2, 200, 4, 8), (3, 40, 3, 5), (4, 1, 6, 3)])
def test_collocations_are_brute_force(spark, monkeypatch, seed, shard, most, least):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "BATCH_WORDS", 50)
    monkeypatch.setattr(phrases, "PART", 37)
    rng = random.Random(seed)
    common, rare = [f"w{k}" for k in range(12)] + ["été", "x y", "日本"], [f"r{k}" for k in range(3000)]
    docs = [(rng.choice(["en", "en", "en", "de", None, "und", ""]), made(rng, rng.choice([0, 1, 5, 60]), common + rng.sample(rare, 4))) for _ in range(150)]
    docs += [("en", None), ("en", ""), (None, " . "), ("fr", "."), ("de", made(rng, 3000, common))]
    docs += [("en", "copies go round and round and round")] * 40 + [("fr", "the the the the the the")] * 10
    assert result(spark, docs, most_words=most, least=least) == brute(docs, most, least)


def test_full_bits_lose_no_count(spark, monkeypatch):
    """Where every hash seems frequent, runs stay whole and counts are the same."""
    monkeypatch.setattr(phrases, "frequent_bits", lambda frequent: np.full(8192, 255, np.uint8))
    rng = random.Random(8)
    docs = [("en", made(rng, 50, [f"w{k}" for k in range(9)])) for _ in range(40)]
    assert result(spark, docs, least=10) == brute(docs, least=10)


def test_top_and_ties(spark):
    docs = [("en", "b c. a b. B\tC! a  b? x y z, c d")] * 6
    assert result(spark, docs, least=6, top=2) == brute(docs, least=6, top=2)


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [("en", None), (None, None)]) == []
    assert result(spark, [("en", "one two")], least=2) == []


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_every_sequence(seed):
    rng = random.Random(seed)
    runs = {tuple(rng.randrange(4) for _ in range(rng.randrange(1, 12))): rng.randrange(1, 5) for _ in range(30)}
    automaton, wanted = phrases.Automaton(), Counter()
    for run, weight in runs.items():
        automaton.add(list(run), weight)
        for k in range(1, 5):
            for i in range(len(run) - k + 1):
                wanted[run[i : i + k]] += weight
    got = [(tuple(row), n) for _, rows, counts in automaton.sequences(4) for row, n in zip(rows.tolist(), counts.tolist(), strict=True)]
    assert len(got) == len(dict(got)) and dict(got) == wanted
