"""Top-k search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from loomgraph.llm import pivot_search

VECTORS = "vec_id long, embedding array<float>, row string"


def brute(rows, k, every, scale=1024):
    """Result rows by plain loops, in whole numbers of Python."""
    whole = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        others = [(sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(whole) if m != n and len(w) == len(v)]
        others.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(others[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **settings):
    got = pivot_search.top_k(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), **settings)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(rng, n, dim, centres):
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 16), (3, 1)])
def test_top_k_is_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pivot_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivot_search, "DIRECTORY", 3)
    monkeypatch.setattr(pivot_search, "PACKS", 4)
    rng = random.Random(seed)
    rows = clusters(rng, 160, 8, 5)
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # a group of copies: ties by id
    rows += [(2000, None), (2001, []), (2010, []), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, rows[10][1]), (2020, [0.0] * 8), (2030, [1.0, 2.0]), (2031, [2.0, 1.0])]
    rows += [rows[10], rows[10], rows[11]]  # repeated rows
    rng.shuffle(rows)
    assert found(spark, rows, k=7, every=10) == brute(rows, 7, 10)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.25])]
    assert found(spark, rows) == [(0, 1, 1, 524288), (0, 2, 2, -1048576)]
    assert found(spark, rows[:1]) == []


def test_empty_table_and_no_queries(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**21 for _ in range(6)]) for i in range(30)]
    assert found(spark, rows, k=4, every=5) == brute(rows, 4, 5)


def test_most_candidates_are_never_evaluated(monkeypatch):
    """In clusters the bounds end the search early."""
    rng = np.random.default_rng(5)
    x = np.floor(1024 * (np.repeat(rng.normal(size=(40, 16)) * 4, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.1))
    pivots = pivot_search.choose_pivots(list(x[::7]), 32)
    d = pivot_search.distances(x, pivots)
    n = np.arange(2000)
    block = pivot_search.Side(pivot_search._side(16, n, n, n >= 0, x, d, None))

    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    block.data = block.data.view(Counted)
    places, scores = block.search(x[77], d[77], 10, -np.inf, skip=77)
    wanted = sorted(((int(x[77] @ x[j]), -j) for j in range(2000) if j != 77), reverse=True)[:10]
    assert [(s, -int(p)) for p, s in zip(places, scores, strict=True)] == wanted
    assert sum(seen) < 1000
