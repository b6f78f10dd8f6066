"""SimHash, embedding, line and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from loomgraph.llm import embedding_dedup, line_dedup, simhash, simhash_similar, substring_dedup
from loomgraph.llm.common import components

DOC = "doc_id long, text string"


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    parts = text.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
    return " ".join(parts)


# --- components ---


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    ids = list(range(60))
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)] + [(i, i + 1) for i in range(40, 55)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = {i: r for i, r in groups(ids, links).items() if i != r}
    assert got == wanted


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


# --- SimHash ---


def plain_fingerprint(text):
    parts = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    parts = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in parts]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É b c d e É b c", "x y z w " * 50, "a " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_shingle_hash_is_the_built_in_one(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_anchors_of_linked_halves_meet():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in range(4):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        rows_x, at_x = simhash.anchors_of(x)
        rows_y, at_y = simhash.anchors_of(y)
        for i in range(len(x)):
            assert set(at_x[rows_x == i].tolist()) & set(at_y[rows_y == i].tolist())


def test_large_anchor_groups():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**64, 90, dtype=np.uint64)
    fp = np.unique(np.concatenate([centres ^ (np.uint64(1) << np.uint64(b)) for b in range(9)]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    wanted = groups(range(len(fp)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert simhash.link_group(fp).tolist() == [wanted[i] for i in range(len(fp))]


def simhash_rows(rng):
    base = [words(rng, rng.choice([3, 40, 300])) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base:
        rows += [(len(rows) + k, edited(rng, t, e)) for k, e in enumerate((0, 1, 2))]
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "x y " * 30_000)]


def test_simhash_near_dedup(spark):
    rows = simhash_rows(random.Random(5))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = groups(prints, links)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_near_dedup(frame).collect()}
    assert got == {i: (f"{prints[i]:016x}", wanted[i]) for i in prints}
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(frame).collect())
    assert kept == sorted(i for i in wanted if wanted[i] == i)
    assert simhash.keep_one_of_each(frame).columns == frame.columns


def test_simhash_ties_nulls_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], DOC)
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.simhash_near_dedup(frame).collect()), key=str)
    assert got == [("1", 1), ("1", 1), ("None", 1), ("None", None)]
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_each(frame).collect()) == ["1", "None"]
    empty = spark.createDataFrame([], DOC)
    assert simhash.simhash_near_dedup(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


# --- SimHash with a similarity ---


def plain_grams(text):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if "\t" <= c <= "\r" else c for c in text or "").split(" ")
    parts = [w for w in parts if w]
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def plain_similar(rows, least=0.8):
    grams = [plain_grams(t) for _, t in rows]
    links = []
    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            both = len(a & b)
            if both >= least * (len(a) + len(b) - both):
                links.append((j, i))
    return links


def similar_rows(seed, n_groups=80, size=4):
    """Groups of near copies of every length, at similarities from under 0.8 to 1, and odd texts."""
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = words(rng, rng.choice([12, 40, 120, 400]), 3000)
        n = len(base.split(" "))
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 2 + n // 45)) if k else base) for k in range(size)]
    return [*rows, (9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  two"), (9005, rows[0][1]), (9006, "x y z " * 20_000)]


@pytest.mark.parametrize("most", [20_000, 3])
def test_similar_texts_are_found(spark, most):
    rows = similar_rows(15)
    links = plain_similar(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_texts(frame, most_at_anchor=most).collect()}
    wanted = groups(range(len(rows)), links)
    ids = [i for i, _ in rows]
    for i, r in wanted.items():
        assert plain_similar([rows[i], rows[r]], 0) and wanted[ids.index(got[ids[i]])] == r  # never beyond the true group
    found = sum(got[ids[i]] == got[ids[j]] for i, j in links)
    assert len(links) > 150 and found >= 0.97 * len(links)
    assert got[9001] == got[9002] == got[9000] == 9000 and got[9004] == 9003 and got[9005] == got[0]
    kept = sorted(r.doc_id for r in simhash_similar.keep_one_of_each(frame, most_at_anchor=most).collect())
    assert kept == sorted(set(got.values()))


def test_similar_texts_in_one_large_group(spark):
    """A crowd of near copies, and as many texts that share half of their words."""
    rng = random.Random(16)
    base, half = words(rng, 150, 10**6), words(rng, 60, 10**6)
    rows = [(i, edited(rng, base, 2)) for i in range(150)] + [(200 + i, f"{half} {words(rng, 60, 10**6)}") for i in range(150)]
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_texts(spark.createDataFrame(rows, DOC)).collect()}
    wanted = groups(range(len(rows)), plain_similar(rows))
    truth = {rows[i][0]: rows[r][0] for i, r in wanted.items()}
    assert set(got.items()) <= {(i, r) for i, r in truth.items()} | {(i, i) for i in truth}  # the closest two copies have a similarity near 0.8
    assert sum(got[i] == truth[i] for i in truth) >= 0.99 * len(truth) and len(set(got.values())) <= 153


def family(rng, n, length, vocabulary=10**6):
    """Texts about one base, by numbers of changed words that put pairs at similarities of 0.7 to 0.9."""
    base = words(rng, length, vocabulary)
    most = max(1, length // 50)
    return [edited(rng, base, rng.randrange(1, most + 1)) for _ in range(n)]


def recall(links, got):
    return sum(got[i] == got[j] for i, j in links) / len(links)


def test_families_keep_all_their_links(spark):
    """Ten families of 60 with 4 to 8 changed words in 300: few pairs have the similarity, and those must be found."""
    rng = random.Random(26)
    texts = []
    for _ in range(10):
        base = words(rng, 300, 10**6)
        texts += [edited(rng, base, rng.randrange(4, 9)) for _ in range(60)]
    rows = list(enumerate(texts))
    links = plain_similar(rows)
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_texts(spark.createDataFrame(rows, DOC)).collect()}
    assert len(links) > 30 and recall(links, got) >= 0.98
    assert got == groups(range(len(rows)), [(i, j) for i, j in links if got[i] == got[j]])


def test_a_family_of_five_thousand(spark, monkeypatch):
    """More texts than a block and than an anchor's task holds, at similarities of 0.7 to 0.9."""
    monkeypatch.setattr(simhash_similar, "MOST_AT_ANCHOR", 700)
    rng = random.Random(27)
    texts = [t for k in range(5) for t in family(rng, 1000, 200 + 20 * k)]
    rows = list(enumerate(texts))
    sets = [np.unique(simhash_similar.shingle_set(t.encode()).astype(np.uint32)) for t in texts]
    links = []
    for k in range(5):
        own = sets[1000 * k : 1000 * (k + 1)]
        column = {x: c for c, x in enumerate(np.unique(np.concatenate(own)).tolist())}
        hit = np.zeros((1000, len(column)), np.float32)
        for i, x in enumerate(own):
            hit[i, [column[y] for y in x.tolist()]] = 1
        both, size = hit @ hit.T, hit.sum(axis=1)
        share = both / (size[:, None] + size - both)
        assert 0.6 < np.quantile(share, 0.05) and np.quantile(share, 0.95) < 0.95
        links += [(1000 * k + i, 1000 * k + j) for i, j in zip(*np.nonzero(np.triu(share >= 0.8, 1)), strict=True)]
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_texts(spark.createDataFrame(rows, DOC), most_at_anchor=700).collect()}
    assert len(links) > 1000 and recall(links, got) >= 0.98
    assert got == groups(range(len(rows)), [(i, j) for i, j in links if got[i] == got[j]])


def test_ties_and_links_are_forests_of_all_pairs():
    rng = np.random.default_rng(17)
    sim = np.repeat(rng.integers(0, 2**64, 20, dtype=np.uint64), 30) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    a, b = simhash_similar.ties(sim, np.full(600, 100), np.zeros(600, int))
    assert len(a) == 580
    assert len(set(groups(range(600), zip(a.tolist(), b.tolist(), strict=True)).values())) == 20
    a, b = simhash_similar.ties(sim[:8], np.repeat([100, 200], 4), np.zeros(8, int))
    assert ((a < 4) == (b < 4)).all()
    a, b = simhash_similar.ties(sim[:30], np.full(30, 100), np.repeat([1, 2], 15))
    assert len(set(groups(range(30), zip(a.tolist(), b.tolist(), strict=True)).values())) == 1
    sets = [np.unique(rng.integers(0, 60, 50)) for _ in range(40)] + [np.empty(0, int), np.empty(0, int)]
    for side in (np.zeros(42, int), np.arange(42) % 2 + 1):
        wanted = []
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if both >= 0.5 * (len(x) + len(sets[j]) - both) and (not side.any() or side[i] != side[j]):
                    wanted.append((j, i))
        a, b = simhash_similar.links_of(sets, side, 0.5)
        assert groups(range(42), zip(a.tolist(), b.tolist(), strict=True)) == groups(range(42), wanted)


def test_similar_texts_ties_nulls_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (None, "")], DOC)
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash_similar.similar_texts(frame).collect()), key=str)
    assert got == [("1", 1), ("1", 1), ("None", 1), ("None", None), ("None", None)]
    assert sorted(str(r.doc_id) for r in simhash_similar.keep_one_of_each(frame).collect()) == ["1", "None"]
    empty = spark.createDataFrame([], DOC)
    assert simhash_similar.similar_texts(empty).count() == 0 and simhash_similar.keep_one_of_each(empty).count() == 0


# --- embeddings ---


def brute_embeddings(rows):
    ok = [(i, np.array(v, np.float32).astype(np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v, np.float32)).all() and np.any(np.array(v, np.float32))]
    links = []
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((i, j))
    comp = groups([r[0] for r in rows], links)
    return {i: (sum(i in x for x in links), comp[i], comp[i] == i) for i, _, _ in rows}


def embedding_rows(seed, crowd):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        for c in rng.standard_normal((12, 16)):
            for k in range(int(rng.integers(1, 6))):
                v = c + rng.standard_normal(16) * 0.09 * (k > 0)
                rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1, 7])], label))
        c = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in c + rng.standard_normal(16) * 0.05], label) for k in range(crowd)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [1.0, None, *[0.0] * 14], 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [float("inf"), *[1.0] * 15], 0), (n + 6, rows[0][1], None), (n + 7, rows[0][1][:8], 0), (n + 8, rows[0][1], 0), (n + 9, rows[0][1], 1)]
    return [*rows, *odd]


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = embedding_rows(6, 60)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(frame).collect()}
    assert got == brute_embeddings(rows)


def test_embeddings_window_is_made_good_inside_components(spark):
    rows = embedding_rows(7, 80)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_near_dedup(frame, window=3, passes=8).collect()}
    wanted = {i: v[0] for i, v in brute_embeddings(rows).items()}
    assert sum(min(got[i], wanted[i]) for i in got) >= 0.9 * sum(wanted.values())
    assert all(got[i] <= wanted[i] for i in got)


@pytest.mark.parametrize(("common", "least"), [(0.0, 0.99), (2.0, 0.97), (3.4, 0.9)])
def test_embeddings_recall_in_a_crowded_label(spark, common, least):
    """One label of 8,000 vectors about a common mean, of which 600 have a partner with a cosine just over 0.98; at 3.4 the median cosine of all is 0.92."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((8000, 64)) + common * rng.choice([-1.0, 1.0], 64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((600, 64))
    away -= (away * unit[:600]).sum(axis=1, keepdims=True) * unit[:600]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = (unit[:600] * 0.981 + away * np.sqrt(1 - 0.981**2)) * 3
    v = np.concatenate([x, y]).astype(np.float32)
    frame = spark.createDataFrame([(i, row, 0) for i, row in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.component_id for r in embedding_dedup.embedding_near_dedup(frame).collect()}
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    asked = np.arange(0, len(w), 20)  # queries: ids divisible by 20, against all
    i, j = np.nonzero(w[asked] @ w.T >= 0.98)
    links = [(a, b) for a, b in zip(asked[i].tolist(), j.tolist(), strict=True) if a != b]
    assert len(links) >= 25 and sum(got[a] == got[b] for a, b in links) >= least * len(links)


def test_embeddings_of_extreme_sizes(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.0001e200], 0), (3, [1e-200, 1e-200], 0), (4, [5e-324, 0.0], 0), (5, [1e308, 1e-308], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_embeddings_repeated_rows_null_ids_and_empty(spark):
    v = [1.0, 2.0]
    frame = spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (None, None, None)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(frame).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("None", 0, None, True), ("None", 2, 1, False)]
    assert embedding_dedup.embedding_near_dedup(frame.where("false")).count() == 0


# --- lines ---


def line_rows(seed):
    rng = random.Random(seed)
    lines = [words(rng, rng.choice([2, 6, 9])) for _ in range(60)]
    common = "Released under the same licence as the rest"
    rows = []
    for i in range(40):
        own = [rng.choice(lines) if rng.random() < 0.6 else words(rng, 7, 10**6) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join([*own, *([common] if i % 2 else [])])))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, rows[4][1] + "\n" + words(rng, 8, 10**6)), (53, "\n".join(reversed(rows[5][1].split("\n")))), (54, None), (55, ""), (56, "\n\n"), (57, "\n".join([lines[1]] * 4)), (58, "\n".join(words(rng, 6, 10**6) for _ in range(3000)))]
    return rows


def plain_runs(units, least):
    """Of a text's lines as words: from each and up to each line the shortest run that has `least` words, as (line, end)."""
    runs = set()
    for i in range(len(units)):
        up = next((j for j in range(i + 1, len(units) + 1) if sum(map(len, units[i:j])) >= least), None)
        down = next((h for h in range(i, -1, -1) if sum(map(len, units[h : i + 1])) >= least), None)
        runs |= ({(i, up)} if up else set()) | ({(down, i + 1)} if down is not None else set())
    return sorted(runs) or ([(0, len(units))] if units else [])


def plain_patience(a, b):
    """Aligned index pairs: heads and tails, then by recursion between the longest ascending ways of what is unique in both;
    of such ways the one whose last, last but one... element stands first in b."""
    if not a or not b:
        return set()
    if a[0] == b[0]:
        return {(0, 0)} | {(i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {(len(a) - 1, len(b) - 1)} | plain_patience(a[:-1], b[:-1])
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not once:
        return set()
    far = []
    for k, (_, j) in enumerate(once):
        far.append(1 + max((far[m] for m in range(k) if once[m][1] < j), default=0))
    at = min((k for k in range(len(once)) if far[k] == max(far)), key=lambda k: once[k][1])
    way = [once[at]]
    while far[at] > 1:
        at = min((m for m in range(at) if far[m] == far[at] - 1), key=lambda m: once[m][1])
        way.insert(0, once[at])
    out, (i0, j0) = set(way), (0, 0)
    for i, j in [*way, (len(a), len(b))]:
        out |= {(i0 + x, j0 + y) for x, y in plain_patience(a[i0:i], b[j0:j])}
        i0, j0 = i + 1, j + 1
    return out


def plain_lines(rows, least=5, holders=line_dedup.HOLDERS):
    """For each row its report; by a patience diff with every earlier document that is one of the first `holders` to have one of its seeds."""
    docs = sorted({((i is None, i or 0), xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), t or "") for i, t in rows})
    first, known, by_seed = {}, [], {}
    gone = {}
    for i, _, t in docs:
        lines = [(n, x.split()) for n, x in enumerate(t.split("\n")) if x.strip()]
        units = [w for _, w in lines]
        text = tuple(map(tuple, units))
        runs = plain_runs(units, least)
        whole = sum(map(len, units)) < least
        seeds = [("whole", text) if whole else text[s:e] for s, e in runs]
        out = set()
        if text and text in first:
            out = set(range(len(units)))
        elif text:
            first[text] = i
            for other in sorted({k for s in seeds for k in by_seed.get(s, [])[:holders]}):
                theirs = known[other]
                both = set(seeds) & set(theirs)
                where = [n for n, s in enumerate(seeds) if s in both]
                for _, j in plain_patience([s for s in theirs if s in both], [seeds[n] for n in where]):
                    out |= set(range(*runs[where[j]]))
            for s in set(seeds):
                by_seed.setdefault(s, []).append(len(known))
            known.append(seeds)
        starts = [0] + [n for n, _ in lines[1:]] + [len(t.split("\n"))]
        gone[i, t] = {n for m in out for n in range(starts[m], starts[m + 1])}
    report = []
    for i, t in rows:
        lines = t.split("\n") if t else []
        cut = gone[(i is None, i or 0), t or ""]
        kept = [x for n, x in enumerate(lines) if n not in cut]
        report.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return report


def short_line_rows(seed):
    """Verse and lists: lines of one to three words, in blocks that documents share in differing orders."""
    rng = random.Random(seed)
    blocks = ["\n".join(words(rng, rng.choice([1, 1, 2, 3, 7]), 30) for _ in range(rng.randrange(1, 6))) for _ in range(14)]
    return [(i, "\n".join(rng.choice([rng.choice(blocks), words(rng, rng.choice([1, 2, 6]), 200), ""]) for _ in range(rng.randrange(0, 8)))) for i in range(70)]


@pytest.mark.parametrize("holders", [line_dedup.HOLDERS, 1, 1000])
@pytest.mark.parametrize("rows", [line_rows(8), line_rows(12), short_line_rows(13), short_line_rows(14)])
def test_line_dedup_matches_brute_force(spark, rows, holders):
    """1000 holders are all: every earlier document with a common line is aligned."""
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string").repartition(4)
    got = sorted(tuple(r) for r in line_dedup.line_dedup_report(frame, holders=holders).collect())
    assert got == sorted(plain_lines(rows, holders=holders))
    assert sum(r[2] for r in got) > 30


def test_blocks_rest_on_the_alignment(monkeypatch):
    seeds = [([0, 1], [2, 3]), ([1, 2], [1, 2]), ([2, 3], [0, 1])]
    assert len(line_dedup.aligned_blocks(seeds)) == 1
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.aligned_blocks(seeds) == []


def texts_left(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).collect()}


def test_line_dedup_leaves_one_copy_and_clean_documents(spark):
    clean = "first line of the clean one here\nsecond line of the clean one here"
    rows = [(1, clean), (2, "some shared line that two documents have\nand its own line in this document"), (3, "an own opening line of the third\nsome shared line that two documents have\n\nshort")]
    assert texts_left(spark, [*rows, (4, clean)]) == {1: clean, 2: rows[1][1], 3: "an own opening line of the third\nshort", 4: ""}


P = "\n".join(f"line number {k} of the first passage" for k in range(5))
Q = "\n".join(f"line number {k} of the other passage" for k in range(3))


def test_line_dedup_finds_blocks_in_any_order_and_document(spark):
    """Blocks whose first holder has them in another order than the later document."""
    own = "a line that only the last document has"
    left = texts_left(spark, [(1, f"{P}\n{Q}"), (2, f"{Q}\n{P}"), (3, f"{Q}\n{P}\n{own}")])
    assert left == {1: f"{P}\n{Q}", 2: Q, 3: own}
    one, two = P.split("\n")[:2]
    left = texts_left(spark, [(1, f"{one}\n{two}\na"), (2, f"{two}\n{one}\nb"), (3, f"{two}\n{one}\nc")])
    assert left == {1: f"{one}\n{two}\na", 2: f"{one}\nb", 3: "c"}


def test_line_dedup_keeps_what_stands_in_another_order(spark):
    a, b, c = (f"the {x} line of three in one document" for x in ("first", "second", "third"))
    left = texts_left(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n{b}\n{a}")])
    assert left[1] == f"{a}\n{b}\n{c}" and len(left[2].split("\n")) == 2
    left = texts_left(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n{b}\n{a}"), (3, f"an own line before all the others\n{c}\n{b}\n{a}"), (4, f"{c}\n{b}\n{a}")])
    assert left[3] == "an own line before all the others" and left[4] == ""


@pytest.mark.parametrize(("wrong", "place"), [(3, 3), (4, 4), (5, 0), (60, 60), (300, 150)])
def test_line_dedup_aligns_with_any_holder(spark, wrong, place):
    """Of many holders of two lines one alone has them in the later document's order, and that one need not be among the first."""
    one, two = P.split("\n")[:2]
    rows = [(i if i < place else i + 1, f"{two}\n{one}\nown closing line of document {i}") for i in range(wrong)]
    rows += [(place, f"{one}\n{two}\nown closing line of the other one"), (900, f"{one}\n{two}")]
    assert texts_left(spark, rows)[900] == ""
    assert sorted(line_dedup.line_dedup_report(spark.createDataFrame(rows, DOC)).toPandas().itertuples(index=False, name=None)) == sorted(plain_lines(rows))


@pytest.mark.parametrize("holders", [2, 100, 101, 300])
def test_line_dedup_rule_is_the_same_at_every_count_of_holders(spark, holders):
    passage = "the licence line that all of these have\nshort end\n\nthe second line that all of these have"
    rows = [(i, f"own opening line of document number {i}\n{passage}") for i in range(holders)] + [(900, f"{passage}\n9")]
    got = texts_left(spark, rows)
    assert got.pop(0) == rows[0][1] and got.pop(900) == "9"
    assert got == {i: f"own opening line of document number {i}" for i in range(1, holders)}


def test_line_dedup_short_lines_count_together(spark):
    verse = "and then\n\nthe sea\nwas still"
    assert texts_left(spark, [(1, f"one two\n{verse}"), (2, f"{verse}\nten"), (3, "and then\nnothing"), (4, "was still"), (5, "was still"), (6, "春の海ひねもすのたりのたりかな"), (7, "春の海ひねもすのたりのたりかな\n蕪村")]) == {1: f"one two\n{verse}", 2: "ten", 3: "and then\nnothing", 4: "was still", 5: "", 6: "春の海ひねもすのたりのたりかな", 7: "蕪村"}


def test_line_dedup_keeps_columns_nulls_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "one two three four five six", "a"), (1, "one two three four five six", "b"), (None, "one two three four five six", "c"), (2, None, "d")], "doc_id long, text string, line string")
    done = line_dedup.line_dedup(frame)
    assert done.columns[:3] == frame.columns
    assert sorted((r.line, r.text) for r in done.collect()) == [("a", "one two three four five six"), ("b", "one two three four five six"), ("c", ""), ("d", None)]
    assert line_dedup.line_dedup_report(frame.where("false")).count() == 0
    lines = P.split("\n")
    rows = [(1, "\n".join(lines[:4])), *[(2, f"own line of the repeated second row\n{P}")] * 3, (2, f"{P}\nanother text under the same id"), (None, P), (None, None), (3, " \n\t\n")]
    got = sorted((tuple(r) for r in line_dedup.line_dedup_report(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted(plain_lines(rows), key=str) and sum(r[2] for r in got) >= 17


def test_aligned_blocks():
    later = [(0, 1, "a"), (1, 2, "b"), (2, 3, "m"), (3, 4, "c"), (4, 5, "d"), (9, 10, "a")]
    first = [(0, 1, "a"), (1, 2, "b"), (3, 4, "c"), (4, 5, "d"), (5, 6, "m")]
    flat = lambda rows, x: [p for s, e, y in rows if x == y for p in (s, e)]
    shared = [(flat(later, x), flat(first, x)) for x in "abcdm"]
    assert line_dedup.aligned_blocks(shared) == [(0, 2, 0, 2), (3, 5, 3, 5)]


@pytest.mark.parametrize(("a", "b", "wanted"), [
    ("", "", []), ("abc", "abc", [(0, 0), (1, 1), (2, 2)]), ("abcd", "acbd", [(0, 0), (1, 2), (3, 3)]), ("aab", "ab", [(0, 0), (2, 1)]), ("xax", "yay", [(1, 1)]), ("ab", "ba", [(0, 1)]),
])
def test_patience(a, b, wanted):
    got = line_dedup.patience([c.encode() for c in a], [c.encode() for c in b])
    if (a, b) in (("abcd", "acbd"), ("ab", "ba")):  # either of two crossing lines may be the aligned one
        assert len(got) == len(wanted) and got == sorted(got)
    else:
        assert got == wanted


# --- substrings ---


def substring_rows(seed, window):
    rng = random.Random(seed)
    shared = [words(rng, window + k, 50) for k in (0, 1, 7, 30)]
    rows = []
    for i in range(30):
        parts = [words(rng, rng.randrange(0, 60), 50)]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), words(rng, rng.randrange(0, 20), 50)]
        rows.append((i, " ".join(parts)))
    return [*rows, (40, rows[7][1]), (41, rows[8][1].replace(" ", "\n")), (42, None), (43, ""), (44, "a " * 400), (45, shared[2] + " x " + shared[2]), (46, "b"), (47, " ".join(shared) * 2), (48, "é x " * 300)]


@pytest.mark.parametrize(("seed", "window", "k"), [(9, 35, 9), (10, 12, 4), (11, 12, 12)])
def test_substring_dedup_matches_brute_force(spark, seed, window, k):
    rows = substring_rows(seed, window)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, span int").repartition(4)
    got = sorted(tuple(r) for r in substring_dedup.report(frame, window=window, k=k).collect())
    assert got == sorted(substring_dedup.by_brute_force(rows, window))
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def test_substring_repeated_rows_and_empty(spark):
    text = " ".join(str(i) for i in range(40))
    frame = spark.createDataFrame([(1, text), (1, text), (None, "x"), (None, None)], DOC)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.report(frame).collect())
    assert got == [("1", 40, 40), ("1", 40, 40), ("None", 0, 0), ("None", 1, 0)]
    assert substring_dedup.report(frame.where("false")).count() == 0
