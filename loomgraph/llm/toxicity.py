"""Toxicity by a linear-chain conditional random field over the words of a text.

Two states, clean and toxic.  A word's emission is the sum of the weights of its features (the word, its
first 4 to 7 bytes, a bias); two by two transition weights join neighbours.  Training words are labelled
from the documents' labels: in a toxic document, the words with a feature that is far more frequent in
toxic than in clean documents.  Forward and backward passes give each word's marginal; a logistic
regression on a document's marginals gives its score, and runs of toxic words the offending offsets.
"""

from __future__ import annotations

import re
import warnings
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, written

#: At most so many labelled documents of each class, and so many bytes of each class, fit the model.
TRAIN_DOCS = 2000
TRAIN_BYTES = 4_000_000
#: A text of over one part in so many of a class's bytes is large, and is taken after the class's other texts.
LARGE_PARTS = 100
PREFIXES = (4, 5, 6, 7)
BIAS = b"\x00"
#: Features that may pass for toxic by chance, and the least share of a feature's documents that are toxic.
CHANCE_FEATURES = 10
LEAST_SHARE = 0.75
_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
BLOCK = 64


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACE).split() if text else []


def features(word: bytes) -> list[bytes]:
    """The word itself is marked by a final zero byte, so that it never equals a prefix."""
    return [word + b"\x00", *[word[:k] for k in PREFIXES if len(word) >= k], BIAS]


@dataclass
class Model:
    weights: dict[bytes, float]
    #: Log weights of the transitions [from, to].
    trans: np.ndarray
    #: Of the document features, with the intercept last.
    doc: np.ndarray
    cache: dict[bytes, float] = field(default_factory=dict, repr=False)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Log weight of toxic over clean, by word; the cache is emptied when large."""
        if len(self.cache) > 100_000:
            self.cache.clear()
        cache, weights = self.cache, self.weights
        out = [cache.get(w) for w in words]
        if None in out:
            for i, e in enumerate(out):
                if e is None:
                    w = words[i]
                    e = cache.get(w)
                    if e is None:
                        e = cache[w] = sum(weights.get(f, 0.0) for f in features(w))
                    out[i] = e
        return np.array(out, dtype=np.float64)


def _odds(x: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward messages as odds of toxic over clean before each word's own emission, for texts laid end to end.

    x holds exp(emission).  Texts are cut into blocks; each block's product of 2 x 2 matrices is taken over
    all blocks at once, the blocks of a text are chained, and the words of all blocks are then filled in.
    """
    a = np.exp(trans)
    n_blocks = -(-sizes // BLOCK)
    first = np.concatenate(([0], np.cumsum(n_blocks)[:-1]))
    total = int(n_blocks.sum())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    own = np.repeat(np.arange(len(sizes)), n_blocks)
    nth = np.arange(total) - first[own]
    begin = starts[own] + nth * BLOCK
    length = np.minimum(BLOCK, sizes[own] - nth * BLOCK)
    grid = np.minimum(begin[:, None] + np.arange(BLOCK), len(x) - 1)
    valid = np.arange(BLOCK) < length[:, None]
    xs = np.where(valid, x[grid], 0.0)
    # A word takes (clean, toxic) to (a00 clean + a10 x toxic, a01 clean + a11 x toxic).
    p, q, r, s = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for t in range(BLOCK):
        v, ok = xs[:, t], valid[:, t]
        rx, sx = r * v, s * v
        p1, q1, r1, s1 = a[0, 0] * p + a[1, 0] * rx, a[0, 0] * q + a[1, 0] * sx, a[0, 1] * p + a[1, 1] * rx, a[0, 1] * q + a[1, 1] * sx
        z = p1 + q1 + r1 + s1
        p, q, r, s = np.where(ok, p1 / z, p), np.where(ok, q1 / z, q), np.where(ok, r1 / z, r), np.where(ok, s1 / z, s)
    into = np.ones(total)
    order = np.argsort(-n_blocks, kind="stable")
    sorted_n = n_blocks[order]
    for k in range(1, int(n_blocks.max(initial=0))):
        live = order[: np.searchsorted(-sorted_n, -k, side="left")]
        b = first[live] + k
        m = into[b - 1]
        into[b] = (r[b - 1] + s[b - 1] * m) / (p[b - 1] + q[b - 1] * m)
    out = np.empty(len(x))
    m = into
    for t in range(BLOCK):
        ok = valid[:, t]
        out[grid[ok, t]] = m[ok]
        v = xs[:, t]
        m = np.where(ok, (a[0, 1] + a[1, 1] * v * m) / (a[0, 0] + a[1, 0] * v * m), m)
    return out


def chain(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the marginal of toxic by word, and the forward and backward odds.  sizes are over 0."""
    x = np.exp(np.clip(e, -30, 30))
    forward = _odds(x, sizes, trans)
    # The transposed chain from the other end gives the backward messages.
    backward = _odds(x[::-1], sizes[::-1], trans.T)[::-1]
    odds = forward * x * backward
    return odds / (1 + odds), forward, backward


def pair_counts(e: np.ndarray, forward: np.ndarray, backward: np.ndarray, inner: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected transitions [from, to]; inner marks words that have a next word in their text."""
    x = np.exp(np.clip(e, -30, 30))
    at = np.flatnonzero(inner)
    left = np.stack([np.ones(len(at)), forward[at] * x[at]], axis=1)
    right = np.stack([np.ones(len(at)), backward[at + 1] * x[at + 1]], axis=1)
    joint = left[:, :, None] * np.exp(trans)[None] * right[:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def doc_features(marginals: np.ndarray, token_lists: list[list[bytes]]) -> np.ndarray:
    """By text: log of the expected number of different toxic words, the largest marginal, the log share of toxic words, 1."""
    out = np.zeros((len(token_lists), 4))
    out[:, 3] = 1
    out[:, 0] = out[:, 2] = np.log(1e-3)
    at = 0
    for k, words in enumerate(token_lists):
        if words:
            own = marginals[at : at + len(words)]
            at += len(words)
            different: dict[bytes, float] = {}
            hot = np.flatnonzero(own > 0.02)
            for i, p in zip(hot.tolist(), own[hot].tolist(), strict=True):
                different[words[i]] = max(p, different.get(words[i], 0.0))
            out[k, :3] = np.log(sum(different.values()) + 1e-3), own.max(), np.log(own.mean() + 1e-3)
    return out


def _in_family(words: list[bytes], n: int, seen: dict[int, list[int]]) -> bool:
    """Whether an earlier document of the sample shares 3 of this one's 8 least hashes of three words in a row."""
    least = sorted({zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:8]
    shared = Counter(k for h in least for k in seen.get(h, ()))
    for h in least:
        seen.setdefault(h, []).append(n)
    return bool(shared) and max(shared.values()) >= min(3, len(least))


def _seeds(texts: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Features whose documents are toxic more often than chance gives, at CHANCE_FEATURES by chance among all.

    For a feature in n documents, k of them toxic, chance gives that share or more with a probability of at
    most exp(-n KL(k/n, p)), p being the share of toxic documents.  Of a family of near copies one counts.
    """
    counts = {True: Counter(), False: Counter()}
    sizes = Counter()
    seen: dict[int, list[int]] = {}
    for n, (words, y) in enumerate(zip(texts, toxic, strict=True)):
        if not _in_family(words, n, seen):
            sizes[bool(y)] += 1
            counts[bool(y)].update({f for w in set(words) for f in features(w)[:-1]})
    p = sizes[True] / max(1, sizes.total())
    candidates = {f: k for f, k in counts[True].items() if k > 1}
    if not 0 < p < 1 or not candidates:
        return set()
    least = max(np.log(len(candidates) / CHANCE_FEATURES), 1.0)
    k = np.fromiter(candidates.values(), dtype=np.float64, count=len(candidates))
    n = k + np.fromiter((counts[False].get(f, 0) for f in candidates), dtype=np.float64, count=len(candidates))
    q = k / n
    kl = q * np.log(q / p) + np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - p)), 0.0)
    good = (q >= LEAST_SHARE) & (n * kl >= least)
    return {f for f, ok in zip(candidates, good.tolist(), strict=True) if ok}


def fit(texts: list[str], toxic: list[int], clean_weight: float = 1.0, rounds: int = 25) -> Model:
    """The field is fitted on two of three texts, the regression on the others, which the field has not seen.

    clean_weight: how many clean documents of the corpus one of the sample stands for, against one toxic one.
    """
    every = np.array(toxic, dtype=bool)
    unseen = np.arange(len(texts)) % 3 == 2
    if every[unseen].all() or not every[unseen].any():
        unseen = np.zeros(len(texts), dtype=bool)
    if not every.any() or every.all():
        return Model({}, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, 4.0 if every.any() else -4.0]))
    y = every[~unseen]
    token_lists = [words_of(t) for t, u in zip(texts, unseen, strict=True) if not u]
    seeds = _seeds(token_lists, y)
    sizes = np.array([len(t) for t in token_lists])
    vocabulary: dict[bytes, int] = {}
    index: dict[bytes, int] = {}
    ids, rows = array("i"), []
    for words in token_lists:
        for w in words:
            k = vocabulary.get(w)
            if k is None:
                k = vocabulary[w] = len(rows)
                rows.append([index.setdefault(f, len(index)) for f in features(w) if f in seeds or f == BIAS])
            ids.append(k)
    word = np.array(ids, dtype=np.int32)
    del ids, token_lists, vocabulary
    flat, ends = np.array([f for r in rows for f in r], dtype=np.int64), np.cumsum([len(r) for r in rows])
    begins = np.concatenate(([0], ends[:-1]))
    seeded = np.array([len(r) > 1 for r in rows], dtype=bool)
    some = sizes > 0
    live, live_y = sizes[some], y[some]
    label = seeded[word] & np.repeat(live_y, live)
    inner = np.ones(len(word), dtype=bool)
    inner[np.cumsum(live) - 1] = False
    per_word = np.repeat(np.where(live_y, 1.0, min(clean_weight, 5.0)), live)
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (label[at].astype(int), label[at + 1].astype(int)), 1.0)

    w, trans = np.zeros(len(index)), np.zeros((2, 2))
    sum_w, sum_t = np.full(len(index), 1e-8), np.full((2, 2), 1e-8)
    of_word = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(rounds):
        e = np.add.reduceat(w[flat], begins)[word]
        marginals, forward, backward = chain(e, live, trans)
        by_word = np.bincount(word, weights=(label - marginals) * per_word, minlength=len(rows))
        gw = np.bincount(flat, weights=by_word[of_word], minlength=len(index)) - 0.05 * w
        gt = seen - pair_counts(e, forward, backward, inner, trans) - 0.05 * trans
        sum_w += gw * gw
        sum_t += gt * gt
        w += gw / np.sqrt(sum_w)
        trans += 0.5 * gt / np.sqrt(sum_t)
    names = list(index)
    model = Model({names[i]: float(x) for i, x in enumerate(w) if abs(x) > 1e-3}, trans, np.zeros(4))
    held = np.flatnonzero(unseen if unseen.any() else ~unseen).tolist()
    x = np.concatenate([_text_features(model, texts[k : k + 1]) for k in held])
    model.doc = _logistic(x, every[held], np.where(every[held], 1.0, clean_weight))
    return model


def _text_features(model: Model, texts: list[str | None]) -> np.ndarray:
    return _marginals(model, texts)[1]


def _marginals(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' marginals, the texts' features and their numbers of words."""
    token_lists = [words_of(t) for t in texts]
    sizes = np.array([len(t) for t in token_lists], dtype=np.int64)
    some = sizes > 0
    if not some.any():
        return np.empty(0), doc_features(np.empty(0), token_lists), sizes
    e = np.concatenate([model.emissions(t) for t in token_lists if t])
    marginals = chain(e, sizes[some], model.trans)[0]
    return marginals, doc_features(marginals, token_lists), sizes


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a ridge, halved while the loss grows."""

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(weight @ (np.logaddexp(0, z) - y * z)) + 0.05 * float(beta @ beta)

    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        scale = 1.0
        while loss(beta + scale * step) > loss(beta) and scale > 1e-6:
            scale /= 2
        beta = beta + scale * step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
    """Scores, and by text a flat list of (start, end) code point offsets of its runs of toxic words."""
    marginals, x, sizes = _marginals(model, texts)
    scores = 1 / (1 + np.exp(-np.clip(x @ model.doc, -35, 35)))
    spans, at = [], 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        hot = np.flatnonzero(marginals[at : at + n] >= 0.5)
        at += n
        flat: list[int] = []
        if len(hot):
            where = _offsets(text, hot)
            last = -2
            for k, (a, b) in zip(hot.tolist(), where, strict=True):
                if k == last + 1:
                    flat[-1] = b
                else:
                    flat += [a, b]
                last = k
        spans.append(flat)
    return scores, spans


def _offsets(text: str, words: np.ndarray) -> list[tuple[int, int]]:
    raw = text.encode()
    found = [m.span() for m in _WORD.finditer(raw.translate(_SPACE))]
    heads = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    return [(int(heads[found[k][0]]) - 1, int(heads[found[k][1] - 1])) for k in words.tolist()]


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id is never held out and never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on a bounded sample: of the labelled ids that are in docs with a text and not held out, the first most_docs of each class by the id's hash.

    Of these, texts are taken whole, in that order, while they fit into most_bytes for the class; texts of
    over one part in LARGE_PARTS of most_bytes come after all others, the smaller first, so a large text takes no other's
    place and what the smaller ones leave unused is under one such part.  The first text of a class is
    always taken, so a class with labelled texts has some.  Of several texts under one id the shortest is
    meant.  All is chosen by ids and sizes; only the texts of the sample travel.
    """
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out("i"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    sizes = texts.select("i", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"))
    own = own.groupBy("i").agg(F.max("y").alias("y")).join(texts.select("i"), "i", "leftsemi").withColumn("r", F.xxhash64("i"))
    own = written(own, "labelled")
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    picked = own.where("y = 1").orderBy("r", "i").limit(most_docs).union(own.where("y = 0").orderBy("r", "i").limit(most_docs))
    here = sizes.join(F.broadcast(picked), "i").groupBy("i", "y", "r").agg(F.min(F.struct("n", "h")).alias("s")).select("i", "y", "r", "s.n", "s.h")  # at most 2 x most_docs rows
    large = F.col("n") > most_bytes // LARGE_PARTS
    order = Window.partitionBy("y").orderBy(large, F.when(large, F.col("n")), "r", "i")
    so_far = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = here.withColumn("so_far", so_far).withColumn("place", F.row_number().over(order))
    chosen = ranked.where((F.col("so_far") <= most_bytes) | (F.col("place") == 1)).select("i", "y", "r", "h")
    found = texts.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["i", "h"]).dropDuplicates(["i", "h"])
    rows = found.select("y", "t", "r", "i").orderBy("r", "i").collect()
    used = Counter(r.y for r in rows)
    if len(used) < 2:
        warnings.warn(f"toxicity has labelled texts of {len(used)} of 2 classes to fit on: the score is a constant", stacklevel=2)
    ratio = (counts.get(0, 1) / max(1, used.get(0, 0))) / (counts.get(1, 1) / max(1, used.get(1, 0)))
    return fit([r.t for r in rows], [r.y for r in rows], clean_weight=ratio)


def _scorer(shared: object) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = np.zeros(len(batch)), []
            texts = batch.column("__loom_text").to_pylist()
            at = 0
            while at < len(texts):  # parts of about a million bytes, a text whole
                end, size = at, 0
                while end < len(texts) and (size == 0 or size + len(texts[end] or "") < 1_000_000):
                    size += len(texts[end] or "") + 1
                    end += 1
                scores[at:end], got = score_texts(model, texts[at:end])
                spans += got
                at = end
            names = [c for c in batch.schema.names if c != "__loom_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores), pa.array(spans, pa.list_(pa.int32()))], names=[*names, "__loom_score", "__loom_spans"])

    return run


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __loom_score and __loom_spans (flat starts and ends of toxic runs, in code points)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.withColumn("__loom_text", F.col(text_col))
    schema = docs.withColumn("__loom_score", F.lit(0.0)).withColumn("__loom_spans", F.lit(None).cast("array<int>")).schema
    return given.mapInArrow(_scorer(shared), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted, spans.

    Null and empty texts get the score of a text without toxic words; a null label is no label; an id
    labelled more than once is toxic if any label is; labels for unknown documents are unused.  Without
    labels of both classes the score is a constant.  Empty docs give an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    scored = with_scores(narrow, model).select("i", "__loom_score", "__loom_spans")
    return scored.select(F.col("i").alias(id_col), held_out("i").alias("held_out"), F.col("__loom_score").alias("score"), (F.col("__loom_score") >= 0.5).cast("int").alias("predicted"), F.col("__loom_spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of docs whose score is below most, unchanged."""
    model = train(docs, labels, id_col, text_col, label_col, **bounds)
    return with_scores(docs, model, text_col).where(F.col("__loom_score") < most).select(*[F.col(f"`{c}`") for c in docs.columns])
