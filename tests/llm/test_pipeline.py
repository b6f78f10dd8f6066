"""The pipeline's stages, each held against brute force on its own input; and the registered queries."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import duckdb
import pytest

from test_near_duplicates import groups, plain_lines, plain_similar
from test_texts import plain_copies

from loomgraph.llm import decontaminate, registry, toxicity

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The input and output rows of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], docs.columns, after.columns)
        docs = after
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_columns(stages):
    for name, (_, _, before, after) in stages.items():
        assert after == (before if name != "mixing" else [*before, "n_epochs"])


def test_toxicity_stage(spark, sf_dir, stages):
    before, after, _, _ = stages["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores, _ = toxicity.score_texts(model, [r["text"] for r in before])
    assert by_id(after) == by_id([r for r, s in zip(before, scores, strict=True) if s < 0.5])
    assert 0 < len(after) < len(before)


def test_line_dedup_stage(stages):
    before, after, _, _ = stages["line_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    wanted = {i: (removed, sha) for i, _, removed, sha in plain_lines(rows)}
    got = by_id(after)
    for r in before:
        removed, sha = wanted[r["doc_id"]]
        if r["doc_id"] in got:
            text = got[r["doc_id"]]["text"]
            assert hashlib.sha256(text.encode()).hexdigest() == sha and got[r["doc_id"]]["n_chars"] == len(text)
        else:
            assert removed > 0


def test_simhash_stage(stages):
    before, after, _, _ = stages["simhash_near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before)
    root = groups(range(len(rows)), plain_similar(rows))
    assert by_id(after) == {i: r for i, r in by_id(before).items() if i in {rows[k][0] for k in root.values()}}


def test_decontamination_stage(spark, sf_dir, stages):
    before, after, _, _ = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = set()
    for t in items:
        w = decontaminate.words_of(t.encode())
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)}
    got = by_id(after)
    for r in before:
        w = decontaminate.words_of(r["text"].encode())
        hit = {x for k in range(len(w)) for n in {len(g) for g in grams} if tuple(w[k : k + n]) in grams for x in range(k, k + n)}
        if len(hit) > decontaminate.MOST_COVERAGE * len(w):
            assert r["doc_id"] not in got
        else:
            kept = decontaminate.words_of(got[r["doc_id"]]["text"].encode())
            assert kept == [x for k, x in enumerate(w) if k not in hit]
            assert hit or got[r["doc_id"]]["text"] == r["text"]


def test_mixing_stage(stages):
    before, after, _, _ = stages["mixing"]
    wanted = {i: n for i, n in plain_copies([tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in before]).items() if n}
    assert {r["doc_id"]: r["n_epochs"] for r in after} == wanted


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    _, after, _, columns = stages["mixing"]
    assert got == sorted(tuple(r[c] for c in columns) for r in after)


def test_run_on_odd_tables(spark, tmp_path):
    """Null and empty texts, ids and columns, repeated rows, one very long text, and tables without rows."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, text_hash string"
    long = " ".join(f"word{k}" for k in range(200_000))
    rows = [(1, None, "en", "src0", 0, "a"), (2, "", None, None, None, "b"), (None, "a text without an id", "en", "src1", 20, None), (3, "one two three four five six", "en", "src0", 27, "c"), (3, "one two three four five six", "en", "src0", 27, "c"), (4, long, "de", "src7", len(long), "d"), (5, "\n\n", "en", "src0", 2, "e")]
    tables = {"labels": ("doc_id long, quality int, toxic int", [(1, 0, None), (None, 1, 1)]), "benchmark": ("item_id long, text string", [(None, None), (1, "")])}
    for name, docs in (("odd", rows), ("none", [])):
        for table, (schema, content) in (tables | {"documents": (columns, docs)}).items():
            spark.createDataFrame(content if docs else [], schema).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        with pytest.warns(UserWarning, match="0 of 2 classes"):
            done = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert done.columns == [*(c.split()[0] for c in columns.split(", ")), "n_epochs"]
        got = done.collect()
        assert len({(r.doc_id, r.text) for r in got}) == len(got) and (bool(got) == bool(docs))
        assert all((r.doc_id, r.text) in {x[:2] for x in rows} for r in got)


def test_every_operator_has_a_query():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    frame = registry.queries()[name](spark, sf_dir)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    wanted = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in frame.collect()), key=str) == wanted
