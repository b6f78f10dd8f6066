"""Edits by spans, and of YAML values in place."""

from __future__ import annotations

import random

import yaml
from pyspark.sql import functions as F

from loomgraph.operators import splices

EDITS = "path string, start int, end int, ord int, text string"


def test_edits_match_plain_slices(spark):
    rng = random.Random(2)
    texts = {f"f{k}": "".join(rng.choice("abc é😀\n") for _ in range(rng.randrange(0, 60))) for k in range(40)}
    edits, wanted, refused = [], {}, {}
    for path, text in texts.items():
        own = [(rng.randrange(0, len(text) + 1), rng.randrange(0, 6), n, rng.choice(["", "X", "é😀", "long text"])) for n in range(rng.randrange(0, 4))]
        own = sorted((s, s + size, n, t) for s, size, n, t in own)
        edits += [(path, *e) for e in own]
        if any(e > len(text) for _, e, _, _ in own):
            refused[path] = "a span is outside the text"
        elif any(a[1] > b[0] for k, b in enumerate(own) for a in own[:k]):
            refused[path] = "spans overlap"
        wanted[path] = text
        if path not in refused:
            for s, e, _, t in reversed(own):
                wanted[path] = wanted[path][:s] + t + wanted[path][e:]
    edits.append(("none", 0, 0, 0, "x"))
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    frame = spark.createDataFrame(edits, EDITS).repartition(3)
    got = {r.path: r.refusal for r in splices.refusals(files, frame).collect()}
    assert got.pop("none") == "no such file" and set(got) == set(refused) and len(refused) > 3
    assert {r.path: r.content for r in splices.spliced(files, frame).collect()} == wanted
    assert splices.spliced(files, frame.where("false")).count() == 40


def test_yaml_values_in_place(spark):
    text = "# a graph\nspec:\n  nodes:   # two\n    - { id: a, type: code,  'name': \"A b\" }\n    - id: b   # the second\n      include: [ 'x/*.py', y ]\n      note: |\n        two\n        lines\n  empty: ''\nlayout: {a/b: 1, ~: 2}\n"
    files = spark.createDataFrame([("g.yaml", text), ("other.yaml", "a: [b"), ("third.yaml", "a: 1\n")], "path string, content string")
    changes = {"/spec/nodes/0/name": "yes", "/spec/nodes/1/id": "second one", "/spec/nodes/1/include/0": "src/**/*.py", "/spec/nodes/1/note": "a: \"b\"\nc", "/spec/empty": "", "/layout/a~1b": "plain"}
    asked = spark.createDataFrame([("g.yaml", k, v) for k, v in changes.items()] + [("g.yaml", "/spec/nodes", "x"), ("g.yaml", "/no", "x"), ("other.yaml", "/a", "x")], "path string, pointer string, value string")
    done, outcome = splices.set_values(files, asked)
    after = {r.path: r.content for r in done.collect()}
    assert after["other.yaml"] == "a: [b" and after["third.yaml"] == "a: 1\n"
    wanted = text.replace('"A b"', '"yes"').replace("id: b ", "id: second one ").replace("'x/*.py'", '"src/**/*.py"').replace("|\n        two\n        lines", '"a: \\"b\\"\\nc"').replace("empty: ''", 'empty: ""').replace("a/b: 1", "a/b: plain")
    assert after["g.yaml"] == wanted
    assert yaml.safe_load(wanted)["spec"]["nodes"][1] == {"id": "second one", "include": ["src/**/*.py", "y"], "note": 'a: "b"\nc'}
    assert {(r.path, r.pointer) for r in outcome.where("refusal is not null").collect()} == {("g.yaml", "/spec/nodes"), ("g.yaml", "/no"), ("other.yaml", "/a")}
    assert spark.range(1).select(splices.pointer_of(F.lit("a/b"), F.lit("~")).alias("p")).first().p == "/a~1b/~0"
