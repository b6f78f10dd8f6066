"""Graph order and compiled runs, held against a plain walk over one value."""

from __future__ import annotations

import asyncio
import json
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import agents
from loomgraph.plans import classify
from loomgraph.plans.compile import Step, compile_graph
from loomgraph.plans.graph import Graph, GraphError
from loomgraph.sources import files


def edge(i, src, dst, kind="flow"):
    return {"id": i, "kind": kind, "from": {"node": src}, "to": {"node": dst}}


def graph(nodes, edges):
    return Graph.parse({"nodes": nodes, "edges": edges})


IN = {"id": "in", "type": "io", "direction": "in"}
OUT = {"id": "out", "type": "io", "direction": "out"}


def code(name, entrypoint="step"):
    return {"id": name, "type": "code", "entrypoint": entrypoint}


def test_order_takes_the_smallest_ready_id():
    g = graph([code(x) for x in "dcba"], [edge("1", "d", "a"), edge("2", "c", "a")])
    assert [n.id for n in g.order()] == ["b", "c", "d", "a"]


def test_capability_edges_order_nothing():
    g = graph([code("a"), code("b")], [edge("1", "b", "a", "capability")])
    assert [n.id for n in g.order()] == ["a", "b"]


def test_a_cycle_names_its_nodes():
    with pytest.raises(GraphError, match="a cycle holds up a, b"):
        graph([code("a"), code("b")], [edge("1", "a", "b"), edge("2", "b", "a")]).order()


def test_an_unknown_end_is_an_error():
    with pytest.raises(GraphError, match="edge 1 ends"):
        graph([code("a")], [edge("1", "a", "x")]).order()


def test_a_failing_run_stops_where_it_fails(spark):
    g = {"g": graph([IN, code("a", "half"), code("b", "add"), OUT], [edge("1", "in", "a"), edge("2", "a", "b"), edge("3", "b", "out")])}

    def half(x):
        if x % 2:
            raise ValueError(f"{x} is odd")
        return x // 2

    runs = spark.createDataFrame([(1, 4), (2, 5)], "run long, input long")
    done = compile_graph(runs, "g", g, {"half": Step(function=half, returns="bigint"), "add": Step(native=lambda c: c + 1)})
    got = {r.run: r for r in done.result("run").collect()}
    assert got[1].out == 3 and got[1].failed is None
    assert got[2].out is None and got[2].failed.asDict() == {"node": "a", "error": "5 is odd"}
    log = [(r.run_id, r.seq, r.type, r.node_id) for r in done.log("run").orderBy("run_id", "seq").collect()]
    assert log == [
        (1, 0, "run.started", None), (1, 1, "node.started", "a"), (1, 2, "node.finished", "a"), (1, 3, "node.started", "b"), (1, 4, "node.finished", "b"), (1, 5, "node.output", "out"), (1, 6, "run.finished", None),
        (2, 0, "run.started", None), (2, 1, "node.started", "a"), (2, 2, "node.failed", "a"), (2, 3, "run.finished", None),
    ]
    end = done.log("run").where("run_id = 2 AND type = 'run.finished'").first().payload
    assert json.loads(end) == {"status": "failed", "error": "5 is odd"}


def test_async_steps_are_awaited(spark):
    async def next_one(x):
        return x + 1

    g = {"g": graph([IN, code("a"), OUT], [edge("1", "in", "a"), edge("2", "a", "out")])}
    runs = spark.createDataFrame([(1, 41)], "run long, input long")
    assert compile_graph(runs, "g", g, {"step": Step(function=next_one, returns="bigint")}).result("run").first().out == 42


def test_several_doors_take_their_own_part(spark):
    doors = [{"id": "a", "type": "io", "direction": "in"}, {"id": "b", "type": "io", "direction": "in"}, {"id": "c", "type": "io", "direction": "in"}]
    g = {"g": graph([*doors, OUT, {"id": "lost", "type": "io", "direction": "out"}], [edge("1", "a", "out"), edge("2", "b", "out")])}
    runs = spark.createDataFrame([(1, (3, 4))], "run long, input struct<a: long, b: long>")
    row = compile_graph(runs, "g", g, {}).result("run").first()
    assert row.out.asDict() == {"a": 3, "b": 4}
    assert row.lost is None


def test_a_subgraph_with_two_outputs_stays_a_struct(spark):
    inner = graph([IN, code("a"), OUT, {"id": "other", "type": "io", "direction": "out"}], [edge("1", "in", "a"), edge("2", "a", "out"), edge("3", "in", "other")])
    outer = graph([IN, {"id": "s", "type": "subgraph", "ref": "inner"}, OUT], [edge("1", "in", "s"), edge("2", "s", "out")])
    runs = spark.createDataFrame([(1, 3)], "run long, input long")
    done = compile_graph(runs, "outer", {"outer": outer, "inner": inner}, {"step": Step(native=lambda c: c * 2)})
    assert done.result("run").first().out.asDict() == {"other": 3, "out": 6}
    paths = {(r.node_id, r.graph_path) for r in done.log("run").collect()}
    assert {("a", "inner"), ("s", None)} <= paths


def test_a_graph_inside_itself_is_refused(spark):
    g = graph([IN, {"id": "s", "type": "subgraph", "ref": "g"}], [edge("1", "in", "s")])
    with pytest.raises(GraphError, match="inside itself"):
        compile_graph(spark.createDataFrame([(1, 3)], "run long, input long"), "g", {"g": g}, {})


def walk(g, value):
    """The plain walk over one value that compiled runs are held against."""
    results, outputs = {}, {}
    for n in g.order():
        sources = g.into(n.id)
        if n.type == "io" and n.fields["direction"] == "in":
            results[n.id] = value
        elif n.type == "io":
            outputs[n.id] = results[n.id] = results.get(sources[0]) if len(sources) == 1 else {s: results.get(s) for s in sources} if sources else None
        elif sources:
            results[n.id] = sum(results.get(s) or 0 for s in sources) + 1
    return outputs


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=7))
def test_random_graphs_run_as_walked(spark, pairs):
    names = ["in", "n1", "n2", "n3", "n4"]
    edges = sorted({(names[min(a, b)], names[max(a, b)]) for a, b in pairs if a != b})
    nodes = [IN, *[code(n, n) for n in names[1:]], OUT]
    g = graph(nodes, [edge(f"e{i}", a, b) for i, (a, b) in enumerate(edges)] + ([edge("z", "n4", "out")] if edges else []))
    flows = {n: g.into(n) for n in names}

    def step(name):
        def native(c):
            if len(flows[name]) == 1:
                return F.coalesce(c.cast("bigint"), F.lit(0)) + 1
            return sum((F.coalesce(c[s].cast("bigint"), F.lit(0)) for s in flows[name]), F.lit(0)) + 1

        return Step(native=native)

    runs = spark.createDataFrame([(1, 5), (2, 7)], "run long, input long")
    done = compile_graph(runs, "g", {"g": g}, {n: step(n) for n in names[1:]}).result("run").collect()
    for row, value in zip(sorted(done), (5, 7), strict=True):
        assert row.out == walk(g, value)["out"]


def test_the_example_graph(spark):
    docs = spark.createDataFrame([(1, "ﬁne\u00a0 text\t①"), (2, "the licence\n of it")], "doc_id long, text string")
    rows = {r.doc_id: r.ledger for r in classify.classify(docs).result("doc_id").collect()}
    assert rows[1].category == "other" and rows[1].related == []
    assert rows[2].category == "contract" and rows[2].related == ["contract-index"]


def test_steps_from_project_files(spark):
    from loomgraph.plans.steps import load_steps
    from loomgraph.sources.files import in_memory

    project = in_memory(spark, {
        "lib/words.py": "def count(text):\n    return len(text.split())\n",
        "steps/size.py": "from lib.words import count\n\ndef handler(text: str) -> int:\n    if not text:\n        raise ValueError('no text')\n    return count(text)\n\ndef other(x): ...\n",
        "steps/more.py": "async def twice(n: int) -> int:\n    return n * 2\n\ndef thrice(n: int) -> int:\n    return n * 3\n", "notes.md": "x",
    })
    steps = load_steps(project, ["steps/size.py", "steps/more.py:twice"])
    g = {"g": graph([IN, code("a", "steps/size.py"), code("b", "steps/more.py:twice"), OUT], [edge("1", "in", "a"), edge("2", "a", "b"), edge("3", "b", "out")])}
    runs = spark.createDataFrame([(1, "one two three"), (2, "")], "run long, input string")
    got = {r.run: r for r in compile_graph(runs, "g", g, steps).result("run").collect()}
    assert got[1].out == 6 and got[2].failed.asDict() == {"node": "a", "error": "no text"}
    with pytest.raises(GraphError, match="no file none.py"):
        load_steps(project, ["none.py"])


def test_an_unknown_node_type_cannot_run(spark):
    g = {"g": graph([IN, {"id": "x", "type": "odd"}], [edge("1", "in", "x")])}
    with pytest.raises(GraphError, match="cannot run as odd"):
        compile_graph(spark.createDataFrame([(1, 3)], "run long, input long"), "g", g, {})


def test_a_step_is_small_however_large_the_project(spark):
    import pickle

    from loomgraph.plans.steps import load_steps

    small = {"steps/one.py": "from lib.big import TEXT\n\n\ndef size(value: str) -> int:\n    return len(TEXT) + len(value)\n", "lib/big.py": "TEXT = 'x'\n"}
    large = small | {"lib/big.py": f"TEXT = '{'x' * 3_000_000}'\n"}
    sizes = []
    for texts, wanted in ((small, 3), (large, 3_000_002)):
        step = load_steps(files.in_memory(spark, texts), ["steps/one.py"])["steps/one.py"]
        sizes.append(len(pickle.dumps(step.function)))
        value, error = step.apply(F.lit("ab"))
        assert [tuple(r) for r in spark.range(2).select(value, error).collect()] == [(wanted, None)] * 2
    assert sizes[0] == sizes[1] < 1000


def test_calls_of_a_batch_are_awaited_together(spark):
    async def slow(value):
        await asyncio.sleep(0.1)
        if value == 3:
            raise ValueError("three")
        return value + 1 if value != 4 else "four"

    value, error = Step(function=slow, returns="bigint").apply(F.col("id"))
    began = time.perf_counter()
    got = [tuple(r) for r in spark.range(0, 200, 1, 1).select("id", value, error).collect()]
    assert time.perf_counter() - began < 10  # one after the other they take 20 seconds
    assert got[:3] == [(0, 1, None), (1, 2, None), (2, 3, None)] and got[3] == (3, None, "three") and got[4][1] is None and got[4][2] and got[199] == (199, 200, None)


def test_agents_in_lockstep_take_a_round_for_each_turn():
    rounds, under_way, most = [], 0, 0

    async def one(messages, tools):
        nonlocal under_way, most
        under_way += 1
        most = max(most, under_way)
        await asyncio.sleep(0.01)
        under_way -= 1
        answered, wanted = sum(m["role"] == "assistant" for m in messages), json.loads(messages[1]["content"])
        if wanted < 0:
            raise RuntimeError("no model")
        return agents.Reply(calls=((str(answered), "echo", {"n": answered}), ("x", "none", {}))) if answered < wanted else agents.Reply('{"turns": %d}' % answered)

    clients = agents.awaited(one)
    run = agents.in_lockstep(lambda talks, tools: (rounds.append(len(talks)), clients(talks, tools))[1], "p", [agents.Tool("echo", lambda given: given)], most_turns=5)
    got = run([0, 2, 4, -1, 9, 0])
    assert [g for g in got if not isinstance(g, Exception)] == [{"turns": 0}, {"turns": 2}, {"turns": 4}, {"turns": 0}]
    assert str(got[3]) == "no model" and "5 turns" in str(got[4])
    assert rounds == [6, 3, 3, 2, 2] and most == 6
    assert run([]) == []
