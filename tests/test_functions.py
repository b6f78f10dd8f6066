"""Text functions, contracts and the agent loop."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import agents, contracts, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("ﬁ ①\u00a0\u2003x\x1cy ", "fi 1 x y"), ("", ""), ("a  b", "a b"), (None, None)])
def test_normalize(spark, given, wanted):
    frame = spark.createDataFrame([(given,)], "t string")
    assert frame.select(text.normalize(F.col("t")).alias("x")).first().x == wanted


@pytest.mark.parametrize(("given", "wanted"), [('{"a": 1}', {"a": 1}), ('so {"a": {"b": 2}} done', {"a": {"b": 2}}), ("no data", "no data"), ("} {", "} {"), ('say "hi"', 'say "hi"')])
def test_conclude(spark, given, wanted):
    assert json.loads(one(spark, text.conclude(F.col("t")), t=given)) == wanted
    assert agents.conclusion(given) == wanted


@pytest.mark.parametrize(("path", "pattern", "hit"), [("a/b/c.py", "a/**/*.py", True), ("a/c.py", "a/**/*.py", True), ("a/b/c.py", "a/*.py", False), ("a.py", "?.py", True), ("ab.py", "?.py", False), ("x+y", "x+y", True)])
def test_globs(spark, path, pattern, hit):
    assert one(spark, text.matches_glob(F.col("p"), pattern), p=path) is hit


@pytest.mark.parametrize(("function", "given", "wanted"), [
    (text.slug, "--My App!", "my-app"), (text.slug, "9 lives", "project-9-lives"), (text.stem, "a/b.c.py", "b.c"), (text.stem, "a/.env", ".env"), (text.language, "x/y.TS", "plaintext"), (text.language, "y.tsx", "typescript"),
    (text.pointer_escape, "a~/b", "a~0~1b"), (text.glob_prefix, "src/a/*.py", "src/a/"), (text.fnv1a, "a", 0xE40C292C), (text.is_relative_path, "a..b", False), (text.is_id, "a_1-b", True),
    (text.declares_api_boundary, "# boundary: api", False), (text.declares_api_boundary, "x: { boundary: 'api' }", True), (text.compact, "x" * 161, "x" * 157 + "…"), (text.event_detail, '{"error": "e", "value": 1}', "e"),
])
def test_scalars(spark, function, given, wanted):
    assert one(spark, function(F.col("t")), t=given) == wanted


SOURCE = '''
"""A module."""
from typing import Optional, TypedDict

class Doc(TypedDict):
    id: str
    tags: list[str]

async def handler(doc: Doc, n: int = 3, *, deep: Optional[float]) -> dict[str, int]:
    """First line.

    More."""

def other(x): ...
'''


def test_contract():
    got = contracts.contract(SOURCE)
    assert (got["name"], got["description"], got["isAsync"]) == ("handler", "First line.", True)
    assert [(i["name"], i["required"]) for i in got["inputs"]] == [("doc", True), ("n", False), ("deep", False)]
    assert contracts.spark_type(got["inputs"][0]["schema"]) == "struct<`id`: string, `tags`: array<string>>"
    assert [contracts.spark_type(i["schema"]) for i in got["inputs"][1:]] == ["bigint", "double"]
    assert contracts.spark_type(got["output"]["schema"]) == "variant"
    assert contracts.contract(SOURCE, "other")["inputs"][0]["schema"] is None


@pytest.mark.parametrize("source", ["", "def (", "def a(): ...\ndef b(): ...", "x = 1"])
def test_no_contract(source):
    with pytest.raises(contracts.ContractError):
        contracts.contract(source)


TOOL = agents.Tool("add", lambda a: a["x"] + a["y"], {"type": "object", "required": ["x", "y"], "properties": {"x": {}, "y": {}}})


def scripted(*replies):
    left = list(replies)
    return lambda messages, tools: left.pop(0)


def test_agent_calls_tools_and_concludes():
    events = []
    run = agents.agent(scripted(agents.Reply(calls=(("1", "add", {"x": 1, "y": 2}),)), agents.Reply('it is {"sum": 3}')), "p", [TOOL], on_event=lambda k, v: events.append((k, v)))
    assert run("go") == {"sum": 3}
    assert [k for k, _ in events] == ["node.tool_call", "node.tool_result"] and events[1][1]["output"] == 3


def test_strict_refuses_and_lenient_calls():
    call = agents.Reply(calls=(("1", "add", {"x": 1, "y": 2, "z": 3}),))
    seen = []
    run = agents.agent(scripted(call, agents.Reply("done")), "p", [TOOL], on_event=lambda k, v: seen.append(v))
    run("go")
    assert "unexpected z" in seen[-1]["output"]["error"]
    seen.clear()
    agents.agent(scripted(call, agents.Reply("done")), "p", [TOOL], strict=False, on_event=lambda k, v: seen.append(v))("go")
    assert seen[-1]["output"] == 3


def test_turn_budget():
    loop = agents.Reply(calls=(("1", "none", {}),))
    with pytest.raises(RuntimeError, match="2 turns"):
        agents.agent(scripted(loop, loop, loop), "p", [], most_turns=2)("go")


def test_reply_without_data():
    with pytest.raises(ValueError, match="no parseable JSON"):
        agents.Reply("words").json()


def test_discovery_isolates_errors(spark):
    frame = spark.createDataFrame([("a", "def f(x: int) -> str: ..."), ("b", "def ("), ("c", None)], "path string, content string")
    got = {r.path: r for r in contracts.discover(frame).collect()}
    assert got["a"].name == "f" and got["b"].error.startswith("line 1 is not Python") and got["c"].error


def test_live_functions_as_tools():
    def add(x: int, y: list[str], z: dict[str, int] = None, *rest, **more):
        return x

    tool = agents.tool_of(add)
    assert tool.name == "add" and tool.call({"x": 1, "y": []}) == 1
    assert tool.schema == {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "array", "items": {"type": "string"}}, "z": {"type": "object"}}, "required": ["x", "y"]}


def test_tools_of_globs(spark):
    tools = spark.createDataFrame([("a", 0, "src/*.py", None), ("a", 1, "src/b.py", "g"), ("b", 0, "none/*", None)], "agent string, ord int, entrypoint string, function string")
    files = spark.createDataFrame([("src/a.md", "x"), ("src/b.py", "def f(x: int): ...\ndef _h(): ..."), ("src/c.py", "")], "path string, content string")
    got = {(r.agent, r.ord): r for r in agents.resolve_tools(tools, files).collect()}
    assert got["a", 0].path == "src/b.py" and json.loads(got["a", 0].schema)["required"] == ["x"]
    assert got["a", 1].error == "there is no function g" and got["b", 0].error == "no Python file is none/*"


def test_glob_columns_match_the_plain_regex(spark):
    patterns = ["src/**/*.py", "**/x.md", "a?b/*.[c]", "src/**", "lit.eral/(x)+", "*.py", "docs/{a}|b.md", "a/b/c.py"]
    paths = ["src/a.py", "src/x/y/a.py", "x.md", "q/x.md", "axb/f.[c]", "axb/f.c", "src/x", "lit.eral/(x)+", "litXeral/xx", "m.py", "d/m.py", "docs/{a}|b.md", "a/b/c.py", "a/b/cXpy"]
    from loomgraph.operators.context import glob_matches

    got = glob_matches(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    wanted = {(g, p) for g in patterns for p in paths if re.search(text.glob_regex(g), p)}
    assert {tuple(r) for r in got.collect()} == wanted and len(wanted) == 12


def test_a_hundred_thousand_globs_meet_their_directories(spark):
    from loomgraph.operators.context import glob_matches

    patterns = spark.range(100_000).selectExpr("concat('p', id, '/**/*.py') AS pattern")
    files = spark.range(1000).selectExpr("concat('p', id * 97, '/src/main.', if(id % 2 = 0, 'py', 'md')) AS path")
    got = glob_matches(files, patterns)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert got.count() == 500
