"""A graph over a table of runs: one column for each node, all runs at once.

A run that fails at a node keeps its row: what comes later in the order is null, `failed` says where and
why, and its events end there.
"""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Awaitable, Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from loomgraph.plans.graph import Graph, GraphError

Native = Callable[[Column], Column]


@dataclass(frozen=True)
class Step:
    """What a code or agent node does: a Column function, or a Python function of one value with its result's type."""

    native: Native | None = None
    function: Callable[[Any], Any] | None = None
    #: A function of all values of an Arrow batch; an exception among its results is that row's error.
    batch: Callable[[list[Any]], list[Any]] | None = None
    returns: str = "string"
    #: Agents: not to be evaluated again at will.
    deterministic: bool = True

    def apply(self, value: Column) -> tuple[Column, Column]:
        """The result and the error, one of them null."""
        if self.native is not None:
            return self.native(value), F.lit(None).cast("string")
        if self.batch is not None or inspect.iscoroutinefunction(self.function):
            both = _together(self.batch or gathered(self.function), self.returns, self.deterministic)(value)
        else:
            both = _guarded(self.function, self.returns, self.deterministic)(value)
        return both["value"], both["error"]


def _guarded(function: Callable[[Any], Any], returns: str, deterministic: bool) -> Callable[[Column], Column]:
    """The function over Arrow batches; one row's exception is that row's error."""

    def one(value: Any) -> dict[str, Any]:
        try:
            got = function(value)
            return {"value": asyncio.run(got) if inspect.iscoroutine(got) else got, "error": None}
        except Exception as error:  # noqa: BLE001  a step's own failure is data
            return {"value": None, "error": str(error) or type(error).__name__}

    made = F.udf(one, f"struct<value: {returns}, error: string>", useArrow=True)
    return made if deterministic else made.asNondeterministic()


#: Calls of one batch that are under way together.
AT_ONCE = 100


def gathered(function: Callable[[Any], Awaitable[Any]], at_once: int = AT_ONCE) -> Callable[[list[Any]], list[Any]]:
    """An asynchronous function of one value as one of a batch, whose calls are awaited together."""

    def run(values: list[Any]) -> list[Any]:
        async def every() -> list[Any]:
            gate = asyncio.Semaphore(at_once)

            async def one(value: Any) -> Any:
                async with gate:
                    return await function(value)

            return await asyncio.gather(*map(one, values), return_exceptions=True)

        return asyncio.run(every())

    return run


def _together(batch: Callable[[list[Any]], list[Any]], returns: str, deterministic: bool) -> Callable[[Column], Column]:
    shape = DataType.fromDDL(f"struct<value: {returns}, error: string>")
    kind = to_arrow_type(shape)

    def run(values: pa.Array) -> pa.Array:
        given = values.to_pylist()
        try:
            got = batch(given)
        except Exception as error:  # noqa: BLE001  a step's own failure is data
            got = [error] * len(given)
        rows = [{"value": None, "error": str(x) or type(x).__name__} if isinstance(x, Exception) else {"value": x, "error": None} for x in got]
        try:
            return pa.array(rows, kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError):  # a result of another type is its row's error
            return pa.chunked_array([_row(r, kind) for r in rows], kind).combine_chunks()

    made = F.arrow_udf(run, shape)
    return made if deterministic else made.asNondeterministic()


def _row(row: dict[str, Any], kind: pa.DataType) -> pa.Array:
    try:
        return pa.array([row], kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError) as error:
        return pa.array([{"value": None, "error": str(error)}], kind)


@dataclass
class Compiled:
    """frame: the runs with a column for each node; outputs: io-out id to its column; events: the static steps."""

    frame: DataFrame
    outputs: dict[str, str]
    events: list[tuple[str, str, str, Column | None, Column]] = field(default_factory=list)

    def result(self, *keep: str) -> DataFrame:
        """keep, the outputs, and failed."""
        return self.frame.select(*keep, *[F.col(c).alias(o) for o, c in self.outputs.items()], "failed")

    def log(self, run: str) -> DataFrame:
        """(run_id, seq, type, node_id, graph_path, payload): each run's events, numbered from 0, without a shuffle."""
        started = F.struct(F.lit("run.started").alias("type"), F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("graph_path"), F.lit("{}").alias("payload"))
        rows = [started]
        for kind, node, path, payload, when in self.events:
            body = F.to_json(payload) if payload is not None else F.lit("{}")
            rows.append(F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(node).alias("node_id"), F.lit(path).alias("graph_path"), body.alias("payload"))))
        end = F.when(F.col("failed").isNull(), F.to_json(F.struct(F.lit("finished").alias("status")))).otherwise(F.to_json(F.struct(F.lit("failed").alias("status"), F.col("failed.error").alias("error"))))
        rows.append(F.struct(F.lit("run.finished").alias("type"), F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("graph_path"), end.alias("payload")))
        happened = F.filter(F.array(*rows), lambda x: x.isNotNull())
        return self.frame.select(F.col(run).alias("run_id"), F.posexplode(happened).alias("seq", "e")).select("run_id", F.col("seq").cast("bigint").alias("seq"), "e.type", "e.node_id", "e.graph_path", "e.payload")


@dataclass
class _State:
    frame: DataFrame
    graphs: dict[str, Graph]
    steps: dict[str, Step]
    agents: dict[str, Step]
    events: list = field(default_factory=list)
    made: int = 0


def compile_graph(runs: DataFrame, path: str, graphs: dict[str, Graph], steps: dict[str, Step], agents: dict[str, Step] | None = None, input_column: str = "input") -> Compiled:
    """Compiles the graph at path; steps by entrypoint, agents by ref, subgraphs out of graphs by ref.

    A node that no flow reaches: code is skipped, an output is null and still shown, agents and subgraphs
    run on null.  Of several sources a node gets a struct named by source, in edge order.
    """
    state = _State(runs.withColumn("failed", F.lit(None).cast("struct<node: string, error: string>")), graphs, steps, agents or {})
    outputs = _walk(state, path, F.col(input_column), runs.schema[input_column].dataType.simpleString().startswith("struct"), None, (path,))
    return Compiled(state.frame, outputs, state.events)


def _column(state: _State, value: Column) -> str:
    state.made += 1
    name = f"__node{state.made}"
    state.frame = state.frame.withColumn(name, value)
    return name


def _walk(state: _State, path: str, given: Column, is_struct: bool, shown: str | None, inside: tuple[str, ...]) -> dict[str, str]:
    if path not in state.graphs:
        raise GraphError(f"there is no graph {path}")
    graph = state.graphs[path]
    order = graph.order()
    doors = [n for n in order if n.type == "io" and n.fields.get("direction") == "in"]
    results: dict[str, str] = {}
    outputs: dict[str, str] = {}
    null = F.lit(None).cast("string")
    for node in order:
        sources = graph.into(node.id)
        if node in doors:
            fields = _field_names(state.frame, given) if is_struct and len(doors) > 1 else []
            own = given if len(doors) == 1 else given[node.id] if node.id in fields else null
            results[node.id] = _column(state, own)
            continue
        held = [F.col(results[s]) if s in results else null for s in sources]
        if len(held) == 1:
            value = held[0]
        elif held:
            value = F.struct(*[v.alias(s) for s, v in dict(zip(sources, held, strict=True)).items()])
        elif node.type == "code":
            continue
        else:
            value = null
        alive = F.col("failed").isNull()
        if node.type == "io":
            name = _column(state, F.when(alive, value))
            outputs[node.id] = results[node.id] = name
            _event(state, "node.output", node.id, shown, F.struct(F.col(name).alias("value")), alive)
            continue
        if node.type not in ("code", "agent", "subgraph"):
            raise GraphError(f"node {node.id} cannot run as {node.type}")
        before = _column(state, alive)
        _event(state, "node.started", node.id, shown, None, F.col(before))
        if node.type == "subgraph":
            ref = node.fields["ref"]
            if ref in inside:
                raise GraphError(f"a graph inside itself: {' -> '.join([*inside, ref])}")
            entry = _column(state, value)
            inner = _walk(state, ref, F.col(entry), state.frame.schema[entry].dataType.simpleString().startswith("struct"), ref, (*inside, ref))
            out = F.col(next(iter(inner.values()))) if len(inner) == 1 else F.struct(*[F.col(c).alias(o) for o, c in inner.items()]) if inner else null
            name = _column(state, F.when(F.col("failed").isNull(), out))
        else:
            key, table = (node.fields.get("entrypoint"), state.steps) if node.type == "code" else (node.fields.get("ref"), state.agents)
            if key not in table:
                raise GraphError(f"node {node.id} has no step for {key}")
            step = table[key]
            got, error = step.apply(F.when(F.col(before), value))
            if step.native is not None:
                name = _column(state, F.when(F.col(before), got))
            else:
                pair = _column(state, F.struct(got.alias("value"), error.alias("error")))
                name = _column(state, F.when(F.col(before), F.col(pair)["value"]))
                wrong = F.when(F.col(before) & F.col(pair)["error"].isNotNull(), F.struct(F.lit(node.id).alias("node"), F.col(pair)["error"].alias("error")))
                state.frame = state.frame.withColumn("failed", F.coalesce("failed", wrong))
        results[node.id] = name
        after = _column(state, F.col("failed").isNull())
        _event(state, "node.failed", node.id, shown, F.struct(F.col("failed.error").alias("error")), F.col(before) & ~F.col(after))
        _event(state, "node.finished", node.id, shown, F.struct(F.col(name).alias("output")), F.col(after))
    return outputs


def _field_names(frame: DataFrame, value: Column) -> list[str]:
    return frame.select(value.alias("v")).schema["v"].dataType.fieldNames()


def _event(state: _State, kind: str, node: str, path: str | None, payload: Column | None, when: Column) -> None:
    """Conditions are fixed in a column, as `failed` changes later."""
    state.events.append((kind, node, path, payload, F.col(_column(state, when))))


