"""Agents as steps: a bounded loop of replies and tool calls around an injected client, one conversation a row.

agent() runs a row at a time; in_lockstep() runs all rows of a batch, a round for each turn.
"""

from __future__ import annotations

import ast
import asyncio
import json
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol, get_args

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.contracts import ContractError, Module, contract

MOST_TURNS = 8


@dataclass(frozen=True)
class Tool:
    name: str
    call: Callable[[dict[str, Any]], Any]
    schema: dict[str, Any] = field(default_factory=dict)

    def complaint(self, given: Any) -> str | None:
        """Names only: what is missing, what is unexpected."""
        if self.schema.get("type") != "object":
            return None
        if not isinstance(given, dict):
            return f"call to {self.name} must be an object"
        missing = [k for k in self.schema.get("required") or [] if k not in given]
        known = self.schema.get("properties") or {}
        extra = [k for k in given if known and k not in known]
        said = [f"{what} {', '.join(names)}" for what, names in (("missing", missing), ("unexpected", extra)) if names]
        return f"call to {self.name} does not match its contract: {'; '.join(said)}" if said else None


@dataclass(frozen=True)
class Reply:
    text: str = ""
    calls: tuple[tuple[str, str, Any], ...] = ()  # (call id, tool name, arguments)

    def json(self) -> Any:
        """The conclusion as data; a reply without any raises."""
        got = conclusion(self.text)
        if got is self.text:
            shown = self.text if len(self.text) <= 120 else f"{self.text[:117]}..."
            raise ValueError(f"the reply contains no parseable JSON object: {shown!r}")
        return got


def tool_of(function: Callable[..., Any]) -> Tool:
    """A live function as a tool: its parameters by name, typed where their annotations are plain."""
    import inspect

    taken = [p for p in inspect.signature(function).parameters.values() if p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]

    def typed(note: Any) -> dict[str, Any]:
        if note is inspect.Parameter.empty:
            return {}
        text = note if isinstance(note, str) else note.__name__ if isinstance(note, type) and not get_args(note) else str(note)
        return Module(None).schema(ast.parse(text, mode="eval").body) or {}

    schema = {"type": "object", "properties": {p.name: typed(p.annotation) for p in taken}, "required": [p.name for p in taken if p.default is p.empty]}
    return Tool(function.__name__, lambda given: function(**given), schema)


def resolve_tools(tools: DataFrame, files: DataFrame) -> DataFrame:
    """tools (agent, ord, entrypoint, function) to (agent, ord, path, name, schema, error).

    A glob stands for its first Python file by path.  The schema is the contract's inputs as one object.
    """
    from loomgraph.operators.context import glob_matches

    hits = glob_matches(files.where(F.col("path").endswith(".py")), tools.select(F.col("entrypoint").alias("pattern")))
    first = hits.groupBy(F.col("pattern").alias("entrypoint")).agg(F.min("path").alias("path"))
    met = tools.join(first, "entrypoint", "left").join(files.select("path", "content"), "path", "left")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                try:
                    if r.path is None:
                        raise ContractError(f"no Python file is {r.entrypoint}")
                    got = contract(r.content or "", r.function)
                    ports = got["inputs"]
                    schema = {"type": "object", "properties": {p["name"]: p["schema"] or {} for p in ports}, "required": [p["name"] for p in ports if p["required"]]}
                    rows.append((r.agent, r.ord, r.path, got["name"], json.dumps(schema), None))
                except ContractError as error:
                    rows.append((r.agent, r.ord, r.path, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["agent", "ord", "path", "name", "schema", "error"])

    kinds = {c: tools.schema[c].dataType.simpleString() for c in ("agent", "ord")}
    return met.select("agent", "ord", "path", "entrypoint", "function", "content").mapInPandas(read, f"agent {kinds['agent']}, ord {kinds['ord']}, path string, name string, schema string, error string")


class Client(Protocol):
    """A model; deterministic stubs stand in for it in tests."""

    def __call__(self, messages: list[dict[str, Any]], tools: list[Tool]) -> Reply: ...


def conclusion(text: str) -> Any:
    """The whole text as JSON, else its outermost braces, else the text itself."""
    for part in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return text


def agent(client: Client, prompt: str, tools: list[Tool], most_turns: int = MOST_TURNS, strict: bool = True, on_event: Callable[[str, dict[str, Any]], None] | None = None) -> Callable[[Any], Any]:
    """A function of one value, for plans.compile.Step; a Step with it is to be marked not deterministic.

    Strict answers a call that breaks its contract with the complaint; lenient reports it and calls anyway.
    """
    by_name = {t.name: t for t in tools}
    tell = on_event or (lambda *_: None)

    def run(value: Any) -> Any:
        first = value if isinstance(value, str) else json.dumps(value.asDict(recursive=True) if hasattr(value, "asDict") else value, default=str)
        messages: list[dict[str, Any]] = [{"role": "system", "content": prompt}, {"role": "user", "content": first}]
        for _ in range(most_turns):
            reply = client(messages, tools)
            if not reply.calls:
                return conclusion(reply.text)
            messages.append({"role": "assistant", "content": reply.text, "calls": reply.calls})
            for call, name, given in reply.calls:
                tell("node.tool_call", {"tool": name, "input": given})
                messages.append({"role": "tool", "id": call, "content": _answer(by_name.get(name), name, given, strict, tell)})
        raise RuntimeError(f"the agent used its {most_turns} turns without a conclusion")

    return run


class Clients(Protocol):
    """A model for many conversations at once: a reply, or an exception, for each."""

    def __call__(self, conversations: list[list[dict[str, Any]]], tools: list[Tool]) -> list[Reply | Exception]: ...


def awaited(client: Callable[[list[dict[str, Any]], list[Tool]], Awaitable[Reply]], at_once: int = 100) -> Clients:
    """An asynchronous client of one conversation as one of many: up to at_once requests are under way together."""

    def run(conversations: list[list[dict[str, Any]]], tools: list[Tool]) -> list[Reply | Exception]:
        async def every() -> list[Reply | Exception]:
            gate = asyncio.Semaphore(at_once)

            async def one(messages: list[dict[str, Any]]) -> Reply:
                async with gate:
                    return await client(messages, tools)

            return await asyncio.gather(*map(one, conversations), return_exceptions=True)

        return asyncio.run(every())

    return run


def in_lockstep(clients: Clients, prompt: str, tools: list[Tool], most_turns: int = MOST_TURNS, strict: bool = True, on_event: Callable[[str, dict[str, Any]], None] | None = None) -> Callable[[list[Any]], list[Any]]:
    """A function of a batch of values, for Step(batch=...): in each round the conversations that are still open
    are asked together, so a batch takes as many rounds as its longest conversation has turns.

    A conversation that fails, or has no conclusion after most_turns, gives an exception in its place.
    """
    by_name = {t.name: t for t in tools}
    tell = on_event or (lambda *_: None)

    def run(values: list[Any]) -> list[Any]:
        talks = [[{"role": "system", "content": prompt}, {"role": "user", "content": v if isinstance(v, str) else json.dumps(v, default=str)}] for v in values]
        out: list[Any] = [RuntimeError(f"the agent used its {most_turns} turns without a conclusion")] * len(values)
        open_ = list(range(len(values)))
        for _ in range(most_turns):
            if not open_:
                break
            replies = clients([talks[k] for k in open_], tools)
            still = []
            for k, reply in zip(open_, replies, strict=True):
                if isinstance(reply, Exception):
                    out[k] = reply
                elif not reply.calls:
                    out[k] = conclusion(reply.text)
                else:
                    talks[k].append({"role": "assistant", "content": reply.text, "calls": reply.calls})
                    for call, name, given in reply.calls:
                        tell("node.tool_call", {"tool": name, "input": given})
                        talks[k].append({"role": "tool", "id": call, "content": _answer(by_name.get(name), name, given, strict, tell)})
                    still.append(k)
            open_ = still
        return out

    return run


def _answer(tool: Tool | None, name: str, given: Any, strict: bool, tell: Callable[[str, dict[str, Any]], None]) -> str:
    wrong = tool.complaint(given) if tool else f"there is no tool {name}"
    if wrong and (strict or not tool):
        out: Any = {"error": wrong}
    else:
        if wrong:
            tell("node.tool_result", {"tool": name, "warning": wrong})
        try:
            out = tool.call(given)
        except Exception as error:  # noqa: BLE001  a tool's failure goes back to the model
            out = {"error": str(error)}
    tell("node.tool_result", {"tool": name, "output": out})
    return out if isinstance(out, str) else json.dumps(out, default=str)
