"""Shapes of JSON values, compiled to Column expressions over VARIANT that list what breaks them.

A shape's issues(value, pointer) is a column of (pointer, message), the pointer after RFC 6901.  A missing
value is SQL null; JSON's null is a value of its own.  Of a union's branches the one with the fewest issues
speaks, the first one on ties.  The expressions stay in the JVM and judge a table of documents in one scan.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import ID_PATTERN, is_relative_path, pointer_escape

ISSUES = "array<struct<pointer:string,message:string>>"


def none() -> Column:
    return F.array().cast(ISSUES)


def issue(pointer: Column, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(pointer.alias("pointer"), text.alias("message"))).cast(ISSUES)


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether a variant is of one of the kinds, as schema_of_variant names them."""
    return F.coalesce(F.schema_of_variant(value).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


class Shape(ABC):
    @abstractmethod
    def issues(self, value: Column, pointer: Column) -> Column: ...


@dataclass(frozen=True)
class Text(Shape):
    """A string that passes the test; the message says what it must be."""

    test: Callable[[Column], Column] = lambda s: s != ""
    message: str = "must not be empty"

    def issues(self, value: Column, pointer: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return F.when(~is_kind(value, "STRING"), issue(pointer, "must be a string")).when(~self.test(text), issue(pointer, self.message)).otherwise(none())


@dataclass(frozen=True)
class Among(Shape):
    """One of some strings."""

    values: tuple[str, ...]

    def issues(self, value: Column, pointer: Column) -> Column:
        ok = is_kind(value, "STRING") & F.coalesce(F.try_variant_get(value, "$", "string").isin(*self.values), F.lit(False))
        return F.when(ok, none()).otherwise(issue(pointer, f"must be {' or '.join(self.values)}"))


@dataclass(frozen=True)
class Number(Shape):
    whole: bool = False
    positive: bool = False

    def issues(self, value: Column, pointer: Column) -> Column:
        number = F.try_variant_get(value, "$", "double")
        ok = is_kind(value, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        if self.whole:
            ok &= number == F.floor(number)
        if self.positive:
            ok &= number > 0
        kind = " ".join([*["positive"] * self.positive, *["whole"] * self.whole, "number"])
        return F.when(F.coalesce(ok, F.lit(False)), none()).otherwise(issue(pointer, f"must be a {kind}"))


@dataclass(frozen=True)
class Items(Shape):
    """An array of one shape."""

    of: Shape

    def issues(self, value: Column, pointer: Column) -> Column:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, k: self.of.issues(x, F.concat(pointer, F.lit("/"), k.cast("string"))))
        return F.when(is_kind(value, "ARRAY"), F.flatten(each)).otherwise(issue(pointer, "must be an array"))


@dataclass(frozen=True)
class Names(Shape):
    """An object of any keys, of one shape if named, with values of another."""

    key: Text | None
    of: Shape

    def issues(self, value: Column, pointer: Column) -> Column:
        def entry(e: Column) -> Column:
            at = F.concat(pointer, F.lit("/"), pointer_escape(e["key"]))
            found = self.of.issues(e["value"], at)
            return found if self.key is None else F.concat(F.when(self.key.test(e["key"]), none()).otherwise(issue(at, self.key.message)), found)

        each = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), entry)
        return F.when(is_kind(value, "OBJECT"), F.flatten(each)).otherwise(issue(pointer, "must be an object"))


@dataclass(frozen=True)
class Fields(Shape):
    """An object with named fields, the optional ones listed; strict: with no others."""

    fields: dict[str, Shape]
    optional: tuple[str, ...] = ()
    strict: bool = False

    def issues(self, value: Column, pointer: Column) -> Column:
        parts = []
        for name, shape in self.fields.items():
            own, at = F.try_variant_get(value, f"$.{name}", "variant"), F.concat(pointer, F.lit(f"/{name}"))
            missing = none() if name in self.optional else issue(at, "is missing")
            parts.append(F.when(own.isNull(), missing).otherwise(shape.issues(own, at)))
        if self.strict:
            others = F.filter(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), lambda k: ~k.isin(*self.fields))
            parts.append(F.when(F.size(others) > 0, issue(pointer, F.concat(F.lit("has unknown fields: "), F.array_join(F.array_sort(others), ", ")))).otherwise(none()))
        return F.when(is_kind(value, "OBJECT"), F.concat(*parts)).otherwise(issue(pointer, "must be an object"))


@dataclass(frozen=True)
class Union(Shape):
    """Any of some shapes."""

    branches: tuple[Shape, ...]

    def issues(self, value: Column, pointer: Column) -> Column:
        found = [branch.issues(value, pointer) for branch in self.branches]
        return F.array_min(F.array(*[F.struct(F.size(x).alias("n"), F.lit(k).alias("nth"), x.alias("issues")) for k, x in enumerate(found)]))["issues"]


@dataclass(frozen=True)
class Tagged(Shape):
    """Objects of several shapes, told apart by one field."""

    tag: str
    shapes: dict[str, Fields] = field(default_factory=dict)

    def issues(self, value: Column, pointer: Column) -> Column:
        said = F.try_variant_get(value, f"$.{self.tag}", "string")
        out = F.when(~is_kind(value, "OBJECT"), issue(pointer, "must be an object"))
        for name, shape in self.shapes.items():
            out = out.when(said == name, shape.issues(value, pointer))
        return out.otherwise(issue(F.concat(pointer, F.lit(f"/{self.tag}")), f"must be {' or '.join(self.shapes)}"))


# --- manifests -------------------------------------------------------------------------------------------

ID = Text(lambda s: s.rlike(ID_PATTERN), "must be an id: small letters, digits, - and _, a letter first, 64 at most")
PATH = Text(is_relative_path, "must be a relative path without two dots")
WORD = Text()
_POINT = Fields({"x": Number(), "y": Number()})
_LAYOUT = Fields({"nodes": Names(None, _POINT)}, ("nodes",))
_METADATA = Fields({"id": ID, "name": WORD}, ("name",))
_END = Fields({"node": ID})


def _document(kind: str, spec: Shape, layout: bool = True) -> Fields:
    head = {"apiVersion": WORD, "kind": Among((kind,)), "metadata": _METADATA, "spec": spec}
    return Fields(head | ({"layout": _LAYOUT} if layout else {}), ("layout",))


def _drawing(kind: str, nodes: Shape, edge: Shape) -> Fields:
    return _document(kind, Fields({"nodes": Items(nodes), "edges": Items(edge)}, ("nodes", "edges")))


COMPOSITION = _drawing("Composition", Tagged("type", {
    "client": Fields({"id": ID, "client": Among(("web", "mobile")), "path": PATH, "dev": WORD}, ("dev",)),
    "boundary": Fields({"id": ID, "boundary": Among(("api", "mcp")), "exposes": Items(ID), "invocation": Names(ID, Among(("sync", "async")))}, ("exposes", "invocation")),
    "service": Fields({"id": ID, "impl": Union((Fields({"graph": PATH}, strict=True), Fields({"entrypoint": PATH}, strict=True)))}),
    "process": Fields({"id": ID, "trigger": Fields({"kind": Among(("schedule",)), "cron": WORD}), "calls": Items(ID)}, ("calls",)),
}), Fields({"id": ID, "kind": Among(("routes-to", "depends-on")), "from": _END, "to": _END}))

GRAPH = _drawing("Graph", Tagged("type", {
    "io": Fields({"id": ID, "direction": Among(("in", "out")), "name": WORD, "schema": PATH, "kind": Among(("progress",))}, ("name", "schema", "kind")),
    "code": Fields({"id": ID, "name": WORD, "include": Items(WORD), "entrypoint": PATH}, ("name", "include", "entrypoint")),
    "agent": Fields({"id": ID, "ref": PATH}), "subgraph": Fields({"id": ID, "ref": PATH}),
}), Fields({"id": ID, "kind": Among(("flow", "capability")), "from": _END, "to": Fields({"node": ID, "function": WORD}, ("function",))}))

AGENT = _document("Agent", Fields({"model": WORD, "promptFile": PATH, "maxTurns": Number(whole=True, positive=True)}, ("model", "maxTurns")), layout=False)

MANIFESTS = Tagged("kind", {"Composition": COMPOSITION, "Graph": GRAPH, "Agent": AGENT})
