"""The graph description.  A graph has tens of nodes; only its runs are data."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from typing import Any


class GraphError(ValueError):
    """A graph that cannot run."""


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    fields: dict[str, Any] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Edge:
    id: str
    kind: str
    src: str
    dst: str
    function: str | None = None


@dataclass(frozen=True)
class Graph:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]

    @classmethod
    def parse(cls, spec: dict[str, Any]) -> Graph:
        nodes = tuple(Node(n["id"], n["type"], {k: v for k, v in n.items() if k not in ("id", "type")}) for n in spec.get("nodes") or [])
        edges = tuple(Edge(e["id"], e["kind"], e["from"]["node"], e["to"]["node"], e["to"].get("function")) for e in spec.get("edges") or [])
        return cls(nodes, edges)

    @property
    def flow(self) -> list[Edge]:
        return [e for e in self.edges if e.kind == "flow"]

    def into(self, node: str) -> list[str]:
        """Sources that flow into a node, in edge order."""
        return [e.src for e in self.flow if e.dst == node]

    def order(self) -> list[Node]:
        """Topological over flow edges; among ready nodes the smallest id first."""
        known = {n.id: n for n in self.nodes}
        missing = [e.id for e in self.flow if e.src not in known or e.dst not in known]
        if missing:
            raise GraphError(f"edge {missing[0]} ends outside the graph")
        open_ = dict.fromkeys(known, 0)
        after: dict[str, list[str]] = {n: [] for n in known}
        for e in self.flow:
            open_[e.dst] += 1
            after[e.src].append(e.dst)
        ready = [n for n, k in open_.items() if not k]
        heapq.heapify(ready)
        out: list[Node] = []
        while ready:
            now = heapq.heappop(ready)
            out.append(known[now])
            for n in after[now]:
                open_[n] -= 1
                if not open_[n]:
                    heapq.heappush(ready, n)
        if len(out) < len(known):
            raise GraphError(f"a cycle holds up {', '.join(sorted(set(known) - {n.id for n in out}))}")
        return out
