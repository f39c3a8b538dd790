"""What a query asks for: a pattern of labelled nodes and typed edges, a predicate, and what to return."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from motifold.functions import boolexpr as bx
from motifold.functions.predicates import Condition, Property


@dataclass(frozen=True)
class Node:
    name: str
    labels: frozenset[str] = frozenset()
    anonymous: bool = False

    @property
    def signature(self) -> str:
        return hashlib.md5("|".join([self.name, *sorted(self.labels)]).encode()).hexdigest()


@dataclass(frozen=True)
class Edge:
    """From src to dst, or either way. types: alternatives; none: any type."""

    name: str
    src: str
    dst: str
    types: tuple[str, ...] = ()
    undirected: bool = False
    anonymous: bool = False

    @property
    def signature(self) -> str:
        return hashlib.md5("|".join([self.name, self.src, self.dst, *self.types, str(self.undirected)]).encode()).hexdigest()


@dataclass
class Where:
    expression: bx.Expr
    conditions: dict[str, Condition]


@dataclass(frozen=True)
class Item:
    """A returned node or edge variable, or a property of one."""

    variable: str
    prop: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.variable if self.prop is None else f"{self.variable}.{self.prop}")


@dataclass
class Return:
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[Item, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None

    def add(self, item: Item) -> None:
        if item not in self.items:
            self.items.append(item)

    def remove(self, item: Item) -> None:
        self.items.remove(item)


@dataclass
class Statuses:
    """Tests kept by status and key; matching does not use them."""

    by_status: dict[str, dict[str, Property]] = field(default_factory=dict)

    def put(self, status: str, key: str, test: Property) -> None:
        self.by_status.setdefault(status, {})[key] = test

    def get(self, status: str, key: str) -> Property | None:
        return self.by_status.get(status, {}).get(key)

    @property
    def signature(self) -> str:
        return hashlib.md5(repr(sorted((s, k, repr(p)) for s, d in self.by_status.items() for k, p in d.items())).encode()).hexdigest()


@dataclass
class Pattern:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: dict[str, Edge] = field(default_factory=dict)
    where: Where | None = None
    returned: Return | None = None

    def add_node(self, node: Node) -> Node:
        """A variable has the labels of all its occurrences."""
        if (known := self.nodes.get(node.name)) is not None:
            node = replace(known, labels=known.labels | node.labels)
        self.nodes[node.name] = node
        return node

    def add_edge(self, edge: Edge) -> Edge:
        for end in (edge.src, edge.dst):
            if end not in self.nodes:
                raise KeyError(f"edge {edge.name} has no node {end}")
        if edge.name in self.edges:
            raise KeyError(f"two edges are named {edge.name}")
        self.edges[edge.name] = edge
        return edge

    def remove_edge(self, name: str) -> None:
        del self.edges[name]

    def remove_node(self, name: str) -> None:
        self.edges = {n: e for n, e in self.edges.items() if name not in (e.src, e.dst)}
        del self.nodes[name]

    def outgoing(self, node: str) -> list[Edge]:
        return [e for e in self.edges.values() if e.src == node or (e.undirected and e.dst == node)]

    def incoming(self, node: str) -> list[Edge]:
        return [e for e in self.edges.values() if e.dst == node or (e.undirected and e.src == node)]

    def either(self, node: str) -> list[Edge]:
        return [e for e in self.edges.values() if node in (e.src, e.dst)]

    @property
    def connected(self) -> bool:
        """Whether edges lead from any node to every other."""
        seen, left = set(list(self.nodes)[:1]), list(self.edges.values())
        while near := [e for e in left if e.src in seen or e.dst in seen]:
            seen |= {v for e in near for v in (e.src, e.dst)}
            left = [e for e in left if e not in near]
        return len(seen) == len(self.nodes)

    @property
    def named_nodes(self) -> list[str]:
        return [n.name for n in self.nodes.values() if not n.anonymous]
