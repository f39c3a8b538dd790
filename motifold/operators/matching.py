"""Matching a pattern: candidates for each query edge, joined along shared variables.

Every variable has a domain: nodes with its labels that pass the tests which the predicate requires of it, with the properties that the rest of the
predicate and the result need. A variable's domain joins once, where the variable first appears. Edges are taken so that each next one shares
a variable with those before, from the most restricted on; parts of a pattern that share nothing are cross-joined, and only these.
Matching is homomorphic: two variables may stand for one node. Results are sets of bindings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions import predicates as P
from motifold.plans.graph import LongGraph
from motifold.plans.pattern import Edge, Pattern


class Matcher:
    def __init__(self, graph: LongGraph, pattern: Pattern, strict_labels: bool = True):
        self.graph, self.pattern = graph, pattern
        self.dropped: set[str] = set()
        if not strict_labels:
            labels = set().union(*(n.labels for n in pattern.nodes.values()))
            types = {t for e in pattern.edges.values() for t in e.types}
            have, have_types = graph.known(labels, types)
            self.dropped = (labels - have) | (types - have_types)
        where = pattern.where
        self.conditions = where.conditions if where else {}
        self.hoisted = P.hoistable(where.expression, self.conditions) if where else {}
        self.rest = P.residual(where.expression, self.conditions, self.hoisted) if where else None
        #: Properties that each variable must carry through the joins, beside those its own tests read.
        self.carried: dict[str, set[str]] = {v: set() for v in pattern.nodes}
        for name in self.rest.variables() if self.rest is not None else ():
            c = self.conditions[name]
            if isinstance(c, P.LiteralCondition):
                self.carried[c.variable].add(c.property.name)
            else:
                self.carried[c.left].add(c.left_property)
                self.carried[c.right].add(c.right_property)
        if pattern.returned:
            for item in [*pattern.returned.items, *(i for i, _ in pattern.returned.order)]:
                if item.prop is not None and item.variable in pattern.nodes:
                    self.carried[item.variable].add(item.prop)
        self.columns: dict[tuple[str, str], P.Stored] = {}

    def _labels(self, variable: str) -> frozenset[str]:
        return self.pattern.nodes[variable].labels - self.dropped

    def domain(self, variable: str) -> DataFrame:
        """The variable's nodes, with the properties that it carries under names of their own."""
        tests = self.hoisted.get(variable, [])
        frame, stored = self.graph.domain(self._labels(variable), {t.name for t in tests} | self.carried[variable])
        if tests:
            frame = frame.where(P.conjuncts(tests, stored))
        out = [F.col("node_id").alias(variable)]
        for p in sorted(self.carried[variable]):
            parts = {}
            for k in ("string", "number", "strings", "numbers"):
                if (c := getattr(stored(p), k)) is not None:
                    name = f"{variable} {p} {k}"
                    out.append(c.alias(name))
                    parts[k] = F.col(f"`{name}`")
            self.columns[variable, p] = P.Stored(**parts)
        return frame.select(*out)

    def candidates(self, edge: Edge) -> DataFrame:
        """Pairs of nodes for the edge's ends; each pair once where the graph may hold it several times."""
        types = tuple(t for t in edge.types if t not in self.dropped)
        a, b = self._labels(edge.src), self._labels(edge.dst)
        frame, repeats = self.graph.pairs(types, a, b)
        if edge.undirected:
            back, _ = self.graph.pairs(types, b, a)
            frame, repeats = frame.unionByName(back.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))), True
        if edge.src == edge.dst:
            return frame.where("source_id = target_id").select(F.col("source_id").alias(edge.src)).distinct()
        pairs = frame.select(F.col("source_id").alias(edge.src), F.col("target_id").alias(edge.dst))
        return pairs.distinct() if repeats else pairs

    def order(self) -> list[Edge]:
        """Edges in connected order, beginning with the one whose ends have the most tests."""
        weight: Callable[[Edge], tuple] = lambda e: (-len(self.hoisted.get(e.src, ())) - len(self.hoisted.get(e.dst, ())), -len(self._labels(e.src)) - len(self._labels(e.dst)))
        left, out, seen = list(self.pattern.edges.values()), [], set()
        while left:
            near = [e for e in left if {e.src, e.dst} & seen] or left
            pick = min(near, key=lambda e: (-len({e.src, e.dst} & seen), *weight(e)))
            left.remove(pick)
            out.append(pick)
            seen |= {pick.src, pick.dst}
        return out

    def joined(self) -> DataFrame:
        """All bindings, as one column for each variable and the carried properties."""
        out: DataFrame | None = None
        bound: set[str] = set()
        for edge in self.order():
            step = self.candidates(edge)
            ends = list(dict.fromkeys([edge.src, edge.dst]))
            for v in ends:
                if v not in bound:
                    step = step.join(self.domain(v), v)
            shared = [v for v in ends if v in bound]
            out = step if out is None else out.join(step, shared) if shared else out.crossJoin(step)
            bound.update(ends)
        for v in self.pattern.nodes:
            if v not in bound:
                alone = self.domain(v)
                out = alone if out is None else out.crossJoin(alone)
        return out if self.rest is None else out.where(P.compile_where(self.rest, self._atom))

    def _atom(self, name: str) -> Column:
        c = self.conditions[name]
        if isinstance(c, P.LiteralCondition):
            return P.compile_property(c.property, self.columns[c.variable, c.property.name])
        return P.compile_comparison(c.op, self.columns[c.left, c.left_property], self.columns[c.right, c.right_property])

    @property
    def _may_repeat(self) -> bool:
        """Node ids are keys and candidates are distinct, so bindings repeat only where a variable is projected away."""
        return len(self.pattern.named_nodes) < len(self.pattern.nodes)

    def bindings(self) -> DataFrame:
        """The set of bindings of the named nodes."""
        out = self.joined().select(*[F.col(f"`{v}`") for v in self.pattern.named_nodes])
        return out.distinct() if self._may_repeat else out

    def projected(self) -> DataFrame:
        """What RETURN asks for, over the set of bindings."""
        returned = self.pattern.returned
        for item in [*returned.items, *(i for i, _ in returned.order)]:
            if item.variable in self.pattern.edges:
                raise ValueError(f"edge {item.variable} can't be returned: results bind nodes")
        carried = [c for (v, _), s in self._with_columns().items() if v in self.pattern.named_nodes for c in s.columns()]
        rows = self._rows.select(*[F.col(f"`{v}`") for v in self.pattern.named_nodes], *carried)
        if self._may_repeat:
            rows = rows.dropDuplicates(self.pattern.named_nodes)
        names = [i.name for i in returned.items]
        values = [self._value(i.variable, i.prop).alias(i.name) for i in returned.items]
        by = {i.name: i for i in returned.items}
        keys = []
        for k, (item, up) in enumerate(returned.order):
            target = by.get(item.variable, item) if item.prop is None else item
            values.append(self._value(target.variable, target.prop).alias(f" order{k}"))
            keys.append(F.col(f"` order{k}`").asc() if up else F.col(f"` order{k}`").desc())
        out = rows.select(*values)
        if returned.distinct:
            out = out.distinct() if not keys else out.dropDuplicates(names)
        if keys:
            out = out.orderBy(*keys)
        if returned.skip:
            out = out.offset(returned.skip)
        if returned.limit is not None:
            out = out.limit(returned.limit)
        return out.select(*[F.col(f"`{n}`") for n in names])

    def _with_columns(self) -> dict[tuple[str, str], P.Stored]:
        self._rows = self.joined()
        return self.columns

    def _value(self, variable: str, prop: str | None) -> Column:
        """A node's id, or the property's value in the type it has; a string where it may have several."""
        if prop is None:
            return F.col(f"`{variable}`")
        found = self.columns[variable, prop].columns()
        if not found:
            return F.lit(None).cast("string")
        return found[0] if len(found) == 1 else F.coalesce(*[c.cast("string") for c in found])


def natural_join(frames: list[DataFrame]) -> DataFrame:
    """Inner joins on all shared columns, left to right, crossing only where none is shared."""

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = sorted(set(a.columns) & set(b.columns))
        return a.join(b, shared) if shared else a.crossJoin(b)

    return reduce(step, frames)


def restrict(domain: DataFrame, variable: str, allowed: DataFrame) -> DataFrame:
    """Rows (q1, q2, t1, t2) of a compatibility domain whose node for the variable is among allowed (node_id)."""
    ids = allowed.select("node_id").distinct()
    out = domain
    for q, t in (("q1", "t1"), ("q2", "t2")):
        kept = out.where(F.col(q) == variable).join(ids, F.col(t) == F.col("node_id"), "left_semi")
        out = kept.unionByName(out.where(F.col(q) != variable))
    return out
