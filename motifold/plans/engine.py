"""The engine: queries over a graph, their timings and plans."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from motifold.operators.matching import Matcher
from motifold.plans import cypher
from motifold.plans.graph import LongGraph
from motifold.plans.pattern import Pattern


class Stages:
    """Named wall-clock times."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - begun

    def __str__(self) -> str:
        return "\n".join([*(f"{k}: {v:.3f} s" for k, v in self.seconds.items()), f"total: {sum(self.seconds.values()):.3f} s"])


class Engine:
    def __init__(self, graph: LongGraph, strict_labels: bool = True, need_edge: bool = False, products: bool = True):
        """strict_labels: unknown labels and types match nothing; else they restrict nothing. need_edge: reject patterns without an edge.
        products: answer patterns of several parts that share no node, whose bindings are all combinations; else reject them."""
        self.graph, self.strict_labels, self.need_edge, self.products = graph, strict_labels, need_edge, products

    @classmethod
    def of_database(cls, spark: SparkSession, database: str, as_of: str | None = None, **options: bool) -> Engine:
        """Over the graph stored in a database; with the dynamic properties of a moment, if one is given."""
        from motifold.sources.storage import open_graph

        graph = open_graph(spark, database)
        return cls(graph if as_of is None else graph.as_of(as_of), **options)

    def parse(self, text: str) -> Pattern:
        pattern = cypher.parse(text)
        if self.need_edge and not pattern.edges:
            raise cypher.CypherError("Query must contain at least one edge")
        if not self.products and not pattern.connected:
            raise cypher.CypherError("The pattern's parts share no node, and products are refused")
        return pattern

    def bindings(self, text: str) -> DataFrame:
        """The set of bindings: a column of ids for each named node of the pattern."""
        return Matcher(self.graph, self.parse(text), self.strict_labels).bindings()

    def query(self, text: str) -> DataFrame:
        """What RETURN asks for."""
        return Matcher(self.graph, self.parse(text), self.strict_labels).projected()

    def run(self, text: str) -> tuple[tuple[DataFrame, int] | None, str | None]:
        """Bindings and their count, or what is wrong with the query."""
        found, error, _ = self.run_with_timings(text)
        return found, error

    def run_with_timings(self, text: str) -> tuple[tuple[DataFrame, int] | None, str | None, Stages]:
        """One action: the bindings are counted where they are computed."""
        stages = Stages()
        try:
            with stages.stage("Cypher parsing"):
                pattern = self.parse(text)
        except cypher.CypherError as error:
            return None, str(error), stages
        with stages.stage("Planning"):
            found = Matcher(self.graph, pattern, self.strict_labels).bindings()
        with stages.stage("Matching"):
            count = found.count()
        return (found, count), None, stages

    def explain(self, text: str, mode: str = "formatted") -> None:
        self.bindings(text).explain(mode)

    def show(self, text: str, rows: int = 20) -> None:
        self.query(text).show(rows, truncate=False)
