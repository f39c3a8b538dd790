"""Property graphs: where nodes, edges and properties come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from copy import copy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions.predicates import Stored
from motifold.operators import ingest, properties


@dataclass(frozen=True)
class NodeTable:
    """Nodes with one column for each property. labels: those that every node of the table has; more: a column with further labels.

    The frame has node_id and the columns that `stored` names; a property's values may be strings, numbers or arrays of them.
    """

    frame: DataFrame
    labels: frozenset[str]
    stored: dict[str, Stored]
    more: str | None = None

    def select(self, wanted: Iterable[str]) -> DataFrame | None:
        """The nodes that have all wanted labels; None if none can."""
        missing = set(wanted) - self.labels
        if missing and self.more is None:
            return None
        if len(missing) > 1:
            return None
        return self.frame if not missing else self.frame.where(F.col(self.more) == next(iter(missing)))


@dataclass(frozen=True)
class EdgeTable:
    """Edges (source_id, target_id) of one type. unique: no two of them have the same ends."""

    frame: DataFrame
    type: str
    src: frozenset[str]
    dst: frozenset[str]
    unique: bool = False


def _kind(dtype: str, column: Column) -> Stored:
    many = dtype.startswith("array<")
    if "string" in dtype or dtype == "boolean":
        return Stored(strings=column) if many else Stored(string=column.cast("string"))
    if dtype.removeprefix("array<").rstrip(">").split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        return Stored(numbers=column) if many else Stored(number=column)
    return Stored(string=column.cast("string"))


def node_table(frame: DataFrame, key: str, label: str, prefix: str, more: str | None = None) -> NodeTable:
    """Nodes from an ordinary table: ids are prefix:key, and every column is a property."""
    kinds = dict(frame.dtypes)
    wide = frame.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("node_id"), "*")
    return NodeTable(wide, frozenset([label]), {c: _kind(t, F.col(c)) for c, t in kinds.items()}, more)


def edge_table(frame: DataFrame, type_: str, source: tuple[str, str, str], target: tuple[str, str, str], unique: bool = False) -> EdgeTable:
    """Edges from an ordinary table. source, target: column with the key, prefix of ids, label."""
    (a, p, src), (b, q, dst) = source, target
    ends = [F.concat(F.lit(f"{x}:"), F.col(c).cast("string")).alias(n) for c, x, n in ((a, p, "source_id"), (b, q, "target_id"))]
    return EdgeTable(frame.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*ends), type_, frozenset([src]), frozenset([dst]), unique)


#: Suffixes of a long-table property's columns and the part of Stored each is.
_LONG = {"__string": "string", "__numeric": "number", "__strings": "strings", "__numerics": "numbers"}


class LongGraph:
    """A graph from long tables: nodes (node_id, labels), edges (edge_id, source_id, target_id, edge_type), properties of both, and
    their dynamic properties, which have a window from .. to."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, node_props: DataFrame | None = None, edge_props: DataFrame | None = None, node_history: DataFrame | None = None, edge_history: DataFrame | None = None):
        self.nodes, self.edges, self.node_props, self.edge_props = nodes, edges, node_props, edge_props
        self.node_history, self.edge_history = node_history, edge_history

    def as_of(self, moment: str) -> LongGraph:
        """The graph in which dynamic properties that hold at the moment stand beside the static ones."""
        graph = copy(self)
        for static, history in (("node_props", self.node_history), ("edge_props", self.edge_history)):
            if history is not None:
                frames = [f for f in (getattr(self, static), properties.valid_at(history, moment).drop("from", "to")) if f is not None]
                setattr(graph, static, ingest.union(frames))
        return graph

    def domain(self, labels: Iterable[str], names: Iterable[str]) -> tuple[DataFrame, Callable[[str], Stored]]:
        """Nodes with all the labels, as node_id and columns of the named properties; and where each property is."""
        wanted, names = sorted(labels), sorted(names)
        frame = self.nodes
        if wanted:
            frame = frame.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), "labels")) == 0)
        frame = frame.select("node_id")
        if names and self.node_props is not None:
            wide = properties.load_untyped(self.node_props, "node_id", names, frame if wanted else None, tuple(properties.PARTS))
            frame = frame.join(wide, "node_id", "left")
        elif names:
            return frame, lambda p: Stored()
        return frame, lambda p: Stored(**{part: F.col(f"`{p}{s}`") for s, part in _LONG.items()})

    def pairs(self, types: tuple[str, ...], src: frozenset[str], dst: frozenset[str]) -> tuple[DataFrame, bool]:
        """(source_id, target_id) of edges of one of the types (none: any); and whether they may repeat."""
        frame = self.edges.where("source_id != target_id")
        return (frame.where(F.col("edge_type").isin(*types)) if types else frame).select("source_id", "target_id"), True

    def known(self, labels: Iterable[str], types: Iterable[str]) -> tuple[set[str], set[str]]:
        """Which of the names occur."""
        labels, types = sorted(labels), sorted(types)
        have = {r[0] for r in self.nodes.select(F.explode("labels").alias("l")).where(F.col("l").isin(*labels)).distinct().collect()} if labels else set()
        return have, {r[0] for r in self.edges.where(F.col("edge_type").isin(*types)).select("edge_type").distinct().collect()} if types else set()


class StoredGraph(LongGraph):
    """A graph from the ten storage tables. Labels and types are tested on the signatures, of which there are few; only
    node pairs of the signatures that fit are read, and no edges. Nodes without an edge are not stored."""

    def __init__(self, table: Callable[[str], DataFrame]):
        signature = table("node_label_pair").groupBy("pair_id").agg(F.first("src_labels").alias("src_labels"), F.first("dst_labels").alias("dst_labels"), F.first(F.map_keys("edge_1_2_types")).alias("types"))
        self.signatures, self.matches, self.label_names, self.type_names = signature, table("node_pair_matches"), table("metadata_node_labels"), table("metadata_edge_types")
        props = lambda name, key: table(name).drop("created_at", "is_active").withColumnRenamed(key, "row_id")
        self.node_props, self.edge_props = props("node_static_props", "snproperty_id"), props("edge_static_props", "seproperty_id")
        self.node_history, self.edge_history = props("node_dynamic_props", "dnproperty_id"), props("edge_dynamic_props", "deproperty_id")
        ends = self._matching(F.lit(True)).select(F.explode(F.array(F.struct(F.col("source_node_id").alias("node_id"), F.col("src_labels").alias("labels")), F.struct(F.col("target_node_id").alias("node_id"), F.col("dst_labels").alias("labels")))).alias("n")).select("n.*")
        self.nodes = ingest.nodes_of([ends])
        pair = self.matches.select("nodes_match_id", "pair_id", F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id"))
        self.edges = table("edges_matches").join(pair, ["pair_id", "nodes_match_id"]).select("edge_id", "source_id", "target_id", "edge_type")

    def _matching(self, test: Column) -> DataFrame:
        return self.matches.join(self.signatures.where(test), "pair_id")

    def domain(self, labels: Iterable[str], names: Iterable[str]) -> tuple[DataFrame, Callable[[str], Stored]]:
        graph, wanted = copy(self), sorted(labels)
        if wanted:
            fits = lambda c: F.size(F.array_except(F.array(*map(F.lit, wanted)), c)) == 0
            ends = [self._matching(fits(l)).select(F.col(i).alias("node_id"), F.col(l).alias("labels")) for i, l in (("source_node_id", "src_labels"), ("target_node_id", "dst_labels"))]
            graph.nodes = ends[0].unionByName(ends[1]).dropDuplicates(["node_id"])
        return LongGraph.domain(graph, wanted, names)

    def pairs(self, types: tuple[str, ...], src: frozenset[str], dst: frozenset[str]) -> tuple[DataFrame, bool]:
        tests = [F.size(F.array_except(F.array(*map(F.lit, sorted(x))), c)) == 0 for x, c in ((src, "src_labels"), (dst, "dst_labels")) if x]
        if types:
            tests.append(F.arrays_overlap("types", F.array(*map(F.lit, types))))
        # each pair of nodes has one signature, and is stored once for it
        found = self._matching(reduce(lambda a, b: a & b, tests, F.lit(True)))
        return found.select(F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id")), True

    def known(self, labels: Iterable[str], types: Iterable[str]) -> tuple[set[str], set[str]]:
        of = lambda df, c, names: {r[0] for r in df.where(F.col(c).isin(*names)).select(c).distinct().collect()} if names else set()
        return of(self.label_names, "label", sorted(labels)), of(self.type_names, "edge_type", sorted(types))


class TableGraph(LongGraph):
    """A graph over ordinary tables, with a wide node table for each label: only the tables and columns that a query needs are read."""

    def __init__(self, node_tables: list[NodeTable], edge_tables: list[EdgeTable]):
        self.node_tables, self.edge_tables, self.node_history, self.edge_history = node_tables, edge_tables, None, None

    def domain(self, labels: Iterable[str], names: Iterable[str]) -> tuple[DataFrame, Callable[[str], Stored]]:
        labels, names = frozenset(labels), sorted(names)
        found = [(t, f) for t in self.node_tables if (f := t.select(labels)) is not None]
        if not found:
            return self.node_tables[0].frame.select("node_id").where(F.lit(False)), lambda p: Stored()
        parts = {p: [k for k in ("string", "number", "strings", "numbers") if any(getattr(t.stored.get(p, Stored()), k) is not None for t, _ in found)] for p in names}
        types = {"string": "string", "number": "double", "strings": "array<string>", "numbers": "array<double>"}
        frames = []
        for t, f in found:
            columns = []
            for p in names:
                for k in parts[p]:
                    c = getattr(t.stored.get(p, Stored()), k)
                    columns.append((F.lit(None).cast(types[k]) if c is None else c if len(found) == 1 else c.cast(types[k])).alias(f"{p}__{k}"))
            frames.append(f.select("node_id", *columns))
        frame = frames[0]
        for f in frames[1:]:
            frame = frame.unionByName(f)
        return frame, lambda p: Stored(**{k: F.col(f"`{p}__{k}`") for k in parts.get(p, ())})

    def pairs(self, types: tuple[str, ...], src: frozenset[str], dst: frozenset[str]) -> tuple[DataFrame, bool]:
        own = [e for e in self.edge_tables if (not types or e.type in types) and self._can(src, e.src) and self._can(dst, e.dst)]
        if not own:
            return self.edge_tables[0].frame.where(F.lit(False)), False
        frame = own[0].frame
        for e in own[1:]:
            frame = frame.unionByName(e.frame)
        return frame.where("source_id != target_id") if any(e.src & e.dst for e in own) else frame, len(own) > 1 or not own[0].unique

    def _can(self, wanted: frozenset[str], have: frozenset[str]) -> bool:
        """Whether nodes with the labels `have` can have all the wanted ones."""
        return any(t.labels >= have and t.select(wanted) is not None for t in self.node_tables)

    def known(self, labels: Iterable[str], types: Iterable[str]) -> tuple[set[str], set[str]]:
        fixed = set().union(*(t.labels for t in self.node_tables))
        have = {x for x in labels if x in fixed}
        for x in set(labels) - have:
            if any(t.more is not None and not t.frame.where(F.col(t.more) == x).isEmpty() for t in self.node_tables):
                have.add(x)
        return have, {t for t in types if t in {e.type for e in self.edge_tables}}


def from_records(static_nodes: Iterable[DataFrame], static_edges: DataFrame | None, dynamic_nodes: Iterable[DataFrame] = (), dynamic_edges: DataFrame | None = None) -> LongGraph:
    """A graph from node and edge records; dynamic inputs may be missing, and as_of() shows them. Self-loops and edges with a missing end are dropped."""
    static_nodes, dynamic_nodes = list(static_nodes), list(dynamic_nodes)
    nodes = ingest.nodes_of([*static_nodes, *dynamic_nodes])
    edges = ingest.edges_of(static_edges, dynamic_edges)
    ids = nodes.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    own = lambda frames, key, column: (lambda found: ingest.union(found) if found else None)([ingest.unpivot(d, key, column) for d in frames if d is not None and column in d.columns])
    return LongGraph(nodes, kept, own(static_nodes, "node_id", "static_props"), own([static_edges], "edge_id", "static_props"), own(dynamic_nodes, "node_id", "dynamic_props"), own([dynamic_edges], "edge_id", "dynamic_props"))
