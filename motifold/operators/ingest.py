"""From raw node and edge records to graph tables.

Records: nodes (node_id, labels, static_props or dynamic_props with from and to), edges (edge_id, source_id, target_id, edge_type, and the same).
Properties go to long tables with one typed value column for each kind. All functions are lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = ("string_value", "numeric_value", "datetime_value", "string_values", "numeric_values", "datetime_values")
VALUE_TYPES = ("string", "double", "timestamp", "array<string>", "array<double>", "array<timestamp>")


def union(frames: list[DataFrame]) -> DataFrame:
    """By name; a column that one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def edges_of(static: DataFrame | None, dynamic: DataFrame | None = None) -> DataFrame:
    """(edge_id, source_id, target_id, edge_type) without self-loops, each edge id once (the least record). Either input may be missing."""
    columns = ["edge_id", "source_id", "target_id", "edge_type"]
    rows = union([d.select(*[F.col(c).cast("string").alias(c) for c in columns]) for d in (static, dynamic) if d is not None])
    loops = rows.where("source_id != target_id")
    return loops.groupBy("edge_id").agg(F.min(F.struct(*columns[1:])).alias("e")).select("edge_id", "e.*")


def nodes_of(frames: list[DataFrame]) -> DataFrame:
    """(node_id, labels), each node once, with the labels of all its records in order."""
    rows = union([d.select(F.col("node_id").cast("string").alias("node_id"), "labels") for d in frames])
    labels = F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels"))))
    return rows.groupBy("node_id").agg(labels.alias("labels"))


def labelled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; edges with a missing end vanish."""
    ends = [nodes.select(F.col("node_id").alias(f"{e}_id"), F.col("labels").alias(f"{short}_labels")) for e, short in (("source", "src"), ("target", "dst"))]
    return edges.join(ends[0], "source_id").join(ends[1], "target_id").withColumn("nodes_match_id", F.concat_ws("_", "source_id", "target_id"))


def pairs(labelled: DataFrame) -> DataFrame:
    """A row for each ordered pair of nodes with its edge types (sorted, repeated for parallel edges) and the edge ids in the same order."""
    edges = F.array_sort(F.collect_list(F.struct("edge_type", "edge_id")))
    grouped = labelled.groupBy("nodes_match_id", "source_id", "target_id", "src_labels", "dst_labels").agg(edges.alias("e"))
    out = grouped.select("nodes_match_id", "source_id", "target_id", "src_labels", "dst_labels", F.col("e.edge_type").alias("edge_types"), F.col("e.edge_id").alias("edge_ids"))
    return out.withColumn("pair_id", signature_id("src_labels", "dst_labels", "edge_types"))


def signature_id(*columns: str) -> Column:
    """An id that depends on the signature alone, so that it is the same in every load."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def frequencies(array: str) -> Column:
    """A map from each element to how often it occurs."""
    a = F.col(array)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(a)), lambda k: F.struct(k.alias("key"), F.size(F.filter(a, lambda x: x == k)).alias("value"))))


def label_pairs(paired: DataFrame) -> DataFrame:
    """node_label_pair: each signature once, with the frequencies of its types. The maps for other directions are empty by design."""
    none = F.lit(None).cast("map<string,int>")
    distinct = paired.select("pair_id", "src_labels", "dst_labels", "edge_types").distinct()
    return distinct.select("pair_id", "src_labels", "dst_labels", frequencies("edge_types").alias("edge_1_2_types"), none.alias("edge_2_1_types"), none.alias("edge_bi_types"), F.current_timestamp().alias("created_at"))


def node_pair_matches(paired: DataFrame) -> DataFrame:
    return paired.select("nodes_match_id", "pair_id", F.col("source_id").alias("source_node_id"), F.col("target_id").alias("target_node_id"), F.current_timestamp().alias("created_at")).dropDuplicates(["nodes_match_id", "pair_id"])


def edges_matches(paired: DataFrame) -> DataFrame:
    rows = paired.where(F.size("edge_ids") > 0).select("pair_id", "nodes_match_id", F.inline(F.arrays_zip("edge_types", "edge_ids")))
    return rows.select(F.col("edge_ids").alias("edge_id"), "pair_id", "nodes_match_id", F.col("edge_types").alias("edge_type"), F.current_timestamp().alias("created_at"))


def bucket_of(kind: T.DataType) -> str | None:
    """The value column of an input type; None: as JSON in the string column."""
    many = isinstance(kind, T.ArrayType)
    one = kind.elementType if many else kind
    if isinstance(one, T.StringType) or (isinstance(one, T.BooleanType) and not many):
        base = "string"
    elif isinstance(one, T.DoubleType | T.LongType | T.IntegerType):
        base = "numeric"
    elif isinstance(one, T.TimestampType | T.DateType):
        base = "datetime"
    else:
        return None
    return f"{base}_value{'s' if many else ''}"


def field_buckets(df: DataFrame, column: str) -> dict[str, str | None]:
    return {f.name: bucket_of(f.dataType) for f in df.schema[column].dataType.fields}


def expand(name: str, value: Column, bucket: str | None) -> Column:
    """One typed value and five typed nulls, with the property's name."""
    text = F.to_json(F.array(value))
    stored = value if bucket else text.substr(F.lit(2), F.length(text) - 2)
    columns = [(stored if v == (bucket or "string_value") else F.lit(None)).cast(t).alias(v) for v, t in zip(VALUES, VALUE_TYPES, strict=True)]
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("property_name"), *columns))


def unpivot(df: DataFrame, key: str, props: str) -> DataFrame:
    """(key, property_name, six value columns), one row for each property that is not null, in one pass. With from and to where df has them."""
    rows = F.array_compact(F.array(*[expand(n, F.col(f"`{props}`.`{n}`"), b) for n, b in field_buckets(df, props).items()]))
    window = [F.try_to_timestamp(F.col(f"`{c}`").cast("string")).alias(c) for c in ("from", "to") if c in df.columns]
    exploded = df.select(F.col(key).cast("string").alias(key), *window, F.explode(rows).alias("p"))
    return exploded.select(key, "p.*", *[f"`{c}`" for c in ("from", "to") if c in df.columns])


def numbered(df: DataFrame, name: str, after: int = 0) -> DataFrame:
    """df with an id column: unique, not dense, above `after`."""
    return df.withColumn(name, F.monotonically_increasing_id() + after + 1)


def max_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("max_id"))


def label_dictionary(nodes: DataFrame) -> DataFrame:
    return _dictionary(nodes.select(F.explode("labels").alias("label")), "label", "label_id")


def type_dictionary(edges: DataFrame) -> DataFrame:
    return _dictionary(edges.select("edge_type"), "edge_type", "type_id")


def _dictionary(values: DataFrame, value: str, name: str) -> DataFrame:
    """Dense ids from 0 in alphabetical order; a schema has few labels and types, so one window holds them."""
    return values.distinct().select((F.row_number().over(W.orderBy(value)) - 1).alias(name), value)
