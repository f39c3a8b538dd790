"""Node and edge records in multiline JSON files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifold.plans.graph import LongGraph, from_records

_NAME = re.compile(r"path_\d+_(?P<group>.+)_(?P<batch>\d+)\.json$")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> list[str]:
    """Paths of a folder's files in any file system that Spark reads, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(x.getPath().toString() for x in found or [])


def groups(paths: Sequence[str]) -> dict[str, list[str]]:
    """Files that hold records of one kind, by the middle of their names."""
    out: dict[str, list[str]] = {}
    for p in paths:
        if m := _NAME.search(p.rsplit("/", 1)[-1]):
            out.setdefault(m["group"], []).append(p)
    return out


def read_json(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Records of several files in one read, each record once. Without a schema it is inferred over all of them together."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(list(paths)).distinct()


def is_edges(df: DataFrame) -> bool:
    """Records are told by what they hold, not by file names."""
    return "source_id" in df.columns


def is_dynamic(df: DataFrame) -> bool:
    return "dynamic_props" in df.columns


def read_records(spark: SparkSession, folder: str) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame], DataFrame | None]:
    """Static nodes and edges, dynamic nodes and edges from all record files of a folder. Dynamic files may be missing; empty files are skipped."""
    frames = [df for paths in groups(list_files(spark, folder)).values() if (df := read_json(spark, paths)).columns and ("node_id" in df.columns or is_edges(df))]
    nodes = {dynamic: [f for f in frames if not is_edges(f) and is_dynamic(f) == dynamic] for dynamic in (False, True)}
    edges = {dynamic: [f for f in frames if is_edges(f) and is_dynamic(f) == dynamic] for dynamic in (False, True)}
    one = lambda fs: None if not fs else fs[0] if len(fs) == 1 else _union(fs)
    return nodes[False], one(edges[False]), nodes[True], one(edges[True])


def read_graph(spark: SparkSession, folder: str) -> LongGraph:
    """A graph from all record files of a folder."""
    return from_records(*read_records(spark, folder))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def node_records(df: DataFrame, key: str, label: str, static: Sequence[str]) -> DataFrame:
    """(node_id, labels, static_props, is_active)."""
    return df.select(F.col(key).alias("node_id"), F.array(F.lit(label)).alias("labels"), F.struct(*static).alias("static_props"), F.lit(True).alias("is_active"))


def edge_records(df: DataFrame, static: Sequence[str]) -> DataFrame:
    """(edge_id, source_id, target_id, edge_type, static_props)."""
    return df.select("edge_id", "source_id", "target_id", "edge_type", F.struct(*static).alias("static_props"))


def dynamic_node_records(df: DataFrame, key: str, label: str, props: Sequence[str], start: str, end: str) -> DataFrame:
    """(node_id, labels, is_active, from, to, dynamic_props)."""
    return df.select(F.col(key).alias("node_id"), F.array(F.lit(label)).alias("labels"), F.lit(True).alias("is_active"), F.col(start).alias("from"), F.col(end).alias("to"), F.struct(*props).alias("dynamic_props"))


def dynamic_edge_records(df: DataFrame, props: Sequence[str], start: str, end: str) -> DataFrame:
    """(edge_id, source_id, target_id, edge_type, from, to, dynamic_props)."""
    return df.select("edge_id", "source_id", "target_id", "edge_type", F.col(start).alias("from"), F.col(end).alias("to"), F.struct(*props).alias("dynamic_props"))


def write_json(df: DataFrame, folder: str, group: str, batch: int = 1) -> list[str]:
    """Writes each partition as one array of records, in files that read_graph() knows by their names; other groups and batches stay."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for b in batches:
            lines = []
            for line in b.column(0).to_pylist():
                lines.append(mark + line)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], names=["value"])

    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    home, part = path(folder), path(f"{folder.rstrip('/')}/_{group}_{batch}")
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).mapInArrow(arrays, "value string").write.mode("overwrite").text(part.toString())
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in groups(list_files(spark, folder)).get(group, []):
        if _NAME.search(old.rsplit("/", 1)[-1])["batch"] == str(batch):
            system.delete(path(old), False)
    out = []
    for k, status in enumerate(system.globStatus(path(f"{part.toString()}/part-*"))):
        name = f"{folder.rstrip('/')}/path_{k + 1}_{group}_{batch}.json"
        system.rename(status.getPath(), path(name))
        out.append(name)
    system.delete(part, True)
    return out


def upload(spark: SparkSession, local: str, target: str) -> None:
    """Copies a file or folder of the driver's disk to any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(target)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, path(f"file://{os.path.abspath(local)}"), place)
