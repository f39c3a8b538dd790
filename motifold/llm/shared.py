"""Tables written to the folder that driver and executors share, and connected components over such tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Arrow batches between Spark and Python: bytes and rows. The session's own limits hold where they are lower.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Keep Python workers small whatever the texts' lengths: limit the session's Arrow batches."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = (spark.conf.get(key, None) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own is set on one machine, as in tests; a cluster needs the setting."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("motifold.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="motifold-")
        spark.conf.set("motifold.checkpoint.dir", place)
    return place.rstrip("/")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/motifold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._motifold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that written() has made and nothing reads any more."""
    spark, path = df.sparkSession, df._motifold_path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of the edges: label is the smallest node that it is connected with.

    Each round takes the smallest label among a node's neighbours and then the label's own label, until none changes.
    Edges are dealt by both ends, so that a node with many is no task's own. Minima are aggregated before the shuffle, and the joins read plain written tables, whose skewed keys Spark splits.
    """
    both = written(
        edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src != dst").repartition("src", "dst").distinct()
        .select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*"),
        "edges",
    )
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("near"))
        step = written(labels.join(near, F.col("node") == F.col("dst"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        up = step.select(F.col("node").alias("root"), F.col("label").alias("above"))
        seen = Observation()
        after = step.join(up, F.col("label") == F.col("root"), "left").select("node", "was", F.least("label", "above").alias("label"))
        after = written(after.observe(seen, F.count_if(F.col("was") != F.col("label")).alias("changed")), "labels")
        changed = seen.get["changed"] > 0
        discard(labels)
        discard(step)
        labels = after.select("node", "label")
        labels._motifold_path = after._motifold_path
        if not changed:
            discard(both)
            return labels
