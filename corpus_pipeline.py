"""A corpus in five stages: each takes (spark, docs, sf_dir), works on all rows of docs, and its result is written and read again as the
next one's docs. All but the last return the columns of documents, further ones of any name included. An empty table stays empty through all
stages, and texts of any length are read whole. What each stage does with nulls, empty texts, ties and repeated rows stands with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.llm import bpe, mixing, ngram_join, quality_rules, secrets
from motifold.llm.queries import vocabulary
from motifold.llm.shared import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts too, as they have fewer than 50 words. Each row is judged by its own text
    alone, so repeated rows stay or go together; a share that equals a limit passes."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) one document stays, the one with the smallest id. A repeated row
    stays once; different texts of one id are different documents; rows without an id stay, and texts without words link with nothing."""
    return ngram_join.keep_one(docs)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. All rows stay: a null text stays null, one without a secret as it is; of overlapping
    secrets the first is marked and the rest of the others goes with it; equal rows give equal rows."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: not at all, once or twice. Texts without words count nothing, and stand as often as their
    source's whole epochs and their key say; a null source is a source; equal keys follow by id, size and text, and equal rows are taken as
    many as the target holds."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and the text that they decode to. Every row gives a row, repeats included; a null text counts as an empty one, with no ids."""
    return bpe.code(docs, vocabulary())


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", scan), ("mixing sources", mix), ("BPE encoding and decoding", encode)]
#: SQL has no byte-pair encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
