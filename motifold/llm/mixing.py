"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sources in the order of their code points (null last) get the weights in turn. Together they share `share` times all words; a source's
target stops at `most` times its own words, and what is cut off is shared among the others by weight.

A source's documents are taken whole as many times as its target holds its words; for the rest they are taken in the order
of exponential keys -ln(u) / weight, where u comes from a hash of the id and the weight from the text's quality, as long as the sum of words
before a document and half of its own is within the rest. So the words taken differ from the target by half a document at most.

Prefix sums need no sort of a whole source: 256 ranges of the key, then 256 ranges in the one where the rest ends, are summed first,
and only the documents in one 65536th of the keys are sorted. Documents meet nothing but one row for each source.

A null text has size 0. Rows without an id have keys from their texts. Rows with equal keys, ids and sizes follow by a hash of the text; of equal rows as many
are taken as the target holds, whichever. Other columns of any name do no harm. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifold.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Symbols that mark junk; a text's quality weight falls with their share.
SYMBOLS = "#*$%&|<>"
#: The order in which a source's documents are taken.
RANK = ("_key", "_id", "_size", "_tie")


def quality(text: Column) -> Column:
    """1 for a text without junk symbols, falling to 0.05 where a fifth of the characters are such."""
    length = F.length(text)
    return F.greatest(F.lit(0.05), 1 - 5.0 * (length - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(F.lit(1), length))


def _keyed(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("\0"), text)).cast("binary")), 1, 13), 16, 10).cast("double")
    return {
        "_id": F.col(id_column).cast("string"),
        "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_source": F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("t")),
        "_tie": F.xxhash64(text),
        "_key": -F.log((number + 0.5) / float(1 << 52)) / quality(text),
    }


def _range() -> Column:
    return F.least(F.lit(65535), F.floor(65536 * (1 - F.exp(-F.col("_key"))))).cast("int")


def _ends(sums: DataFrame, place: str) -> DataFrame:
    """For each source, the first place where the running sum exceeds its rest, and the sum before it."""
    run = sums.withColumn("_run", F.sum("_words").over(W.partitionBy("_source").orderBy(place)))
    return run.where("_run > _rest").groupBy("_source").agg(F.min(F.struct(place, (F.col("_run") - F.col("_words")).alias("_before"))).alias("_e")).select("_source", f"_e.{place}", "_e._before")


def _sources(keyed: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """A row for each source: its words, target, whole epochs, and up to which key documents are taken once more."""
    total = keyed.groupBy("_source").agg(F.sum("_size").alias("_words"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy("_source")) - 1) % len(weights) + 1)
    sized = total.withColumn("_weight", turn).withColumn("_cap", most * F.col("_words")).withColumn("_level", F.col("_cap") / F.col("_weight"))
    # a source is capped if the water level at which it would be full needs no more than the budget
    order, every = W.orderBy("_level", "_source"), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sized = sized.withColumn("_budget", share * F.sum("_words").over(every)).withColumn("_above", F.sum("_weight").over(every) - F.sum("_weight").over(order))
    sized = sized.withColumn("_full", F.sum("_cap").over(order) + F.col("_level") * F.col("_above") <= F.col("_budget"))
    open_cap = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(every)
    sized = sized.withColumn("_target", F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_budget") - open_cap) / open_weight * F.col("_weight")))
    epochs = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(F.lit(0)).cast("long")
    sized = written(sized.withColumn("_epochs", epochs).select("_source", F.col("_words").alias("_source_size"), "_target", "_epochs", (F.col("_target") - F.col("_epochs") * F.col("_words")).alias("_rest")), "sources")

    rest = sized.select("_source", "_rest")
    placed = keyed.withColumn("_place", _range()).withColumn("_top", F.shiftright("_place", 8))
    first = written(_ends(placed.groupBy("_source", "_top").agg(F.sum("_size").alias("_words")).join(rest, "_source"), "_top"), "ranges")
    rest = first.join(rest, "_source").select("_source", "_top", (F.col("_rest") - F.col("_before")).alias("_rest"))
    second = placed.join(rest, ["_source", "_top"]).groupBy("_source", "_place").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
    second = written(_ends(second, "_place").join(rest, "_source").select("_source", "_place", (F.col("_rest") - F.col("_before")).alias("_rest")), "ranges")
    last = placed.join(second, ["_source", "_place"]).withColumn("_run", F.sum("_size").over(W.partitionBy("_source").orderBy(*RANK).rowsBetween(W.unboundedPreceding, 0)))
    # the last place of which any row is taken, and how many of its equal rows
    equal = last.groupBy("_source", *RANK).agg(F.count("*").alias("_all"), F.count_if(F.expr("_run - _size / 2.0D <= _rest")).alias("_some")).where("_some > 0")
    cut = equal.groupBy("_source").agg(F.max(F.struct(F.struct(*RANK).alias("_at"), "_all", "_some")).alias("_cut"))
    return written(sized.join(second.select("_source", "_place"), "_source", "left").join(cut, "_source", "left").drop("_rest"), "sources")


def _decided(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """docs with _size, _source_size, _target and _copies beside its columns."""
    parts = _keyed(docs, id_column, text_column, source_column)
    sources = _sources(written(docs.select(*[c.alias(k) for k, c in parts.items()]), "keyed"), weights, share, most)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(k) for k, c in parts.items()]).withColumn("_range", _range()).join(sources, "_source")
    last = F.coalesce((F.col("_range") == F.col("_place")) & (F.struct(*RANK) == F.col("_cut._at")), F.lit(False))
    once = (F.col("_range") < F.col("_place")) | ((F.col("_range") == F.col("_place")) & (F.struct(*RANK) <= F.col("_cut._at")))
    copies = lambda df, taken: df.withColumn("_copies", F.col("_epochs") + F.coalesce(taken, F.lit(False)).cast("long"))
    if sources.where("_cut._some < _cut._all").isEmpty():
        return copies(joined, once)
    # some of a source's equal rows are taken: only these are numbered
    split = last & (F.col("_cut._some") < F.col("_cut._all"))
    numbered = joined.where(split).withColumn("_number", F.row_number().over(W.partitionBy("_source").orderBy(F.lit(1))))
    return copies(joined.where(~F.coalesce(split, F.lit(False))), once).unionByName(copies(numbered, F.col("_number") <= F.col("_cut._some")).drop("_number"))


def plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For each row of docs: id, size, source_size, target, and the words that the mix takes of it, repeats counted."""
    done = _decided(docs.select(id_column, text_column, source_column), id_column, text_column, source_column, weights, share, most)
    return done.select(f"_row.{id_column}", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def sample(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows that the mix consists of, each as often as it is taken, with all columns of docs."""
    done = _decided(docs, id_column, text_column, source_column, weights, share, most).where("_copies > 0")
    return done.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_n")).select("_row.*")
