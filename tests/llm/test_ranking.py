"""The quality ranking learns from every labelled row, and from every pair of a good and a bad one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifold.llm import quality_rank as Q


def test_every_labelled_row_counts(spark):
    """Good texts have 10 words, bad ones 5; but the last thousand bad ones by the hash that a bounded sample goes by have 20."""
    words = lambda n: " ".join("word" + chr(97 + k) for k in range(n))
    ids = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") >= 5000).cast("int").alias("y"))
    place = F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    docs = ids.withColumn("text", F.when(F.col("y") == 1, words(10)).when(place > 4000, words(20)).otherwise(words(5))).cache()
    found = Q.score(docs, Q.fit(docs, ids, "y", F.lit(True))).join(docs, "doc_id")
    got = {tuple(r) for r in found.select("y", "text", "predicted").distinct().collect()}
    assert got == {(1, words(10), 1), (0, words(5), 0), (0, words(20), 0)}


def _blocks(spark, x, label):
    rows = [(bytearray((x[i : i + 7] % Q.BINS).astype(np.uint8).tobytes()), bytearray(label[i : i + 7].astype(np.uint8).tobytes())) for i in range(0, len(label), 7)]
    return spark.createDataFrame(rows, "bins binary, label binary")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    label = r.integers(0, 2, 60)
    return r.integers(0, Q.BINS, (60, 4)) // (1 + label[:, None] * (r.random((60, 4)) < 0.7)) + Q.BINS * np.arange(4), label


def test_slopes_of_all_pairs(spark, rows):
    x, label = rows
    weight = np.rint(np.random.default_rng(6).normal(size=4 * Q.BINS) * Q.SCALE) / Q.SCALE
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    a, b = np.repeat(good, len(bad)), np.tile(bad, len(good))
    blocks = _blocks(spark, x, label)
    pairs = Q.Pairs(weight, Q._summed(blocks, lambda x, y: Q.counted(weight, x, y)))
    each, whole = pairs.slopes()
    slope, second = whole(Q._summed(blocks, each))
    assert slope == pytest.approx(Q.uphill(weight, x[a], x[b]) / len(a) - Q.RIDGE * weight, abs=1e-3)
    apart = weight[x[a]].sum(axis=1) - weight[x[b]].sum(axis=1)
    assert pairs.loss == pytest.approx(np.log1p(np.exp(-apart)).mean() + Q.RIDGE / 2 * weight @ weight, abs=1e-3)
    hot = np.zeros((len(a), len(weight)))
    for k in range(4):
        np.add.at(hot, (np.arange(len(a)), x[a, k]), 1)
        np.add.at(hot, (np.arange(len(a)), x[b, k]), -1)
    bend = 1 / (1 + np.exp(-apart)) / (1 + np.exp(apart))
    assert second == pytest.approx((hot * bend[:, None]).T @ hot / len(a) + (Q.RIDGE + 1e-6) * np.eye(len(weight)), abs=5e-3)


def test_the_optimum_and_the_threshold(spark, rows):
    x, label = rows
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    a, b = np.repeat(good, len(bad)), np.tile(bad, len(good))
    blocks = _blocks(spark, x, label)
    got = Q.learned(blocks, np.zeros((Q.BINS - 1, 4)), len(good), len(bad), 0.3)
    assert np.abs(Q.uphill(got.weight, x[a], x[b]) / len(a) - Q.RIDGE * got.weight).max() < 2e-3
    strength = got.weight[x].sum(axis=1)
    assert got.threshold == pytest.approx(np.quantile(strength, len(bad) / 60)) and got.spread == pytest.approx(np.std(strength), rel=1e-2)
    mixed = np.random.default_rng(7).permutation(60)
    assert (Q.learned(_blocks(spark, x[mixed], label[mixed]), got.edges, len(good), len(bad), 0.3).weight == got.weight).all()


def test_steps_between_bins():
    r = np.random.default_rng(8)
    good, bad = r.integers(0, 40, 1200), r.integers(20, 90, 600)
    steps = Q.quantiles(np.arange(90.0), np.bincount(good, minlength=90), np.bincount(bad, minlength=90))
    both = np.sort(np.concatenate([good, np.repeat(bad, 2)]))
    assert steps.tolist() == [both[k * 200 - 1] for k in range(1, 12)]
