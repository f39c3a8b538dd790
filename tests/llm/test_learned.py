"""Operators that learn: held-out accuracy, and defined results for odd input."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifold.llm import quality_rank, toxicity
from motifold.llm.lm_score import held_out
from motifold.llm.text import column_bytes

SF = "/root/testdata/sf0.1"


def later():
    return held_out("doc_id", 5, 0)


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels


def apart(found, labels, label):
    rows = found.join(labels, "doc_id").where(later()).select("score", "predicted", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good = label.sum()
    return (rank[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    found = quality_rank.score(docs, quality_rank.fit(docs, labels, "quality", ~later(), most=1500))
    score, predicted, label = apart(found, labels, "quality")
    assert ((0 <= score) & (score <= 1)).all() and (predicted == (score >= 0.3)).all()
    assert auc(score, label) > 0.98 and (predicted == label).mean() > 0.97


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    found = toxicity.score(docs, toxicity.fit(docs, labels, "toxic", ~later()))
    score, predicted, label = apart(found, labels, "toxic")
    assert ((0 <= score) & (score <= 1)).all() and (predicted == (score >= 0.5)).all()
    caught, wrong = (predicted[label == 1] == 1).mean(), (predicted[label == 0] == 1).mean()
    assert caught > 0.75 and wrong < 0.01
    told = found.where("predicted = 1 and size(sentences) > 0").count()
    assert told > 0.9 * found.where("predicted = 1").count()


@pytest.mark.parametrize("module", [quality_rank, toxicity])
def test_odd_rows_and_labels(spark, module):
    docs = spark.createDataFrame([(1, "a good text here. " * 5, 9), (2, "IDIOT!! scum ### $$$", 9), (3, None, 9), (4, "", 9), (5, " \n", 9), (None, "x", 9), (1, "again", 9)], "doc_id long, text string, label long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (77, 0)], "doc_id long, y int")
    for known in (labels, labels.where("y = 1"), labels.limit(0)):
        found = module.score(docs, module.fit(docs, known, "y", F.lit(True))).collect()
        assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
        again = module.score(docs, module.fit(docs, known, "y", F.lit(True))).collect()
        assert [r.score for r in found] == [r.score for r in again]
    assert module.score(docs.limit(0), module.fit(docs, labels, "y", F.lit(True))).count() == 0


def test_rare_toxic_words_are_learned(spark):
    """Each toxic word stands in four of 2,400 toxic documents: a sample of much fewer has most of them fewer than three times."""
    name = lambda k: "".join(chr(97 + b % 26) for b in hashlib.md5(str(k).encode()).digest()[:8])
    rows = [(k + 10_000 * y, f"a plain line here. then {name(k // 4 + 1000 * y)} stands.") for y in (0, 1) for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 10_000).cast("int").alias("toxic"))
    found = toxicity.score(docs, toxicity.fit(docs, labels, "toxic", F.lit(True)))
    r = found.select(F.avg(F.when(F.col("doc_id") >= 10_000, F.col("predicted"))), F.avg(F.when(F.col("doc_id") < 10_000, F.col("predicted")))).first()
    assert r[0] > 0.95 and r[1] < 0.05


TEXTS = ["", None, " \n", "One two two. One two two! ÉÉ é?\n\nIDIOT $$$ a|b", "x", "a b c a b c a b c", "Das ist das, das ist... 42 #tag <b> (c)\n  \nend", "w " * 700]


def test_measures_against_plain_ones():
    got = quality_rank.describe(*column_bytes(pa.array(TEXTS, pa.string())))
    for text, row in zip(TEXTS, got, strict=True):
        t = text or ""
        raw, words = t.encode(), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        low = [w.lower() for w in words]
        many, lines, three = max(len(words), 1), t.count("\n") + 1, [tuple(low[k : k + 3]) for k in range(len(low) - 2)]
        odd = [w for w in words if w[-1] < 128 and not re.match(rb"[A-Za-z0-9.,;:]", w[-1:])]
        want = [math.log1p(len(words)), len(words) / lines, sum(map(len, words)) / many, sum(len(w) ** 2 for w in words) / many, len(set(low)) / many]
        want += [sum(a == b for a, b in zip(low, low[1:], strict=False)) / many, (len(three) - len(set(three))) / max(len(three), 1), len(odd) / many]
        want += [sum(chr(b) in c for b in raw) / max(len(raw), 1) for c in quality_rank.CLASSES] + [sum(b >= 0xC0 for b in raw) / max(len(raw), 1)]
        assert row == pytest.approx(want)


def test_sentences_against_plain_ones():
    texts = [t or "" for t in TEXTS] + ["Go. go! GO? stop\nwalking walks; wal", "..a..b.."]
    place, sentence, owner, start, end = toxicity.sentences(*column_bytes(pa.array(texts)))
    raw, want, at = "".join(texts).encode(), [], 0
    for k, t in enumerate(texts):
        for m in re.finditer(rb"[^.!?\n]+", t.encode()):
            found = [(w.start(), w[0].lower()) for w in re.finditer(rb"[A-Za-z\x80-\xff]+", m[0])]
            if found:
                begin = at + m.start()
                forms = {(w, 0) for _, w in found} | {(w[:n], n) for _, w in found for n in toxicity.PREFIXES if len(w) >= n}
                want.append((k, begin + found[0][0], begin + found[-1][0] + len(found[-1][1]), forms))
        at += len(t.encode())
    assert [(int(o), int(s), int(e)) for o, s, e in zip(owner, start, end, strict=True)] == [x[:3] for x in want]
    names: dict = {}
    for k, (*_, forms) in enumerate(want):
        own = set(place[sentence == k].tolist())
        assert len(own) == len(forms)
        for f in forms:
            # a form has one place wherever it stands
            names[f] = names.get(f, own) & own
    assert all(names.values()) and len(raw) == at


def test_slopes_against_differences():
    r = np.random.default_rng(0)
    a, b, weight = r.integers(0, 9, (30, 4)), r.integers(0, 9, (30, 4)), r.normal(size=9)
    likely = lambda w: -np.log1p(np.exp(-(w[a].sum(axis=1) - w[b].sum(axis=1)))).sum()
    text = np.repeat(np.arange(12), 3)
    place, sentence, label = r.integers(0, 9, 200), r.integers(0, 36, 200), r.integers(0, 2, 12)

    def loss(bias, w):
        p = 1 / (1 + np.exp(-(bias + np.bincount(sentence, w[place], 36))))
        toxic = 1 - np.array([np.prod(1 - p[text == k]) for k in range(12)])
        return -np.where(label == 1, np.log(toxic), np.log(1 - toxic)).mean()

    slope, by_bias = toxicity.downhill(-1.0, weight, place, sentence, text, 36, label)
    up = quality_rank.uphill(weight, a, b)
    for k in range(9):
        e = np.zeros(9)
        e[k] = 1e-5
        assert up[k] == pytest.approx((likely(weight + e) - likely(weight - e)) / 2e-5, abs=1e-6)
        assert slope[k] == pytest.approx((loss(-1.0, weight + e) - loss(-1.0, weight - e)) / 2e-5, abs=1e-6)
    assert by_bias == pytest.approx((loss(-1 + 1e-5, weight) - loss(-1 - 1e-5, weight)) / 2e-5, abs=1e-6)
