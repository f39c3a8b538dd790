"""Toxicity by multiple-instance learning.

A text is a bag of sentences (ended by . ! ? or a line break); a sentence is the set of its words, runs of letters in lower case, and of
what they begin with, hashed to 2**BITS weights. A sentence is toxic with the logistic of the sum of its weights, a document with the noisy-or over its sentences,
1 - prod(1 - p). Only documents have labels, and the loss on these trains the sentence model, which then also tells where a text offends.

It is fitted on at most `most` documents of labels 0 and 1. The driver holds their words as 32-bit numbers and sums over them in chunks. With only one label among them, all scores are 1 for label 1, else 0.
A null or empty text has no sentence and the score 0. Every row gets one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.labelled import sample
from motifold.llm.shared import small_batches, written
from motifold.llm.text import LOWER, Hashes, column_bytes, mix, slices, word_spans

U = np.uint64
BITS, PART, CHUNK, PREFIXES = 18, 1 << 18, 1 << 20, (4, 5, 6, 7)
#: Whatever is no letter; bytes from 0x80 on belong to letters.
BETWEEN = ~((np.arange(256) >= 0x80) | np.isin(np.arange(256) | 32, np.arange(97, 123)))
STOPS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of some texts: weight's place, sentence; then for each sentence its text, and start and end in data."""
    starts, ends, edges = word_spans(data, offsets, BETWEEN)
    hashes = Hashes(LOWER[data])
    forms = [hashes.of(starts, ends), *(mix(hashes.of(starts, np.minimum(starts + k, ends)) ^ U(k)) for k in PREFIXES)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    stops = np.concatenate([[0], np.cumsum(STOPS[data])])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (stops[1:] != stops[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    whole = ends - starts
    words = [(f & U((1 << BITS) - 1)).astype(np.int64) | sentence << BITS for f in forms]
    key = np.unique(np.concatenate([words[0], *(w[whole >= k] for w, k in zip(words[1:], PREFIXES, strict=True))]))
    return key & ((1 << BITS) - 1), key >> BITS, owner[first], starts[first], ends[last] if len(first) else first


def _sums(index: np.ndarray, weight: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """np.bincount(index, weight[at], count), with temporary arrays of CHUNK elements."""
    out = np.zeros(count)
    for a in range(0, len(index), CHUNK):
        out += np.bincount(index[a : a + CHUNK], weight[at[a : a + CHUNK]], count)
    return out


def downhill(bias: float, weight: np.ndarray, place: np.ndarray, sentence: np.ndarray, text: np.ndarray, total: int, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes of the documents' mean loss by the weights and the bias. place, sentence: words; text: of each of `total` sentences its document."""
    z = np.clip(bias + _sums(sentence, weight, place, total), -30, 30)
    p = 1 / (1 + np.exp(-z))
    clean = np.minimum(np.bincount(text, np.logaddexp(0, z), len(label)), 50)  # -log of the chance that no sentence is toxic
    # d loss / d clean: 1 for clean documents, -(1 - q) / q for toxic ones, where q is the chance of being toxic
    slope = np.where(label == 1, -1 / np.expm1(np.maximum(clean, 1e-3)), 1.0) / len(label)
    by = slope[text] * p
    return _sums(place, by, sentence, len(weight)), by.sum()


class Model:
    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rounds: int = 250, least: int = 3, support: float = 1.0):
        """bags: for each document the places of its words and which of its sentences each is in."""
        self.constant = float(label[0]) if len(label) and (label == label[0]).all() else 0.0 if not len(label) else None
        self.bias, self.weight = -30.0, np.zeros(1 << BITS, np.float32)
        if self.constant is not None:
            return
        toxic, often = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for (p, _), y in zip(bags, label, strict=True):
            words = np.unique(p)
            often[words] += 1
            toxic[words] += y
        many, few = label.sum(), len(label) - label.sum()
        lift = np.log((toxic + 0.3) / (many + 0.6)) - np.log((often - toxic + 0.3) / (few + 0.6))
        used = often >= least
        penalty = support / len(bags)
        weight = np.where(used & (lift > 1) & (toxic >= 3), 1.5 * lift, 0.0)
        bias = -6.0
        counts = [int(s.max()) + 1 if len(s) else 0 for _, s in bags]
        first = np.cumsum([0, *counts])
        kept = [used[p] for p, _ in bags]
        place = np.concatenate([p[k] for (p, _), k in zip(bags, kept, strict=True)])
        sentence = np.concatenate([s[k] + np.int32(f) for (_, s), k, f in zip(bags, kept, first[:-1], strict=True)])
        text, total = np.repeat(np.arange(len(bags)), counts), int(first[-1])
        step, moment, scale = 0.08, np.zeros(len(weight) + 1), np.full(len(weight) + 1, 1e-10)
        for _ in range(rounds):
            slope_of, slope_of_bias = downhill(bias, weight, place, sentence, text, total, label)
            # the penalty holds at 0 what would serve fewer than `support` documents
            held = np.where(weight != 0, slope_of + penalty * np.sign(weight), np.sign(slope_of) * np.maximum(np.abs(slope_of) - penalty, 0))
            grad = np.append(held, slope_of_bias)
            moment = 0.9 * moment + 0.1 * grad
            scale = 0.99 * scale + 0.01 * grad**2
            move = step * moment / (np.sqrt(scale) + 1e-7)
            after = np.where(used, weight - move[:-1], 0.0)
            weight = np.where((after * weight < 0) | ((weight == 0) & (held == 0)), 0.0, after)
            bias -= move[-1]
            step *= 0.99
        self.bias, self.weight = float(bias), weight.astype(np.float32)

    def sentence_scores(self, place: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(count, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(sentence, self.weight[place], count), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: tuple[int, int] = (3000, 3000), id_column: str = "doc_id", text_column: str = "text") -> Model:
    small_batches(docs.sparkSession)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for k in range(batch.num_rows):
                place, sentence, *_ = sentences(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([place.astype(np.int32).tobytes()], pa.binary()), pa.array([sentence.astype(np.int32).tobytes()], pa.binary())], names=["id", "label", "place", "sentence"])

    rows = sample(docs, labels, label, learn, most, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    bagged = written(rows.mapInArrow(each, f"id {kind}, label int, place binary, sentence binary"), "bags")
    got = sorted(bagged.toLocalIterator(), key=lambda r: (r["id"], r["place"]))
    bags = [(np.frombuffer(r["place"], np.int32), np.frombuffer(r["sentence"], np.int32)) for r in got]
    return Model(bags, np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model, cut: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted and the offending sentences (start and end in bytes, score) of each row of docs."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets, PART):
                place, sentence, owner, start, end = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = model.sentence_scores(place, sentence, len(owner))
                found = 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-15)), j - i))
                bad: list[list[dict]] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(p >= cut):
                    base = int(offsets[i + owner[k]] - offsets[i])
                    bad[owner[k]].append({"start": int(start[k]) - base, "end": int(end[k]) - base, "score": float(p[k])})
                kind_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.float64()), pa.array((found >= cut).astype(np.int32)), pa.array(bad, kind_)], names=["id", "score", "predicted", "sentences"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, score double, predicted int, sentences array<struct<start:long,end:long,score:double>>").withColumnRenamed("id", id_column)
