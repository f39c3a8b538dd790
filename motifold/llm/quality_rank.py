"""Quality scores by Bradley-Terry ranking.

A text is described by measures of its bytes, words and lines, cut into bins by the quantiles of the labelled rows, both labels weighing the same. From the pairs of a good and a
bad document the model learns a strength for each bin, by logistic loss on the difference of the two descriptions. The threshold is the
quantile of the training strengths that leaves as many below as are labelled bad; a score is a logistic curve through it, with
`cut` at the threshold.

It is fitted on every labelled row, and on every pair of a good and a bad one: what a document adds to the slope depends on its own strength and on how the strengths of the other
label are spread, so counts of strengths, in CELLS steps, stand for the pairs. Rows stay with the executors, as a byte for each bin; tasks
send sums of fixed size. The sums are of whole numbers, so the order of rows and tasks doesn't matter. Weights follow Newton's steps; their second slopes take strengths in COARSE steps.
With only one label among the rows, all scores are 1 for label 1, else 0.
A null text counts as an empty one, which has a description like any other. Every row gets one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.labelled import first, known
from motifold.llm.shared import discard, small_batches, written
from motifold.llm.text import LOWER, Hashes, column_bytes, slices, word_spans

U = np.uint64
PART, BINS = 1 << 18, 12
#: Steps of strength, for slopes and second slopes; bits of a measure's mantissa by which quantiles are told apart; rows in a block; Newton's steps at most; weight of the squares.
CELLS, COARSE, BITS, BLOCK, ROUNDS, RIDGE = 2048, 64, 10, 50_000, 25, 2e-4
#: Sums are of whole multiples of 1 / SCALE; weights are too.
SCALE = 1 << 26
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~_=+\\/", "|", "!?", ".,;:", "\"'()[]{}-", "\n", " \t\r\v\f")


def _tables() -> list[np.ndarray]:
    out = [np.isin(np.arange(256), np.frombuffer(c.encode(), np.uint8)) for c in CLASSES]
    return [*out, np.arange(256) >= 0xC0]


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of measures for each text."""
    out = []
    for i, j in slices(offsets, PART):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]

        def total(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            return sums[edges[1:]] - sums[edges[:-1]]

        starts, ends, edges = word_spans(part, at)
        size, words = np.diff(at).astype(float), np.diff(edges).astype(float)
        owner = np.repeat(np.arange(j - i), np.diff(edges))
        names = Hashes(LOWER[part]).of(starts, ends)
        again = np.zeros(len(names))
        again[1:] = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
        key = np.sort(owner.astype(U) << U(44) | names >> U(20))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        different = np.bincount((key[fresh] >> U(44)).astype(np.int64), minlength=j - i)
        # repeats of three words running
        three = names[:-2] * U(3) + names[1:-1] * U(5) + names[2:] * U(7) if len(names) > 2 else np.zeros(0, U)
        inside = owner[:-2] == owner[2:] if len(names) > 2 else np.zeros(0, bool)
        key = np.sort(owner[:-2][inside].astype(U) << U(44) | three[inside] >> U(20)) if len(three) else np.zeros(0, U)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        kinds = np.bincount((key[fresh] >> U(44)).astype(np.int64), minlength=j - i)
        places = np.bincount((key >> U(44)).astype(np.int64), minlength=j - i)
        marked = np.zeros(len(starts))
        if len(starts):
            last = part[ends - 1]
            marked = (last < 128) & ~np.isin(last, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:0123456789", np.uint8))
        length = (ends - starts).astype(float)
        many, lines = np.maximum(words, 1), np.maximum(total(part == 10, at) + 1, 1)
        measures = [np.log1p(words), words / lines, total(length, edges) / many, total(length**2, edges) / many, different / many, total(again, edges) / many, (places - kinds) / np.maximum(places, 1), total(marked, edges) / many]
        measures += [total(t[part], at) / np.maximum(size, 1) for t in _tables()]
        out.append(np.stack(measures, axis=1))
    return np.concatenate(out) if out else np.zeros((0, 8 + len(CLASSES) + 1))


def uphill(weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slope of the pairs' log likelihood; a, b: the bins of the good and the bad document of each pair.

    The chance that the good one is ranked first is the logistic of the difference of strengths. Pairs.slopes gives the same of all pairs, without listing them.
    """
    miss = 1 / (1 + np.exp(np.clip(weight[a].sum(axis=1) - weight[b].sum(axis=1), -30, 30)))
    return np.bincount(a.ravel(), np.repeat(miss, a.shape[1]), len(weight)) - np.bincount(b.ravel(), np.repeat(miss, b.shape[1]), len(weight))


class Ranking:
    """edges: a row of measures for each step between bins. constant: the score of all, if there was one label."""

    def __init__(self, cut: float, edges: np.ndarray, weight: np.ndarray, threshold: float = 0.0, spread: float = 1.0, constant: float | None = None):
        self.cut, self.edges, self.weight, self.threshold, self.spread, self.constant = cut, edges, weight, threshold, spread, constant

    def bins(self, measures: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(self.edges[:, k], measures[:, k], "right") + BINS * k for k in range(measures.shape[1])]
        return np.stack(columns, axis=1)

    def score(self, measures: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(measures):
            return np.full(len(measures), self.constant if self.constant is not None else 0.0)
        strength = self.weight[self.bins(measures)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(4 * (strength - self.threshold) / self.spread, -30, 30)) * (1 - self.cut) / self.cut)


def quantiles(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The steps between bins of one measure: of its different values, in order, how often good and bad rows have each. Both labels weigh the same."""
    below = np.cumsum(good / good.sum() + bad / bad.sum()) / 2
    return value[np.minimum(np.searchsorted(below, np.linspace(0, 1, BINS + 1)[1:-1] - 1e-12), len(value) - 1)]


def _summed(blocks: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of each(bins, label), a vector of whole numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for bins, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.frombuffer(label, np.uint8)
                x = np.frombuffer(bins, np.uint8).reshape(len(y), -1)
                total = total + each(x + np.arange(x.shape[1]) * BINS, y)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.frombuffer(v, np.int64) for batch in batches for v in batch.column(0).to_pylist()]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([sum(sums[1:], sums[0]).tobytes()], pa.binary())], names=["sums"])

    sums = blocks.mapInArrow(partial, "sums binary")
    if blocks.rdd.getNumPartitions() > 16:
        sums = sums.repartition(16).mapInArrow(add, "sums binary")
    return sum(np.frombuffer(r["sums"], np.int64) for r in sums.collect())


def limits(weight: np.ndarray) -> tuple[float, float]:
    """Strengths that no description is below or above."""
    by_measure = weight.reshape(-1, BINS)
    low, high = float(by_measure.min(axis=1).sum()), float(by_measure.max(axis=1).sum())
    return low, max(high, low + 1e-6)


def cells(strength: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    return np.clip(((strength - low) * (count / (high - low))).astype(np.int64), 0, count - 1)


def counted(weight: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many bad, then good rows are in each cell of strength."""
    at = cells(weight[x].sum(axis=1), *limits(weight), CELLS)
    return np.bincount(at + CELLS * label.astype(np.int64), minlength=2 * CELLS)


class Pairs:
    """What all pairs of a good and a bad row give, by the counts of their strengths under a weight."""

    def __init__(self, weight: np.ndarray, counts: np.ndarray):
        self.weight, (self.bad, self.good) = weight, counts.reshape(2, CELLS).astype(float)
        self.low, self.high = limits(weight)
        self.apart = np.arange(-CELLS + 1, CELLS) * ((self.high - self.low) / CELLS)  # of strengths
        self.loss = float(self.good @ self._over(self.bad, np.logaddexp(0, -self.apart)) / (self.good.sum() * self.bad.sum()) + RIDGE / 2 * weight @ weight)

    def _over(self, counts: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """For each cell the sum over the other cells of their counts times the curve at (own - other)."""
        return np.convolve(counts, curve, "full")[CELLS - 1 : 2 * CELLS - 1]

    def slopes(self) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """What to sum over blocks; and, of the sum, the slope of the mean log likelihood by the weights and its second slopes, turned positive."""
        weight, low, high, width = self.weight, self.low, self.high, len(self.weight)
        good, bad = self.good.sum(), self.bad.sum()
        # the chance that a good row is ranked behind a bad one, for each cell of the one and of the other
        miss = np.stack([self._over(self.good, 1 / (1 + np.exp(np.clip(-self.apart, -30, 30)))) / good, self._over(self.bad, 1 / (1 + np.exp(np.clip(self.apart, -30, 30)))) / bad])
        miss = np.rint(miss * SCALE)
        held = np.flatnonzero(self.good + self.bad)
        a, b = int(held[0]), int(held[-1]) + 1  # cells that rows are in; coarse steps divide these
        coarse = np.arange(CELLS) - a
        coarse = np.clip(coarse * COARSE // (b - a), 0, COARSE - 1)
        many = np.stack([np.bincount(coarse, n, COARSE) for n in (self.bad, self.good)])
        middle = np.arange(COARSE) * ((b - a) / COARSE) * ((high - low) / CELLS)
        chance = 1 / (1 + np.exp(np.clip(middle[:, None] - middle[None, :], -30, 30)))
        bend = chance * (1 - chance)  # alike for (own - other) and (other - own)
        curve = np.rint(np.stack([bend @ many[1] / good, bend @ many[0] / bad]) * SCALE)

        def each(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            y = label.astype(np.int64)
            at = cells(weight[x].sum(axis=1), low, high, CELLS)
            step = coarse[at]
            own = np.zeros((2, width), np.int64)
            means = np.zeros((2 * COARSE, width), np.int64)
            second = np.zeros((2, width, width), np.int64)
            for k in (0, 1):
                of = np.flatnonzero(y == k)
                own[k] = np.bincount(x[of].ravel(), np.repeat(miss[k][at[of]], x.shape[1]), width)
                for i in range(0, len(of), 4096):
                    rows = of[i : i + 4096]
                    hot = np.zeros((len(rows), width))
                    hot[np.arange(len(rows))[:, None], x[rows]] = 1
                    second[k] += ((hot * curve[k][step[rows], None]).T @ hot).astype(np.int64)
            means += np.bincount(((step + COARSE * y)[:, None] * width + x).ravel(), minlength=2 * COARSE * width).reshape(2 * COARSE, width)
            return np.concatenate([own.ravel(), means.ravel(), second.ravel()])

        def whole(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own, means, second = np.split(sums.astype(float), [2 * width, 2 * width + 2 * COARSE * width])
            own, means, second = own.reshape(2, width), means.reshape(2, COARSE, width), second.reshape(2, width, width)
            slope = own[1] / (good * SCALE) - own[0] / (bad * SCALE) - RIDGE * weight
            cross = means[1].T @ bend @ means[0] / (good * bad)
            return slope, second[1] / (good * SCALE) + second[0] / (bad * SCALE) - cross - cross.T + (RIDGE + 1e-6) * np.eye(width)

        return each, whole


def strengths(blocks: DataFrame, width: int) -> tuple[np.ndarray, Pairs]:
    """The weights that all pairs make likeliest, and the counts under them."""
    tries = (1.0, 0.5, 0.2, 0.05)

    def measured(weights: list[np.ndarray]) -> list[Pairs]:
        counts = _summed(blocks, lambda x, y: np.concatenate([counted(w, x, y) for w in weights])).reshape(len(weights), -1)
        return [Pairs(w, n) for w, n in zip(weights, counts, strict=True)]

    now = measured([np.zeros(width)])[0]
    for _ in range(ROUNDS):
        each, whole = now.slopes()
        slope, second = whole(_summed(blocks, each))
        step = np.linalg.solve(second, slope)
        best = min(measured([np.rint((now.weight + t * step) * SCALE) / SCALE for t in tries]), key=lambda p: p.loss)
        if best.loss > now.loss - 1e-5:
            return (best if best.loss < now.loss else now).weight, best if best.loss < now.loss else now
        now = best
    return now.weight, now


def ranked(blocks: DataFrame, weight: np.ndarray, ranks: tuple[int, int]) -> list[float]:
    """The strengths at two ranks from 0. They are whole multiples of 1 / SCALE, found digit by digit."""
    low, high = (int(v * SCALE) for v in limits(weight))
    digit = CELLS.bit_length() - 1
    base, left = [low, low], list(ranks)
    for shift in range(((high - low).bit_length() - 1) // digit * digit, -1, -digit):

        def each(x: np.ndarray, _: np.ndarray, base: list[int] = base, shift: int = shift) -> np.ndarray:
            over = [((weight[x].sum(axis=1) * SCALE).astype(np.int64) - b) >> shift for b in base]
            return np.concatenate([np.bincount(v[(v >= 0) & (v < CELLS)], minlength=CELLS) for v in over])

        counts = _summed(blocks, each).reshape(2, CELLS)
        after = np.cumsum(counts, axis=1)
        at = [int(np.searchsorted(after[k], left[k], "right")) for k in (0, 1)]
        left = [left[k] - int(after[k][at[k]] - counts[k][at[k]]) for k in (0, 1)]
        base = [base[k] + (at[k] << shift) for k in (0, 1)]
    return [b / SCALE for b in base]


def learned(blocks: DataFrame, edges: np.ndarray, good: int, bad: int, cut: float) -> Ranking:
    """The ranking of all rows of the blocks."""
    weight, pairs = strengths(blocks, edges.shape[1] * BINS)
    place = (good + bad - 1) * bad / (good + bad)
    below, above = ranked(blocks, weight, (int(place), min(int(place) + 1, good + bad - 1)))
    middle, many = (np.arange(CELLS) + 0.5) * ((pairs.high - pairs.low) / CELLS), pairs.good + pairs.bad
    mean = many @ middle / many.sum()
    spread = float(np.sqrt(many @ (middle - mean) ** 2 / many.sum()))
    return Ranking(cut, edges, weight, below + (above - below) * (place - int(place)), spread or 1.0)


def _measures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each measure has each value, up to BITS bits of its mantissa, by label."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        cell = _measures(batch.column(1)).view(np.int64) >> (52 - BITS)
        new = (np.arange(cell.shape[1]) << (13 + BITS) | cell << 1 | batch.column(0).to_numpy()[:, None]).ravel()
        keys, to = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(to, np.concatenate([counts, np.ones(len(new))]), len(keys)).astype(np.int64)
    for i in range(0, len(keys), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + BLOCK]), pa.array(counts[i : i + BLOCK])], names=["key", "n"])


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, cut: float = 0.3, most: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> Ranking:
    """The ranking of all labelled rows where `learn` holds; with `most`, of at most so many of each label. An id with both labels counts for both."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures = np.abs(describe(*column_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in measures], pa.binary())], names=["id", "measures"])

    marked = known(labels, label, learn, id_column).distinct()
    if most is not None:
        marked = first(marked, (most, most))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    # texts are described where they are read, so only descriptions are joined with the labels
    described = written(rows.mapInArrow(each, f"id {kind}, measures binary").join(marked, "id").select("label", "measures"), "measures")
    found = described.mapInArrow(_cells, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (found.column(c).to_numpy() for c in ("key", "n"))
    measure, cell, y = key >> (13 + BITS), key >> 1 & (1 << (12 + BITS)) - 1, key & 1
    good, bad = (int(n[(measure == 0) & (y == v)].sum()) for v in (1, 0))
    width = 8 + len(CLASSES) + 1
    if not good or not bad:
        return Ranking(cut, np.zeros((BINS - 1, width)), np.zeros(width * BINS), constant=float(good > 0))
    edges = np.zeros((BINS - 1, width))
    for k in range(width):
        values, to = np.unique(cell[measure == k], return_inverse=True)
        by = [np.bincount(to, n[measure == k] * (y[measure == k] == v), len(values)) for v in (1, 0)]
        edges[:, k] = quantiles((values << (52 - BITS)).view(np.float64), *by)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, marks, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(v)], pa.binary()) for v in (bins, marks)], names=["bins", "label"])

        for batch in batches:
            measures = _measures(batch.column(1))
            bins.append(np.stack([np.searchsorted(edges[:, k], measures[:, k], "right") for k in range(width)], axis=1).astype(np.uint8).tobytes())
            marks.append(batch.column(0).to_numpy().astype(np.uint8).tobytes())
            held += batch.num_rows
            if held >= BLOCK:
                yield out()
                bins, marks, held = [], [], 0
        if held:
            yield out()

    blocks = written(described.mapInArrow(block, "bins binary, label binary"), "bins")
    ranking = learned(blocks, edges, good, bad, cut)
    discard(described)
    discard(blocks)
    return ranking


def score(docs: DataFrame, ranking: Ranking, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score and predicted for each row of docs."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ranking.score(describe(*column_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= ranking.cut).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)
