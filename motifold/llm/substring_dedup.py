"""Removal of byte strings that occur more than once, by suffix arrays of shards and their common prefixes.

A string of `length` bytes must be found wherever else it starts, in any document. Each window of that length is routed by its
anchor, the least hash of its grams of 32 bytes: equal windows have equal anchors, so they meet in one shard. Consecutive
windows with one anchor form a run. Runs whose anchor occurs once are unique. Equal runs are counted and collapsed into one, so a shard holds
the different texts around each repeated anchor, and each text once. In a shard, suffix arrays are built part by part by Larsson-Sadakane
refinement; windows whose common prefix with a neighbour (Kasai) has the whole length are repeats. Where an anchor's texts span
several parts, the parts are merged by binary search: the different windows of each are looked up among the sorted windows of all, by their hashes.
Anchors with many different texts are spread over more shards by the anchor's place in the window, and by the bytes that all windows with about this place
hold; equal windows share both.

Repeats are judged on the input, overlaps count, and matches never cross documents. A null text counts as an empty one. Rows that
repeat an id and a text are two places of that text. Every row gets one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import small_batches, written
from motifold.llm.suffix import common_prefixes, neighbours, suffix_array
from motifold.llm.text import Hashes, column_bytes, mix, slices

U = np.uint64
GRAM = 32
#: Bytes of text handled at once, of texts in a shard on average, in one suffix array; texts of an anchor beyond which it is spread, and how.
PART, SHARD, ARRAY, MANY, SPREAD = 1 << 18, 4 << 20, 1 << 18, 64, 32


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, start in it, windows, place of the anchor in the first window, hashes of anchor and of the run."""
    n, width = len(data), length - GRAM + 1
    out: list[tuple[np.ndarray, ...]] = []
    if n >= length:
        hashes = Hashes(data)
        place = np.arange(n - GRAM + 1)
        gram = hashes.of(place, place + GRAM)
        change = np.zeros(n + 1, np.int64)
        full = np.diff(offsets) >= length
        change[offsets[:-1][full]] += 1
        np.add.at(change, offsets[1:][full] - length + 1, -1)
        valid = np.cumsum(change[:-1]) > 0
        for low in range(0, n - length + 1, 1 << 19):
            high = min(n - length + 1, low + (1 << 19))
            part = gram[low : high + width - 1]
            least = part >> U(20) << U(20) | np.arange(len(part), dtype=U)
            have = 1
            while 2 * have <= width:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            if have < width:
                least = np.minimum(least[: high - low], least[width - have :][: high - low])
            at = np.flatnonzero(valid[low:high])
            if not len(at):
                continue
            anchor = (least[at] & U((1 << 20) - 1)).astype(np.int64)
            first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(anchor, prepend=-1) != 0))
            windows = np.diff(np.append(first, len(at)))
            start = at[first] + low
            out.append((start, windows, anchor[first] + low - start, gram[anchor[first] + low], hashes.of(start, start + windows + length - 1)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    start, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start - offsets[text], *rest


def _all_runs(rows: DataFrame, length: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, j in slices(offsets, PART):
                text, start, windows, place, anchor, content = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), content.view(np.int64), keys[i:j][text], start, windows, place)], names=["anchor", "content", "key", "start", "windows", "place"])

    return rows.mapInArrow(each, "anchor long, content long, key long, start long, windows long, place long")


def _texts(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """The texts of runs, packed by shard. rows: key, text, runs (anchor, start, windows, place, several, spread) of that text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
            run = batch.column(2).flatten()
            anchor, start, windows, place, several, spread = (run.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6))
            key = batch.column(0).to_numpy()[owner]
            # windows of anchors with many texts are cut where the anchor's place in the window passes a multiple of SPREAD
            top, last = np.where(spread > 0, place // SPREAD, 0), np.where(spread > 0, (place - windows + 1) // SPREAD, 0)
            pieces = top - last + 1
            which = np.repeat(np.arange(len(anchor)), pieces)
            block = np.repeat(top, pieces) - (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            spreads = spread[which] > 0
            begin = np.where(spreads, np.maximum(0, place[which] - (block + 1) * SPREAD + 1), 0)
            end = np.where(spreads, np.minimum(windows[which], place[which] - block * SPREAD + 1), windows[which])
            # such a piece's windows all hold the bytes around the anchor that are in its shortest reach to either side
            core = np.zeros(len(which), U)
            if spreads.any():
                centre = (offsets[owner] + start + place)[which[spreads]]
                first, last_ = centre - block[spreads] * SPREAD, centre - np.minimum((block[spreads] + 1) * SPREAD - 1, length - GRAM) + length
                core[spreads] = mix(Hashes(data).of(first, last_) + block[spreads].astype(U))
            label = anchor[which].view(U) ^ core
            shard = (mix(label) % U(shards)).astype(np.int64)
            head = np.stack([label.view(np.int64), key[which], start[which] + begin, end - begin, several[which]], axis=1)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)][: len(edges)], strict=True):
                own = order[a:b]
                texts = [data[(s := offsets[owner[which[k]]] + head[k, 2]) : s + head[k, 3] + length - 1].tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])]), pa.array([head[own].tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())], names=["shard", "head", "texts"])

    return rows.mapInArrow(each, "shard long, head binary, texts binary")


class Part:
    """The windows of `length` bytes of some texts, in the order of their suffix array."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int):
        n = len(data)
        ends = np.repeat(np.cumsum(sizes), sizes)
        first = np.zeros(n, np.int64)
        for k in range(4):
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = data[k:].astype(np.int64) + 1
            first = first << 9 | np.where(np.arange(n) + k < ends, shifted, 0)
        order = suffix_array(first, ends, 4)
        shared = common_prefixes(data, ends, order, length)
        self.window = ends - np.arange(n) >= length
        self.repeated = self.window & (neighbours(order, shared) >= length)
        #: The different windows in their order, by their hashes, and which of them starts where.
        windows = order[self.window[order]]
        fresh = shared[windows] < length
        different = windows[fresh]
        self.hashes = Hashes(data).of(different, different + length)
        self.name = np.full(n, -1, np.int32)
        self.name[windows] = np.cumsum(fresh) - 1


def repeats(head: np.ndarray, data: np.ndarray, length: int, array: int = ARRAY) -> Iterator[tuple[int, int, int]]:
    """(key, start, windows) of maximal stretches of repeated windows in the texts of a shard. head: anchor, key, start, windows, several."""
    sizes = head[:, 3] + length - 1
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(head[:, 0], kind="stable")
    cuts, held = [0], 0
    for k, at in enumerate(order):
        if held and held + sizes[at] > array:
            cuts.append(k)
            held = 0
        held += sizes[at]
    cuts.append(len(order))

    def close(rows: np.ndarray, part: Part) -> Iterator[tuple[int, int, int]]:
        hit = part.repeated | (part.window & np.repeat(head[rows, 4] > 0, sizes[rows]))
        text = np.repeat(np.arange(len(rows)), sizes[rows])
        at = np.flatnonzero(hit)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            many = np.diff(np.append(first, len(at)))
            own = rows[text[at[first]]]
            within = at[first] - (np.cumsum(sizes[rows]) - sizes[rows])[text[at[first]]]
            yield from zip(head[own, 1].tolist(), (head[own, 2] + within).tolist(), many.tolist(), strict=True)

    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        parts.append((rows, Part(np.concatenate([data[begins[r] : begins[r] + sizes[r]] for r in rows]), sizes[rows], length)))
    # each part looks its different windows up among those of all parts
    table = np.sort(np.concatenate([part.hashes for _, part in parts])) if len(parts) > 1 else np.zeros(0, U)
    for rows, part in parts:
        if len(table):
            elsewhere = np.searchsorted(table, part.hashes, "right") - np.searchsorted(table, part.hashes) > 1
            part.repeated[part.window] |= elsewhere[part.name[part.window]]
        yield from close(rows, part)


def _repeated(packed: DataFrame, length: int) -> DataFrame:
    def each(table: pa.Table) -> pa.Table:
        head = np.frombuffer(b"".join(table.column("head").to_pylist()), np.int64).reshape(-1, 5)
        data = np.frombuffer(b"".join(table.column("texts").to_pylist()), np.uint8)
        found = list(repeats(head, data, length))
        key, start, windows = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "windows": pa.array(windows, pa.int64())})

    return packed.groupBy("shard").applyInArrow(each, "key long, start long, windows long")


def remove(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 400) -> DataFrame:
    """id, n_bytes, spans (start and end of each maximal removed run, in bytes) and kept (the other bytes) of each row of docs."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.xxhash64(F.col(id_column), F.col(text_column)).alias("key"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.col(id_column).alias("id"))
    found = written(_all_runs(rows.select("key", "text"), length), "runs")
    contents = written(found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows", "place")).alias("x")), "contents")
    shared = written(contents.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1"), "anchors")
    several = contents.where("n > 1").select("anchor", "content")
    apart = written(contents.join(shared, "anchor").select("anchor", "x.*", (F.col("n") > 1).alias("several"), (F.col("texts") > MANY).alias("spread")), "texts")
    total = apart.agg(F.coalesce(F.sum(F.col("windows") + length - 1), F.lit(0))).first()[0]
    lists = apart.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "windows", "place", F.col("several").cast("long").alias("several"), F.col("spread").cast("long").alias("spread"))).alias("runs"))
    # rows that repeat an id and a text have one key; any of them gives the text
    texts = rows.select("key", "text").join(lists, "key").select("key", "text", "runs")
    within = _repeated(_texts(texts, max(1, -(-int(total) // SHARD)), length), length)
    whole = found.join(several, ["anchor", "content"]).select("key", "start", "windows")
    marks = whole.unionByName(within).groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            lists_ = batch.column(2)
            edges = lists_.offsets.to_numpy()
            start, windows = (lists_.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            spans, kept, sizes = [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                change = np.zeros(len(text) + 1, np.int64)
                own = slice(edges[k], edges[k + 1]) if lists_.is_valid()[k].as_py() else slice(0, 0)
                np.add.at(change, start[own], 1)
                np.add.at(change, start[own] + windows[own] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                kept.append(text[~gone].tobytes())
                sizes.append(len(text))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = rows.join(marks, "key", "left").select("id", "text", "marks")
    return out.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_column)
