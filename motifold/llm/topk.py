"""Exact top-k search by inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. In that order they are cut into cells, so a cell is an annulus around a pivot
(or part of one), and neighbouring cells form groups. With |q - x| >= | |q - p| - |x - p| | and
2 q.x = |q|^2 + |x|^2 - |q - x|^2, a cell whose distances to pivot p lie in [lo, hi] and whose norms are at most m holds no score above
(|q|^2 + m^2 - max(0, |q - p| - hi, lo - |q - p|)^2) / 2, nor above |q| m. A query visits a group's cells in the order of these bounds
and stops where they fall below the k-th score that it knows. It starts from its k-th score among the vectors of largest norm.

Pivots are chosen from a bounded sample; every vector is indexed, and the result is exact whatever the pivots. Queries meet groups in blocks, and a
block goes to no group that is too far for all of its queries. Each group returns k rows at most for a query.

Vectors that are null, or hold null or non-finite components, take no part; shorter ones count as padded with zeros. Equal scores go to the smaller
id. Rows that repeat an id are separate candidates, and none is a candidate of its own id's queries. Other columns are not read; an empty table gives no rows.
Components are 64-bit integers; where a sum of products might leave their range, it is computed without one, and a score that leaves it, a vector with itself included, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifold.llm.shared import small_batches, written

#: Pivots, vectors in the samples for pivots and for first thresholds, in a cell, cells in a group, queries in a block, and beside a group in one task.
PIVOTS, SAMPLE, LARGEST, CELL, GROUP, BLOCK, TOGETHER = 16, 1024, 512, 512, 16, 256, 1 << 15
#: Groups up to which their bounds are sent to all tasks; beyond that blocks are crossed with the table of all groups, and tested there.
GROUPS_SENT = 10_000


def valid(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist() if column.null_count else None
    flat, edges = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if rows is None and len(column) and (np.diff(edges) == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    for k in range(len(column)):
        own = flat[edges[k] - edges[0] : edges[k + 1] - edges[0]]
        out[k, : len(own)] = own
    return out


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it."""
    picked = [0]
    sample = sample.astype(np.float64)
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((vectors - p).astype(np.float64) ** 2).sum(axis=1) for p in pivots], axis=1))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where no sum can leave its exact range."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 1 << 24:
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.T.astype(object)
    if exact.size and max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def _best(row: np.ndarray, name: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (row, name, score), the k best of each row, ordered by row, score and name."""
    order = np.lexsort((name, -score, row))
    row, name, score = row[order], name[order], score[order]
    first = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = rank < k
    return row[keep], name[keep], score[keep]


def _bound(norm: np.ndarray, distance: np.ndarray, low: float, high: float, most: float) -> np.ndarray:
    gap = np.maximum(0.0, np.maximum(distance - high, low - distance))
    return np.minimum((norm**2 + most**2 - gap**2) / 2, norm * most) + 1e-6 * (1 + norm * most)


def search_group(cells: list[dict], ids: np.ndarray, queries: np.ndarray, least: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a group's vectors for each query, of those whose score reaches the query's least: row, id, score."""
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    distance = _distances(queries, pivots)
    bounds = np.stack([_bound(norm, distance[:, c["pivot"]], c["low"], c["high"], c["most"]) for c in cells], axis=1)
    least = least.astype(np.float64).copy()
    row, name, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in np.argsort(-bounds.max(axis=0)):
        cell = cells[at]
        live = np.flatnonzero(bounds[:, at] >= least)
        if not len(live):
            continue
        found = _scores(queries[live], cell["vectors"])
        found_at = np.nonzero((found >= least[live][:, None]) & (ids[live][:, None] != cell["ids"][None, :]))
        row, name, score = _best(np.concatenate([row, live[found_at[0]]]), np.concatenate([name, cell["ids"][found_at[1]]]), np.concatenate([score, found[found_at]]), k)
        last = np.flatnonzero(np.append(np.diff(row) != 0, True)) if len(row) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([[-1], last]))
        full = last[many == k]
        least[row[full]] = np.maximum(least[row[full]], score[full])
    return row, name, score


def search(table: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, the neighbour's id and score: for each row that is a query its k best others by the integer inner product of floor(scale * x)."""
    small_batches(table.sparkSession)
    spark = table.sparkSession
    names = f"query_id long, rank int, {id_column} long, score long"
    vector = F.transform(F.col(vector_column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = table.where(valid(F.col(vector_column)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = written(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), "vectors")
    count, asks, width, most = rows.agg(F.count("*"), F.count_if("query"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if not count:
        return spark.createDataFrame([], names)
    if (most or 0) >= float(1 << 63):  # what floor() returns for larger values
        raise OverflowError("a scaled component does not fit 64 bits")
    taken = lambda part: _matrix(pa.array([r["v"] for r in part], pa.list_(pa.int64())), width)
    pivots = _pivots(taken(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()), PIVOTS)
    large = rows.orderBy(F.desc("norm"), "id").limit(LARGEST).select("id", "v").collect()
    large_ids, large_vectors = np.array([r["id"] for r in large], np.int64), taken(large)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = _distances(_matrix(batch.column(1), width), pivots)
            nearest = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(distance[np.arange(len(nearest)), nearest])], names=["id", "v", "query", "norm", "pivot", "distance"])

    keyed = rows.mapInArrow(key, "id long, v array<long>, query boolean, norm double, pivot long, distance double")
    parts = max(1, -(-count // (CELL * GROUP)))
    sorted_ = keyed.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells: neighbouring vectors of one pivot, with their bounds."""
        for batch in batches:
            pivot = batch.column(4).to_numpy()
            edges = np.flatnonzero(np.diff(pivot, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(pivot)][: len(edges)], strict=True):
                for i in range(a, b, CELL):
                    part = batch.slice(i, min(CELL, b - i))
                    matrix, distance = _matrix(part.column(1), width), part.column(5).to_numpy()
                    row = {"pivot": int(pivot[a]), "low": float(distance.min()), "high": float(distance.max()), "most": float(np.sqrt(part.column(3).to_numpy().max())), "ids": part.column(0).to_numpy().tobytes(), "vectors": matrix.astype(np.int64).tobytes(), "queries": np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False)).astype(np.int64).tobytes()}
                    yield pa.RecordBatch.from_pylist([row], _CELL)

    cells = written(sorted_.mapInArrow(pack, "pivot long, low double, high double, most double, ids binary, vectors binary, queries binary").withColumn("group", F.spark_partition_id().cast("long")), "cells")
    bounds = cells.groupBy("group", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"))
    few = cells.select("group").distinct().limit(GROUPS_SENT + 1).count() <= GROUPS_SENT
    known = [tuple(r) for r in bounds.collect()] if few else None

    def asking(group: int, name: np.ndarray, block: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"group": group, "ids": name.tobytes(), "vectors": block.astype(np.int64).tobytes(), "least": least.tobytes()}], _ASKED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries, once for each group that may hold one of their best; where the groups are not known, once for all."""
        for batch in batches:
            ids, vectors = [], []
            for name, data, at in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True):
                own = np.frombuffer(at, np.int64)
                ids.append(np.frombuffer(name, np.int64)[own])
                vectors.append(np.frombuffer(data, np.int64).reshape(-1, width)[own])
            names_, matrix = np.concatenate(ids), np.concatenate(vectors).astype(np.int64)
            for i in range(0, len(names_), BLOCK):
                name, block = names_[i : i + BLOCK], matrix[i : i + BLOCK]
                score = np.where(name[:, None] != large_ids[None, :], _scores(block, large_vectors), np.iinfo(np.int64).min)
                least = np.sort(score, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(name), np.iinfo(np.int64).min)
                if known is None:
                    yield asking(-1, name, block, least)
                    continue
                norm, distance = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1)), _distances(block, pivots)
                able: dict[int, np.ndarray] = {}
                for group, pivot, low, high, most in known:
                    near = _bound(norm, distance[:, pivot], low, high, most) >= least
                    able[group] = able.get(group, False) | near
                for group, near in sorted(able.items()):
                    if near.any():
                        yield asking(group, name[near], block[near], least[near])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of blocks beside a group and its bounds, the queries that the group may hold one of the best of."""
        for batch in batches:
            for r in batch.to_pylist():
                name, least = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["least"], np.int64)
                block = np.frombuffer(r["vectors"], np.int64).reshape(-1, width)
                norm, distance = np.sqrt((block.astype(np.float64) ** 2).sum(axis=1)), _distances(block, pivots)
                near = np.any([_bound(norm, distance[:, b["pivot"]], b["low"], b["high"], b["most"]) >= least for b in r["bounds"]], axis=0)
                if near.any():
                    yield asking(r["group"], name[near], block[near], least[near])

    asked = cells.mapInArrow(ask, "group long, ids binary, vectors binary, least binary")
    if known is None:
        every = bounds.groupBy("group").agg(F.collect_list(F.struct("pivot", "low", "high", "most")).alias("bounds"))
        crossed = written(asked.drop("group"), "asked").crossJoin(written(every, "groups"))
        asked = crossed.select("group", "ids", "vectors", "least", "bounds").mapInArrow(meet, "group long, ids binary, vectors binary, least binary")

    def answer(own: pa.Table, queries: pa.Table) -> pa.Table:
        held = [r | {"ids": np.frombuffer(r["ids"], np.int64), "vectors": np.frombuffer(r["vectors"], np.int64).reshape(-1, width)} for r in own.drop_columns(["salt"]).to_pylist()]
        out: list[list[np.ndarray]] = [[], [], []]
        for q in queries.to_pylist() if held else ():
            ids = np.frombuffer(q["ids"], np.int64)
            found = search_group(held, ids, np.frombuffer(q["vectors"], np.int64).reshape(-1, width), np.frombuffer(q["least"], np.int64), pivots, k)
            for x, y in zip(out, (ids[found[0]], *found[1:]), strict=True):
                x.append(y)
        query, name, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"query_id": query, "id": name, "score": score})

    # a group with more queries than one task should hold is given to several
    salts = max(1, -(-asks // TOGETHER))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    held_ = cells.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = held_.groupBy("group", "salt").cogroup(asked.groupBy("group", "salt")).applyInArrow(answer, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank")
    return found.select("query_id", rank, F.col("id").alias(id_column), "score").where(F.col("rank") <= k)


_CELL = pa.schema([("pivot", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("most", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("queries", pa.binary())])
_ASKED = pa.schema([("group", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("least", pa.binary())])
