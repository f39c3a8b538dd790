"""Jaccard join of documents on word shingles by vertical partitioning.

All shingles have one global order: rarer ones first, equally frequent ones by their hashes (counts above 255 are equal). Two documents that link share at least one of
the first n - ceil(n * t) + 1 shingles in this order, where n is the size of a document's set. So documents that share one of these, the keys, are candidates;
a passage in many documents makes candidates only of those that consist of little else.

The hashes are cut into ranges. Blocks of documents send their distinct shingles once to each range, which counts the sets that hold each, and answers with those
that are in two or more. Shingles of one set alone can't be shared, so most documents drop out here, and the others keep the rest of their shingles.

Candidates form clusters. The shingles of a cluster are again cut into fragments of the hashes; the overlaps of all pairs are counted in each
fragment apart, and summed by pair. Tiles have at most about 100 sets; a larger cluster is dealt over many, each with some common leaders, taken from those with the fewest shingles of their own. What
the leaders leave outside of the cluster's largest component then meets, a hundred at a time, all documents with which they share a key. Only a spanning tree of the
links of each tile leaves it.

Equal sets form one class, of which one member is compared. A null or empty text, or one without words, has no shingles and
links with nothing. Rows that repeat an id count as one document with several texts. Rows without an id get no component. Every row gets one row.
Other columns of any name do no harm. An empty table gives an empty result. The rows must come in the same order if a part of the table is read
again, as they do from files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import components, fresh, small_batches, written
from motifold.llm.text import LOWER, Hashes, column_bytes, mix, planes, release, slices, unplaned, word_spans

U = np.uint64
#: Bytes of text handled at once, shingles and documents of a block, bytes of text for each range of the hashes.
PART, BLOCK, BLOCK_DOCS, RANGE = 1 << 19, 800_000, 30_000, 8 << 20
#: Sets in a tile, leaders of a large cluster, shingles in a fragment of a tile, and in the tiles of one task.
TILE, LEADERS, FRAGMENT, BUNDLE = 100, 16, 1 << 13, 1 << 19
#: Bits of a shingle's hash. Two different shingles of a pair of sets of 1,000 are alike with a chance of 1 in 10**11.
BITS = 56
#: Marks of owners: a shingle that several sets of its block hold; a key that stands for a whole set.
SEVERAL, WHOLE = 0xFFFF, 0x8000


class Sets:
    """The distinct shingles' hashes (56 bits) of some texts, one text after the other, each in ascending order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int):
        starts, ends, edges = word_spans(data, offsets)
        names, n = Hashes(LOWER[data]).of(starts, ends), np.diff(edges)
        text = np.repeat(np.arange(len(n)), n)
        window = np.zeros(max(0, len(names) - words + 1), U)
        for k in range(words):
            window = mix(window + names[k : k + len(window)] + U(k + 1))
        whole = text[: len(window)] == text[words - 1 :] if len(window) else np.zeros(0, bool)
        values, owners = [window[whole]], [text[: len(window)][whole]]
        for few in range(1, words):
            at = edges[:-1][n == few]
            short = np.full(len(at), 0x5348_4F52_5400 + few, U)
            for k in range(few):
                short = mix(short + names[at + k] + U(k + 1))
            values.append(short)
            owners.append(np.flatnonzero(n == few))
        value, owner = np.concatenate(values) >> U(64 - BITS), np.concatenate(owners)
        counts = np.bincount(owner, minlength=len(n))
        value = value[np.argsort(owner, kind="stable")] if words > 1 else value
        edges = np.concatenate([[0], np.cumsum(counts)])
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            value[i:j].sort()
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        new[edges[:-1][counts > 0]] = True
        self.value = value[new]
        self.owner = np.repeat(np.arange(len(n)), counts)[new]
        self.size = np.bincount(self.owner, minlength=len(n))
        self.edges = np.concatenate([[0], np.cumsum(self.size)])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that tell different sets apart."""
        out = []
        for salt in (U(0x1234567), U(0x89ABCDEF01)):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.value ^ salt), dtype=U)])
            out.append((total[self.edges[1:]] - total[self.edges[:-1]]).view(np.int64))
        return out[0], out[1]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges each hash is in."""
    return (((hashes >> U(BITS - 32)) * U(parts)) >> U(32)).astype(np.int64)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


_POSTED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([*((c, pa.int64()) for c in ("kind", "block", "id", "n", "one", "two", "k", "m")), ("hashes", pa.binary()), ("nodes", pa.binary())])
DOCUMENT, KEY, EDGE = 0, 1, 2


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _posted(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """Each block's distinct shingles by range, with the set that holds each or the number of such sets; and, in a range of
    its own, the block's documents, and which of them hold the shingles of several. docs: id, text."""

    def block(number: int, ids: list[pa.Array], sets: list[Sets]) -> pa.RecordBatch:
        id_, known = (np.concatenate([f(x) for x in ids]) for f in (lambda x: pc.fill_null(x, 0).to_numpy(), lambda x: x.is_valid().to_numpy(zero_copy_only=False)))
        n = np.concatenate([s.size for s in sets])
        one, two = (np.concatenate(x) for x in zip(*(s.sums() for s in sets), strict=True))
        # one of equal sets stands for all of them
        order = np.lexsort((id_, two, one, n, ~(known & (n > 0))))
        same = np.ones(len(n), bool)
        same[1:] = (n[order][1:] != n[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        stands = np.zeros(len(n), bool)
        stands[order[same]] = True
        stands &= known & (n > 0)
        key = np.concatenate([s.value for s in sets])
        owner = np.repeat(np.arange(len(n)), n)
        key, owner = key[stands[owner]], owner[stands[owner]].astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        at = _starts(key)
        count = np.diff(np.append(at, len(key)))
        several = np.repeat(count > 1, count)
        own = np.stack([id_, known, n, one, two, stands]).astype(np.int64)
        rows = [(-1 - number, number, planes(key[several]), owner[several].tobytes(), own.tobytes())]
        # beside the shingles each whole set has a key, by which one of all blocks is chosen to stand for equal sets
        own = np.flatnonzero(stands)
        distinct = np.concatenate([key[at], mix(one[own].view(U) + mix(two[own].view(U))) >> U(64 - BITS)])
        holder = np.concatenate([np.where(count > 1, SEVERAL, owner[at]), own | WHOLE]).astype(np.uint16)
        order = np.argsort(distinct, kind="stable")
        distinct, holder, count = distinct[order], holder[order], np.append(count, np.ones(len(own), np.int64))[order]
        where = _part(distinct, ranges)
        edges = _starts(where)
        for a, b in zip(edges, [*edges[1:], len(where)][: len(edges)], strict=True):
            rows.append((int(where[a]), number, planes(distinct[a:b]), holder[a:b].tobytes(), count[a:b][holder[a:b] == SEVERAL].astype(np.uint32).tobytes()))
        return _batch(rows, _POSTED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sets, held, many = [], [], 0, 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets, PART):
                if held >= BLOCK or many + j - i > BLOCK_DOCS:
                    yield block(number, ids, sets)
                    number, ids, sets, held, many = number + 1, [], [], 0, 0
                ids.append(batch.column(0).slice(i, j - i))
                sets.append(Sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words))
                held, many = held + len(sets[-1].value), many + j - i
        if many:
            yield block(number, ids, sets)
        release()

    return docs.mapInArrow(each, _ddl(_POSTED))


def _counted(posted: DataFrame) -> DataFrame:
    """For each block its shingles that two sets or more hold anywhere, and how many do; the block's documents (range -1) as they are."""

    def each(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:
            return table.set_column(0, "range", pa.array([-1] * table.num_rows, pa.int64()))
        blocks, blobs, owners, counts = (table.column(c).to_pylist() for c in ("block", "keys", "owners", "counts"))
        parts = [unplaned(x, U) for x in blobs]
        key, owner = np.concatenate(parts), np.frombuffer(b"".join(owners), np.uint16)
        sets = np.ones(len(key), np.int64)
        sets[owner == SEVERAL] = np.frombuffer(b"".join(counts), np.uint32)
        order = np.argsort(key, kind="stable")
        at = _starts(key[order])
        total = np.add.reduceat(sets[order], at)
        sets[order] = np.repeat(total, np.diff(np.append(at, len(key))))
        # of equal sets the one in the first block stands for all; the others are told so
        whole = np.flatnonzero((owner >= WHOLE) & (owner != SEVERAL))
        number = np.repeat(blocks, [len(x) for x in parts])[whole]
        whole = whole[np.lexsort((number, key[whole]))]
        sets[whole[_starts(key[whole])]] = 1
        out, low = [], 0
        for number, part in zip(blocks, parts, strict=True):
            here = np.flatnonzero(sets[low : low + len(part)] > 1)
            if len(here):
                out.append((0, number, planes(part[here]), owner[low + here].tobytes(), np.minimum(sets[low + here], 255).astype(np.uint8).tobytes()))
            low += len(part)
        release()
        return pa.Table.from_batches([_batch(out, _POSTED)])

    return posted.groupBy("range").applyInArrow(each, _ddl(_POSTED))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first shingles a set of n must announce: two sets that link can't differ in so many."""
    return n + percent * n // -100 + 1


def _settled(counted: DataFrame, percent: int, ranges: int) -> DataFrame:
    """Each document with its set's size and sums, and, where it has k > 0 keys, its m shingles that others hold, keys first; one document of each
    block for each key (KEY), and edges from it to the block's others (EDGE)."""

    def each(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("range", "keys", "owners", "counts")), strict=True))
        number = table.column("block")[0].as_py()
        _, blob, owners, docs = next(r for r in rows if r[0] < 0)
        id_, known, n, one, two, _ = np.frombuffer(docs, np.int64).reshape(6, -1)
        answers = [r for r in rows if r[0] >= 0]
        key = np.concatenate([unplaned(r[1], U) for r in answers]) if answers else np.zeros(0, U)
        owner = np.frombuffer(b"".join(r[2] for r in answers), np.uint16).astype(np.int64)
        often = np.frombuffer(b"".join(r[3] for r in answers), np.uint8)
        follows = np.zeros(len(n), bool)
        told = (owner >= WHOLE) & (owner != SEVERAL)
        follows[owner[told] - WHOLE] = True
        key, owner, often = key[~told], owner[~told], often[~told]
        several = owner == SEVERAL
        order = np.argsort(key[several])
        local = unplaned(blob, U)
        found = np.searchsorted(key[several][order], local)
        key, owner, often = np.concatenate([key[~several], local]), np.concatenate([owner[~several], np.frombuffer(owners, np.uint16)]), np.concatenate([often[~several], often[several][order][found]])
        key, owner, often = (x[~follows[owner]] for x in (key, owner, often))
        order = np.lexsort((key, often, owner))
        key, owner = key[order], owner[order]
        shared = np.bincount(owner, minlength=len(n))
        # shingles that no other set holds come first
        k = np.clip(prefix(n, percent) - (n - shared), 0, shared)
        start = np.cumsum(shared) - shared
        hashes = [key[a : a + m].tobytes() if x else None for a, m, x in zip(start, shared, k, strict=True)]
        size = len(n)
        documents = [np.zeros(size, np.int64), np.full(size, number), pa.array(id_, mask=known == 0), n, one, two, k, shared, pa.array(hashes, pa.binary()), pa.nulls(size, pa.binary())]
        is_key = np.arange(len(key)) - start[owner] < k[owner]
        key, node, a, b = _chains(key[is_key], id_[owner[is_key]])
        out = [(EDGE, number, *[None] * 6, a.tobytes(), b.tobytes())] if len(a) else []
        where = _part(key, ranges)
        edges = _starts(where)
        out += [(KEY, int(where[x]), *[None] * 6, key[x:y].tobytes(), node[x:y].tobytes()) for x, y in zip(edges, [*edges[1:], len(key)][: len(edges)], strict=True)]
        release()
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(x) for x in documents], schema=_FOUND), _batch(out, _FOUND)])

    return counted.groupBy("block").applyInArrow(each, _ddl(_FOUND))


def _chains(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest node of each key; and edges from it to the key's other nodes, each once."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    other = np.flatnonzero(~new & (head != node))
    edges = np.unique(np.stack([head[other], node[other]]), axis=1) if len(other) else np.zeros((2, 0), np.int64)
    return key[new], node[new], edges[0], edges[1]


def _candidates(found: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all documents which share a key."""

    def meet(table: pa.Table) -> pa.Table:
        key, node = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hashes", U), ("nodes", np.int64)))
        _, _, a, b = _chains(key, node)
        return pa.table({"a": a, "b": b})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (a, b)], names=["a", "b"])

    within = found.where(F.col("kind") == EDGE).select("hashes", "nodes").mapInArrow(spread, "a long, b long")
    return found.where(F.col("kind") == KEY).select("block", "hashes", "nodes").groupBy("block").applyInArrow(meet, "a long, b long").unionByName(within)


def _overlaps(count: int, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many values each two of `count` sets share."""
    shared = np.zeros((count, count), np.int64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    at = _starts(value)
    often = np.diff(np.append(at, len(value)))
    owner, often = owner[np.repeat(often > 1, often)], often[often > 1]
    column = np.repeat(np.arange(len(often)), often)
    for low in range(0, len(often), 1 << 14):
        pick = slice(*np.searchsorted(column, [low, low + (1 << 14)]))
        table = np.zeros((count, min(1 << 14, len(often) - low)), np.float32)
        table[owner[pick], column[pick] - low] = 1
        shared += (table @ table.T).astype(np.int64)
    return shared


def _groups(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each can reach."""
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            return label
        label = low


_CUT = pa.schema([("bundle", pa.int64()), ("part", pa.int64()), ("heads", pa.binary()), ("hashes", pa.binary())])
_TOLD = pa.schema([*((c, pa.int64()) for c in ("bundle", "c", "i", "j")), ("ids", pa.binary()), ("sizes", pa.binary()), ("shared", pa.binary())])
_PLACED = ("bundle", "cuts", "c", "i", "j", "id", "one", "n")


def _tiles(placed: DataFrame, shingles: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the links within each tile (c, i, j). placed: c, i, j, cuts (fragments of the tile), id, one, n, hashes;
    shingles: how many these are.

    The overlaps of a tile's pairs are counted in each fragment apart, and summed for each pair.
    """
    bundles = max(1, -(-shingles // BUNDLE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = np.stack([batch.column(k).to_numpy() for k in range(len(_PLACED))], axis=1)
            out: dict[tuple[int, int], tuple[list, list]] = {}
            for head, blob in zip(heads, batch.column(len(_PLACED)).to_pylist(), strict=True):
                value = np.frombuffer(blob, U)
                part = _part(value, int(head[1]))
                for k in range(head[1]):
                    own = value[part == k]
                    h, v = out.setdefault((int(head[0]), k), ([], []))
                    h.append([*head[2:], len(own)])
                    v.append(own.tobytes())
            yield _batch([(*key, np.array(h, np.int64).tobytes(), b"".join(v)) for key, (h, v) in out.items()], _CUT)

    def count(table: pa.Table) -> pa.Table:
        head = np.frombuffer(b"".join(table.column("heads").to_pylist()), np.int64).reshape(-1, 7)
        value = np.frombuffer(b"".join(table.column("hashes").to_pylist()), U)
        begin = np.cumsum(head[:, 6]) - head[:, 6]
        order = np.lexsort(head[:, 4::-1].T)
        tile = head[order, :3]
        edges = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(axis=1)))
        out = []
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            own = order[a:b]
            sets = np.concatenate([value[begin[k] : begin[k] + head[k, 6]] for k in own])
            shared = _overlaps(len(own), sets, np.repeat(np.arange(len(own)), head[own, 6]))
            pairs = shared[np.triu_indices(len(own), 1)].astype(np.uint32)
            out.append((table.column("bundle")[0].as_py(), *map(int, tile[a]), head[own, 3].tobytes(), head[own, 5].tobytes(), planes(pairs)))
        release()
        return pa.Table.from_batches([_batch(out, _TOLD)])

    def total(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sums: dict[tuple, np.ndarray] = {}
        for *tile, ids, sizes, shared in zip(*(table.column(c).to_pylist() for c in _TOLD.names[1:]), strict=True):
            key = (*tile, ids, sizes)
            sums[key] = sums.get(key, 0) + unplaned(shared, np.uint32).astype(np.int64)
        for (*_, ids, sizes), pairs in sums.items():
            id_, n = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
            shared = np.zeros((len(n), len(n)), np.int64)
            shared[np.triu_indices(len(n), 1)] = pairs
            shared += shared.T
            union = n[:, None] + n[None, :] - shared
            label = _groups((100 * shared >= percent * union) & (shared > 0), id_)
            a.append(label[label != id_])
            b.append(id_[label != id_])
        release()
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    bundle = F.pmod(F.xxhash64("c", "i", "j"), F.lit(bundles)).alias("bundle")
    held = placed.select(bundle, *[F.col(c).cast("long") for c in _PLACED[1:]], "hashes")
    return held.mapInArrow(cut, _ddl(_CUT)).groupBy("bundle", "part").applyInArrow(count, _ddl(_TOLD)).groupBy("bundle").applyInArrow(total, "a long, b long")


def link(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id for each row of docs; the id column holds integers.

    Documents link when 100 * shared >= percent * all of their distinct shingles of `words` words. component_id is the smallest id
    that can be reached by links, an id's own included.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ranges = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE))
    found = written(_settled(_counted(_posted(rows, words, ranges)), percent, max(1, ranges // 8)), "found")
    all_ = found.where(F.col("kind") == DOCUMENT)
    sized = all_.where("id is not null and n > 0")
    classes = sized.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep != last").drop("last")
    same = sized.select("id", "n", "one", "two").join(classes, ["n", "one", "two"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # the documents that stand for their classes, in the clusters of all that they share a key with
    near = written(components(_candidates(found), "a", "b"), "clusters")
    own = ["block", "id", "one"]
    apart = (F.col("n") - F.col("m")).alias("apart")
    members = written(sized.where("k > 0").select(*own, "n", "m", apart).join(near, F.col("id") == F.col("node")).withColumnRenamed("label", "c").drop("node"), "members")
    # those with the fewest shingles of their own are the middle of a cluster, and some of these its leaders
    middle = members.groupBy("c").agg(F.count("*").alias("count"), F.sum("m").alias("sum"), F.percentile_approx("apart", 0.1, 100).alias("middle")).where("count > 1")
    able = members.join(middle.where(F.col("count") > TILE).select("c", "middle"), "c").where("apart <= middle").groupBy("c").agg(F.ceil(F.count("*") / LEADERS).alias("gap"))
    blocks = F.ceil(F.col("count") / TILE)
    counts = written(middle.join(able, "c", "left").select("c", "middle", "gap", blocks.alias("blocks"), F.ceil(F.col("sum") / blocks / FRAGMENT).alias("cuts")), "counts")
    sets = written(found.where(F.col("k") > 0).select(*own, "k", "hashes").join(members.join(counts, "c"), own), "sets")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    leads = (F.col("blocks") > 1) & (F.col("apart") <= F.col("middle")) & (F.pmod(F.xxhash64(F.lit(7), "id"), F.col("gap")) == 0)
    everywhere = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block)))
    tiled = sets.select("c", everywhere.alias("i"), F.lit(0).cast("long").alias("j"), "cuts", "id", "one", "n", "hashes")
    edges = written(_tiles(tiled, members.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0], percent), "links")
    edges = edges.unionByName(_left_apart(sets.where("blocks > 1"), edges, percent))
    parts = components(edges.unionByName(same), "a", "b")
    return all_.join(parts, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def _left_apart(large: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links of large clusters between documents that no tile of the first round held together: whatever is outside of
    a cluster's largest component meets, in groups, the documents with which the group shares a key."""
    if large.isEmpty():
        return edges.limit(0)
    own = ["block", "id", "one"]
    rest = [*own, "m", "cuts", "c"]
    parts = components(edges.join(large.select(F.col("id").alias("a")).distinct(), "a", "left_semi"), "a", "b")
    labelled = written(large.select(*rest).join(parts, F.col("id") == F.col("node"), "left").select(*rest, F.coalesce("label", "id").alias("label")), "labelled")
    main = labelled.groupBy("c", "label").count().groupBy("c").agg(F.max(F.struct("count", "label")).alias("top")).select("c", F.col("top.label").alias("main"))
    apart = written(labelled.join(main, "c").where("label != main").drop("label", "main"), "apart")
    if apart.isEmpty():
        return edges.limit(0)
    groups = apart.groupBy("c").agg(F.ceil(F.count("*") / TILE).alias("groups"))
    asking = written(apart.join(groups, "c").withColumn("j", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("groups"))).drop("groups"), "groups")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            key = [np.frombuffer(x, np.int64)[:m] for x, m in zip(batch.column(1).to_pylist(), k, strict=True)]
            who = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), *(x.take(who) for x in batch.columns[2:])], names=["key", *rest])

    # of the clusters in which any is apart, all documents with their keys
    whole = large.join(apart.select("c").distinct(), "c", "left_semi").select("k", "hashes", *rest)
    held = written(whole.mapInArrow(keys, "key long, " + ", ".join(f"{c} long" for c in rest)), "keys")
    asked = held.join(asking.select(*own, "c", "j"), [*own, "c"]).select("c", "key", "j").distinct()
    touched = written(held.join(asked, ["c", "key"]).drop("key").unionByName(asking).distinct(), "touched")
    across = touched.groupBy("c", "j").agg(F.ceil(F.count("*") / TILE).alias("across"))
    # the group's own documents stand in each of its tiles, which the others are dealt over
    mine = asking.select(*own, "c", "j", F.lit(True).alias("mine"))
    placed = touched.join(across, ["c", "j"]).join(mine, [*own, "c", "j"], "left")
    tile = F.explode(F.when(F.col("mine"), F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "one"), F.col("across")))))
    placed = written(placed.select("c", tile.alias("i"), (F.col("j") + 1).alias("j"), "cuts", *own, "m"), "placed")
    tiled = placed.drop("m").join(large.select(*own, "n", "hashes"), own)
    return written(_tiles(tiled, placed.agg(F.sum("m")).first()[0], percent), "links")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component does, the one with the smallest id.
    Of rows that repeat an id and its text one stays; different texts of one id are different documents. Rows without an id stay."""
    if docs.where(F.col(id_column).isNotNull()).groupBy(id_column).count().where("count > 1").isEmpty():
        found = link(docs, id_column, text_column, words, percent)
        mark = fresh("stays", docs)
        stay = found.where(F.col(id_column) == F.col("component_id")).select(F.col(id_column).alias(mark))
        kept = docs.join(stay, F.col(id_column) == F.col(mark), "left_semi")
    else:
        kept = _keep_texts(docs, id_column, text_column, words, percent)
    return kept.unionByName(docs.where(F.col(id_column).isNull()))


def _keep_texts(docs: DataFrame, id_column: str, text_column: str, words: int, percent: int) -> DataFrame:
    """The same where ids repeat: each different text of an id is a document, with a number of its own."""
    text = F.col(text_column).cast("string")
    which = F.coalesce(F.sha2(text, 256), F.lit(""))
    apart = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), text.alias("text"), which.alias("which")).dropDuplicates(["id", "which"])
    apart = written(apart.withColumn("node", F.monotonically_increasing_id()), "apart")
    found = link(apart, "node", "text", words, percent).join(apart.select("node", "id", "which"), "node")
    mark, other, name = (fresh(x, docs) for x in ("stays", "text", "which"))
    stay = written(found.groupBy("component_id").agg(F.min(F.struct("id", "which")).alias("x")).select(F.col("x.id").alias(mark), F.col("x.which").alias(other)), "stay")
    first = docs.withColumn(name, which).dropDuplicates([id_column, name])
    return first.join(stay, (F.col(id_column) == F.col(mark)) & (F.col(name) == F.col(other)), "left_semi").drop(name)
