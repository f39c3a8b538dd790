"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of up to five bytes, pretrained on the training texts. A symbol is predicted by the longest context that has
been seen; where it has not been seen there, an escape (method C: as likely as the number of different symbols) leads to the context one byte shorter, in
which the symbols of the longer one are excluded. Below the empty context every byte that is left is equally likely. A text stands between marks
(byte 0xFF, which no UTF-8 has), and its end is predicted too, so the probabilities of all texts sum to one.

Contexts are nested, and the symbols of a longer one are among those of the shorter. So what exclusion takes away is fixed for each context,
and the probability of a symbol depends on six bytes alone. Nothing that grows with the corpus is broadcast: texts are dealt into
blocks; a block sends each distinct six bytes once, with its count, to the bucket of the three bytes before the symbol, which holds all
that the trie has below that context; the bucket sums up, and answers each block with the probabilities that it needs.
Only contexts up to two bytes (2**24 counts at most) are shared with all buckets. Words are counted the same way, by a 64-bit hash. Many blocks ask
a bucket through groups of blocks, so that the questions about a frequent context never meet in one task.

A null text counts as an empty one: no words, and its end. A row without an id has the remainder of the empty string. Every row gets one row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import small_batches, written
from motifold.llm.text import LOWER, Hashes, column_bytes, mix, planes, release, slices, unplaned, word_spans

U = np.uint64
MARK, ORDER = 0xFF, 5
#: Bytes of text in a block on average, in a slice, and symbols sorted at once; buckets for each block, blocks whose questions meet in one task.
BLOCK, PART, CHUNK, BUCKETS, FAN = 16 << 20, 1 << 19, (1 << 16) - 2, 4, 256
#: The largest count in one word of a tally.
FULL = 0xFFFF


def symbols(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The six bytes that end with each symbol of some texts, and the text it belongs to, in chunks."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    laid = np.full(int(offsets[-1] - offsets[0]) + n * (ORDER + 1), MARK, np.uint8)
    laid[np.arange(len(data)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, sizes)] = data
    owner = np.repeat(np.arange(n), sizes + ORDER + 1)
    ends = np.cumsum(sizes + ORDER + 1)
    real = np.ones(len(laid), bool)
    for k in range(ORDER):
        real[ends - sizes - ORDER - 1 + k] = False
    for low in range(0, len(laid), CHUNK):
        part = laid[max(0, low - ORDER) : low + CHUNK].astype(U)
        gram = np.zeros(len(part), U)
        for k in range(ORDER + 1):
            gram[ORDER:] |= part[ORDER - k : len(part) - k] << U(8 * k)
        skip = min(low, ORDER)
        here = real[low : low + CHUNK]
        yield gram[skip:][here], owner[low : low + CHUNK][here]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = _starts(key)
    return key[at], np.add.reduceat(count, at) if len(key) else count


class Tally:
    """Distinct grams and their counts, merged as they come, in one word each: 48 bits of the gram, 16 of a count (a larger one takes several)."""

    def __init__(self) -> None:
        self.words, self.new, self.held = np.zeros(0, U), [], 0

    def add(self, gram: np.ndarray, count: np.ndarray) -> None:
        self.new.append(gram << U(16) | count.astype(U))
        self.held += len(gram)
        if self.held > max(1 << 20, len(self.words) // 2):
            self._merge()

    def _merge(self) -> None:
        words = np.concatenate([self.words, *self.new])
        self.new, self.held = [], 0
        words.sort()
        gram = words >> U(16)
        at = _starts(gram)
        total = np.add.reduceat(words & U(FULL), at) if len(at) else words
        self.words = gram[at] << U(16) | np.minimum(total, U(FULL))
        over = total > U(FULL)
        if over.any():
            gram, left = gram[at][over], total[over] - U(FULL)
            rows = (left + U(FULL - 1)) // U(FULL)
            more = np.repeat(gram << U(16) | U(FULL), rows.astype(np.int64))
            more[np.cumsum(rows).astype(np.int64) - 1] = gram << U(16) | (left - (rows - U(1)) * U(FULL))
            self.words = np.concatenate([self.words, more])
            self.words.sort()

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams in order, and their counts."""
        self._merge()
        gram = self.words >> U(16)
        at = _starts(gram)
        return gram[at], np.add.reduceat(self.words & U(FULL), at).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def _counted(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is marked in counts (0 or 1)."""
    both = np.sort(key << U(1) | counts.astype(U))
    key = both >> U(1)
    at = _starts(key)
    return key[at], np.add.reduceat((both & U(1)).astype(np.int64), at) if len(key) else np.zeros(0, np.int64)


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of the ordered key, how many rows each has, and sums of the values over them."""
    at = _starts(key)
    return key[at], np.diff(np.append(at, len(key))), *(np.add.reduceat(v, at) if len(key) else v for v in values)


def _find(table: np.ndarray, key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values at each key, 0 where the ordered table lacks it."""
    if not len(table):
        return tuple(np.zeros(len(key), v.dtype) for v in values)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    hit = table[at] == key
    return tuple(np.where(hit, v[at], 0) for v in values)


class Trie:
    """Counts of symbols after contexts of 0, 1, ... bytes, with what exclusion needs of each context."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def grow(self, gram: np.ndarray, count: np.ndarray) -> None:
        """Add the next order: distinct grams (context, then symbol) in order and their counts."""
        k = len(self.grams)
        shorter = _find(self.grams[-1][0], gram & U((1 << 8 * k) - 1), self.grams[-1][1])[0] if k else np.zeros(len(gram), np.int64)
        node, different, total, below = _sums(gram >> U(8), count, shorter)
        self.grams.append((gram, count))
        self.nodes.append((node, total, different, below))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last of the bytes in each gram, after those before it."""
        out = np.zeros(len(gram))
        left = np.ones(len(gram), bool)
        minus, less = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for k in range(len(self.grams) - 1, -1, -1):
            key = gram & U((1 << 8 * (k + 1)) - 1)
            (count,) = _find(self.grams[k][0], key, self.grams[k][1])
            total, different, below = _find(self.nodes[k][0], key >> U(8), *self.nodes[k][1:])
            rest, kinds = total - minus, different - less
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = left & (count > 0)
                out[seen] += np.log10(count[seen] / (rest + kinds)[seen])
                left &= ~seen
                escapes = left & (kinds > 0)
                out[escapes] += np.log10(kinds[escapes] / (rest + kinds)[escapes])
            minus, less = below, different
        out[left] -= np.log10(256 - less[left])
        return out


def low_orders(key: np.ndarray, count: np.ndarray) -> Trie:
    """The trie of up to two bytes of context, from counts of three bytes."""
    trie = Trie()
    for k in range(3):
        trie.grow(*_merge([key & U((1 << 8 * (k + 1)) - 1)], [count]))
    return trie


def high_orders(low: Trie, gram: np.ndarray, count: np.ndarray) -> Trie:
    """low with the orders of three bytes and more added, from counts of all ORDER + 1 bytes."""
    trie = Trie()
    trie.grams, trie.nodes = list(low.grams), list(low.nodes)
    for k in range(3, ORDER):
        trie.grow(*_merge([gram & U((1 << 8 * (k + 1)) - 1)], [count]))
    trie.grow(gram, count)
    return trie


def _small(rows: DataFrame) -> DataFrame:
    """Per part of the input: bytes, training texts, training words, and counts of three bytes in training texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = texts = words = 0
        keys, counts = [], []
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            train = batch.column(2).to_numpy(zero_copy_only=False)
            size += int(offsets[-1] - offsets[0])
            for i, j in slices(offsets, PART):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words += int(np.diff(word_spans(part, at)[2])[train[i:j]].sum())
                texts += int(train[i:j].sum())
                for gram, owner in symbols(part, at):
                    three = np.sort((gram & U(0xFFFFFF))[train[i:j][owner]])
                    key, count = _sums(three)[:2]
                    keys.append(key)
                    counts.append(count)
            key, count = _merge(keys, counts)
            keys, counts = [key], [count]
        if keys:
            for i in range(0, max(1, len(keys[0])), 1 << 16):
                k, c = keys[0][i : i + (1 << 16)].astype(np.int64), counts[0][i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([(size, texts, words)[x] if not i else 0], pa.int64()) for x in range(3)] + [pa.array([k.tolist()], pa.list_(pa.int64())), pa.array([c.tolist()], pa.list_(pa.int64()))], names=["size", "texts", "words", "key", "count"])

    return rows.mapInArrow(each, "size long, texts long, words long, key array<long>, count array<long>")


_ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("key", pa.binary()), ("count", pa.binary())])
_REPLY = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("value", pa.binary())])
ASK, REPLY = "bucket long, block long, key binary, count binary", "bucket long, block long, value binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(columns, schema, strict=True)], schema=schema)


def _distinct(data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """The different grams of some texts and their counts in training texts; and the same of words, by their hashes."""
    grams, names, often = Tally(), [], []
    for i, j in slices(offsets, PART):
        part, at, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], train[i:j]
        starts, ends, edges = word_spans(part, at)
        for gram, owner in symbols(part, at):
            grams.add(*_counted(gram, own[owner]))
        key, count = _counted(Hashes(LOWER[part]).of(starts, ends) >> U(1), np.repeat(own, np.diff(edges)))
        names.append(key)
        often.append(count)
    return grams.counts(), _merge(names, often)


def _by_bucket(kind: int, key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that some keys fall into, and where they are, in order. Grams go by the three bytes before the symbol."""
    bucket = mix((key >> U(8)) & U(0xFFFFFF) if kind == 0 else key) % U(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = _starts(bucket[order])
    for a, b in zip(edges, [*edges[1:], len(order)][: len(edges)], strict=True):
        yield 2 * int(bucket[order[a]]) + kind, order[a:b]


def _ask(rows: DataFrame, buckets: int) -> DataFrame:
    """What each block asks for: distinct grams and words, with their counts in its training texts, by bucket."""

    def each(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = _distinct(*column_bytes(table.column("text")), table.column("train").to_numpy())
        out = [(bucket, block, planes(key[own]), planes(count[own])) for kind, (key, count) in enumerate(found) for bucket, own in _by_bucket(kind, key, buckets)]
        answer = _rows(out, _ASK)
        release()
        return answer

    return rows.groupBy("block").applyInArrow(each, ASK)


def _asked(table: pa.Table) -> tuple[list[int], list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The blocks that ask one bucket, the keys that each asks for, and all different ones with their counts."""
    keys = [unplaned(x, U) for x in table.column("key").to_pylist()]
    counts = [unplaned(x, np.int64) for x in table.column("count").to_pylist()]
    return table.column("block").to_pylist(), keys, _merge(keys, counts)


#: The low orders' trie, which a worker makes once for all its buckets.
_tries: dict[str, Trie] = {}


def _answered(asked: DataFrame, low: object) -> DataFrame:
    """For each bucket and block log10 of the probability of each gram asked for (even buckets), or the count of each word (odd ones), in the
    order of the question; and for block -1 how many different words the training texts have."""
    name = uuid.uuid4().hex

    def each(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks, keys, (key, count) = _asked(table)
        out = []
        if bucket % 2 == 0:
            if name not in _tries:
                _tries.clear()
                _tries[name] = low_orders(*low.value)
            seen = count > 0
            value = high_orders(_tries[name], key[seen], count[seen]).log10(key)
        else:
            value = count
            out.append((bucket, -1, np.array([int((count > 0).sum())], np.int64).tobytes()))
        out += [(bucket, b, value[np.searchsorted(key, k)].tobytes()) for b, k in zip(blocks, keys, strict=True)]
        answer = _rows(out, _REPLY)
        release()
        return answer

    return asked.groupBy("bucket").applyInArrow(each, REPLY)


def _reply(asked: DataFrame, low: object, blocks: int, fan: int) -> DataFrame:
    """The same as _answered; but where there are more than `fan` blocks, each `fan` of them ask together, and share the answer out. So no task holds
    the questions of more than `fan` blocks, and what these ask together is bounded: 2**24 different grams follow three bytes."""
    if blocks <= fan:
        return _answered(asked, low)

    def join(table: pa.Table) -> pa.Table:
        _, _, (key, count) = _asked(table)
        group = table.column("block")[0].as_py() // fan
        return _rows([(table.column("bucket")[0].as_py(), group, planes(key), planes(count))], _ASK)

    def share(questions: pa.Table, answers: pa.Table) -> pa.Table:
        if not questions.num_rows:
            return answers.select(["bucket", "block", "value"])
        blocks_, keys, (key, _) = _asked(questions)
        value = np.frombuffer(answers.column("value")[0].as_py(), np.float64)
        return _rows([(questions.column("bucket")[0].as_py(), b, value[np.searchsorted(key, k)].tobytes()) for b, k in zip(blocks_, keys, strict=True)], _REPLY)

    asked = written(asked, "asked")
    group = F.floor(F.col("block") / fan).cast("long")
    up = asked.groupBy("bucket", group.alias("group")).applyInArrow(join, ASK)
    answers = _reply(up, low, -(-blocks // fan), fan).withColumn("group", F.col("block"))
    return asked.withColumn("group", group).groupBy("bucket", "group").cogroup(answers.groupBy("bucket", "group")).applyInArrow(share, REPLY)


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK, fan: int = FAN) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score and score of each row of docs. train: whether a row is learnt from."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    small = written(_small(rows), "low")
    size, texts, words = small.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "texts", "words")]).first()
    low = small.select(F.explode(F.arrays_zip("key", "count")).alias("x")).groupBy("x.key").agg(F.sum("x.count").alias("count")).toPandas()
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    buckets = BUCKETS * blocks
    shared = spark.sparkContext.broadcast((low["key"].to_numpy().astype(U), low["count"].to_numpy()))  # at most 2**24 counts
    replies = written(_reply(_ask(dealt, buckets), shared, blocks, fan), "replies")
    tail = replies.where("block = -1").select("value").toLocalIterator()
    different = sum(int(np.frombuffer(r[0], np.int64)[0]) for r in tail) + (texts > 0)
    total = words + texts
    unit = math.log10(total + different + 1)

    def each(texts_: pa.Table, replies_: pa.Table) -> pa.Table:
        data, offsets = column_bytes(texts_.column("text"))
        n = len(offsets) - 1
        told = dict(zip(replies_.column("bucket").to_pylist(), replies_.column("value").to_pylist(), strict=True))
        tables = []
        for kind, (key, _) in enumerate(_distinct(data, offsets, np.zeros(n, bool))):
            value = np.zeros(len(key), (np.float64, np.int64)[kind])
            for bucket, own in _by_bucket(kind, key, buckets):
                value[own] = np.frombuffer(told.pop(bucket), value.dtype)
            tables += [key, value]
        grams, values, names, often = tables
        logs = np.log10(often + 1.0)
        score_, base, tokens, known = np.zeros(n), np.zeros(n), np.ones(n, np.int64), np.full(n, int(texts > 0))
        for i, j in slices(offsets, PART):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for gram, owner in symbols(part, at):
                packed = np.sort(gram << U(16) | np.arange(len(gram), dtype=U))
                key, place = packed >> U(16), (packed & U((1 << 16) - 1)).astype(np.int64)
                one, many = _sums(key)[:2]
                value = np.repeat(values[np.searchsorted(grams, one)], many)
                score_[i:j] += np.bincount(owner[place], weights=value, minlength=j - i)
            starts, ends, edges = word_spans(part, at)
            hashes = Hashes(LOWER[part]).of(starts, ends) >> U(1)
            one, where = np.unique(hashes, return_inverse=True)
            found = np.searchsorted(names, one)[where]
            owner = np.repeat(np.arange(j - i), np.diff(edges))
            base[i:j] += np.bincount(owner, weights=logs[found], minlength=j - i)
            tokens[i:j] += np.diff(edges)
            known[i:j] += np.bincount(owner, weights=often[found] > 0, minlength=j - i).astype(np.int64)
        base += math.log10(texts + 1) - tokens * unit
        release()
        return pa.table({"id": texts_.column("id"), "train": texts_.column("train"), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score_})

    scored = dealt.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(each, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_column), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
