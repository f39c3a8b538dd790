"""Quality rules from repetition inside each text.

A suffix array over the words of each text gives the longest repeat at every word. Repeats of `span` words or more
are the maximal repeated substrings; the union of their spans must cover at most `covered` percent of the words, and
no repeat may have `longest` words or more. Before that, a text fails with fewer than 50 words, or when over half of its
words stand in a 3-word window found twice or more.

Words are runs of characters other than 0x20 and 0x09-0x0D, compared as they are. A null or empty text has no words,
all its counts are 0, and it fails. Every row gets one row, repeated ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import small_batches
from motifold.llm.suffix import MOST, common_prefixes, neighbours, suffix_array
from motifold.llm.text import Hashes, column_bytes, release, slices, word_spans

SPAN, COVERED, LONGEST = 8, 40, 200
#: Bytes of text handled at once; a longer text alone.
PART = 1 << 18
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which words stand in a repeat of at least `least` words that begins at one of the words."""
    begins = np.flatnonzero(length >= least)
    change = np.zeros(len(length) + 1, np.int64)
    change[begins] += 1
    np.add.at(change, begins + length[begins], -1)
    return np.cumsum(change[:-1]) > 0


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeats(names: np.ndarray, edges: np.ndarray, span: int, cap: int) -> np.ndarray:
    """n_repeat_words, covered_words and longest_repeat (up to cap) of texts whose words' names stand between edges."""
    n = len(edges) - 1
    words = np.diff(edges)
    out = np.zeros((3, n), np.int64)
    if not len(names):
        return out
    ends = np.repeat(edges[1:], words)
    rank = np.unique(names, return_inverse=True)[1]
    order = suffix_array(np.repeat(np.arange(n), words) << 21 | rank, ends, 1)
    length = neighbours(order, _within(rank, ends, order, max(cap, span, 3)))
    out[0] = _sums(_covered(np.where(length >= 3, 3, 0), 3), edges)
    out[1] = _sums(_covered(np.where(length >= span, span, 0), span), edges)
    full = words > 0
    out[2][full] = np.maximum.reduceat(length, edges[:-1][full])
    return out


def _within(rank: np.ndarray, ends: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours that stand in one text; neighbours of two texts share none."""
    return common_prefixes(rank, ends, order, cap, alike=ends)


def _long(names: np.ndarray, span: int, cap: int) -> list[int]:
    """The same for one text beyond an array's size: repeats by the distinct windows of each length."""
    n = len(names)

    def repeated(width: int) -> np.ndarray:
        if n < width:
            return np.zeros(0, np.int64)
        window, have = names.copy(), 1
        while have < width:
            step = min(have, width - have)
            window = np.unique(window[: len(window) - step] * np.uint64(0x9E3779B97F4A7C15) + (window[step:] ^ np.uint64(step)), return_inverse=True)[1].astype(np.uint64)
            have += step
        inverse, count = np.unique(window, return_inverse=True, return_counts=True)[1:]
        return np.flatnonzero(count[inverse] > 1)

    def cover(width: int) -> int:
        length = np.zeros(n, np.int64)
        length[repeated(width)] = width
        return int(_covered(length, width).sum())

    low, high = 0, min(cap, n)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if len(repeated(middle)) else (low, middle - 1)
    return [cover(3), cover(span), low]


def measure(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, longest: int = LONGEST) -> np.ndarray:
    """The COUNTS of each text, a row for each count."""
    out = np.zeros((len(COUNTS), len(offsets) - 1), np.int64)
    for i, j in slices(offsets, PART):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, edges = word_spans(part, at)
        out[0, i:j] = np.diff(edges)
        inside = np.zeros(len(part) + 1, np.int64)
        inside[starts] += 1
        inside[ends] -= 1
        out[1, i:j] = _sums((np.cumsum(inside[:-1]) > 0) & ((part & 0xC0) != 0x80), at)
        out[2, i:j] = _sums(SYMBOLS[part], at)
        raw = part.tobytes()
        for k in range(i, j):
            lines = [x for x in raw[at[k - i] : at[k - i + 1]].split(b"\n") if x.strip()]
            out[3, k] = len(lines) - len(set(lines))
        names = Hashes(part).of(starts, ends)
        if len(names) <= MOST:
            out[4:, i:j] = _repeats(names, edges, span, longest)
        else:
            out[4:, i] = _long(names, span, longest)
    return out


def verdicts(counts: np.ndarray, covered: int = COVERED, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept, from measure()'s counts."""
    failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
    return failed, ~failed & (100 * counts[5] <= covered * counts[0]) & (counts[6] < longest)


def rate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """A row for each row of docs: its id, the COUNTS, base_failed and kept. Other columns are not read."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = measure(*column_bytes(batch.column(1)), span, longest)
            failed, kept = verdicts(counts, covered, longest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(failed), pa.array(kept)], names=["id", *COUNTS, "base_failed", "kept"])
        release()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean").withColumnRenamed("id", id_column)


def keep(docs: DataFrame, text_column: str = "text", span: int = SPAN, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = verdicts(measure(*column_bytes(batch.column(place)), span, longest), covered, longest)[1]
            yield batch.filter(pa.array(kept))
        release()

    return docs.mapInArrow(each, docs.schema)
