"""Byte-pair encoding by backtracking, and decoding by an offset table.

A vocabulary file in the tokenizers library's format (byte-level BPE) is read, never trained. Texts are cut by the pre-tokenizer's
pattern. In each piece an Aho-Corasick automaton finds the longest token at every place; the encoder goes from one to the next, and keeps
two tokens side by side only if merging their bytes by rank would have left that boundary (the pair table). Where it would not, it takes the
next shorter token, or goes back; places known to be dead ends are marked, so the time is linear. Pieces that were encoded before
come from a bounded cache, which changes no result; when it is full, the pieces that are still in use stay.

A null or empty text has no tokens. Text is never truncated. Every row gets one row.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import small_batches
from motifold.llm.text import column_bytes, release, slices

#: The pre-tokenizer's fixed pattern, with white space spelt out as the property that it stands for there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PART, CACHE = 1 << 19, 1 << 18


class Cache(dict):
    """Results of a function, at most twice `most`: when `most` are held they become the older ones, and those of them that are asked for come back."""

    def __init__(self, function: Callable[[Any], Any], most: int):
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=1)
def narrow_pattern() -> re.Pattern[str]:
    """PATTERN for texts without characters beyond U+FFFF: regex lists the properties' characters, and re is faster on such sets."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    space, letter, number = ("".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(rf"\p{{{name}}}+", plane)) for name in ("White_Space", "L", "N"))
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        kind = model["model"]
        if kind["type"] != "BPE" or kind.get("continuing_subword_prefix") or kind.get("end_of_word_suffix") or model.get("normalizer") or (model["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE vocabularies are read")
        split = model["pre_tokenizer"]
        if split.get("add_prefix_space") or not split.get("use_regex", True) or kind.get("dropout") or kind.get("ignore_merges") or kind.get("byte_fallback"):
            raise ValueError("a prefix space, splitting without the pattern, dropout, ignored merges and byte fallback are not handled")
        if any(t.get(flag) for t in model["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take spaces or whole words are not handled")
        byte = _characters()
        as_bytes = lambda token: bytes(byte[c] for c in token)
        vocab = {as_bytes(t): i for t, i in kind["vocab"].items() if all(c in byte for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["merges"]]
        #: By rank: single bytes come before all merges. Tokens are handled by rank, and ids are looked up at the end.
        self.bytes = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        rank = {t: r for r, t in enumerate(self.bytes)}
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = as_bytes(left), as_bytes(right)
            pair = rank[a], rank[b]
            self.pairs[pair] = len(self.bytes)
            rank[a + b] = len(self.bytes)
            self.bytes.append(a + b)
            self.parts.append(pair)
        self.id = [vocab[t] for t in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            if len(t) > 1:
                self.automaton.add_word(t.decode("latin-1"), (r, len(t) - 1))
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.bytes]
        #: The longest token that is a proper prefix of each token.
        self.shorter = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in self.bytes]
        #: Pairs of tokens whose compatibility is known; bounded.
        self.table = Cache(lambda pair: self.compatible(pair >> 20, pair & 0xFFFFF), CACHE)
        self.added = {a["content"]: a["id"] for a in model["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        tokens = {i: t for t, i in vocab.items()} | {i: c.encode() for c, i in self.added.items()}
        #: The bytes of all tokens in the order of their ids, and where each begins.
        self.blob = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)])])
        self.cache = Cache(self.coded, CACHE)
        #: Long pieces in the cache; they leave it with their text.
        self.long: list[str] = []

    def compatible(self, a: int, b: int) -> bool:
        """Whether the boundary between tokens a and b outlasts every merge inside and across them.

        Going back from both tokens to their parts, the one made last first, the parts at the boundary must never be a pair that
        merges before the token that was taken apart last was made.
        """
        limit = len(self.bytes)
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            # of equal tokens the left one is made first, so the right one is taken apart first
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, by backtracking."""
        n, size, table, shorter = len(data), self.size, self.table, self.shorter
        longest = list(data)
        # matches come by their ends, so of those from one place the longest comes last
        for end, (token, before) in self.automaton.iter(data.decode("latin-1")):
            longest[end - before] = token
        if n and size[longest[0]] == n:
            return [self.id[longest[0]]]
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        last, at, token = -1, 0, longest[0] if n else 0
        while at < n:
            end = at + size[token]
            if alive[end]:
                if last < 0 or table[last << 20 | token]:
                    out.append(token)
                    last, at = token, end
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            if token < 0:
                # nothing that begins here leads on: the token before must end elsewhere
                alive[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return [self.id[t] for t in out]

    def coded(self, word: str) -> bytes:
        if len(word) > 64:
            self.long.append(word)
        return array("i", self.piece(word.encode())).tobytes()

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Pieces of a text, and the ids of added tokens between them."""
        narrow = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        pattern = narrow_pattern() if narrow else self.pattern
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield pattern.findall(text, at, m.start())
            yield self.added[m[0]]
            at = m.end()
        yield pattern.findall(text[at:] if at else text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. The cache holds each piece's ids as bytes, so that joining them needs no object for each id."""
        out: list[bytes] = []
        for part in self.words(text):
            if isinstance(part, int):
                out.append(np.int32(part).tobytes())
            else:
                out.append(b"".join(map(self.cache.__getitem__, part)))
        while self.long:
            word = self.long.pop()
            self.cache.pop(word, None)
            self.cache.older.pop(word, None)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from the offset table."""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        places = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        return self.blob[places].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and ids (array of int) of each row of docs. path: a vocabulary file that every executor has."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            offsets = column_bytes(batch.column(1))[1]
            for i, j in slices(offsets, PART):
                part = batch.slice(i, j - i)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ids)))], names=["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def code(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids, and the text that the ids decode to, of each row of docs: encode() and decode() in one pass, by one worker."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            offsets = column_bytes(batch.column(1))[1]
            for i, j in slices(offsets, PART):
                part = batch.slice(i, j - i)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                texts = [own.decode(x).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ids))), pa.array(texts, pa.string())], names=["id", "ids", "text"])
        release()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_column)


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id, ids and text for each row of tokens, as encode() makes them; bytes that are no UTF-8 become U+FFFD."""
    small_batches(tokens.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            column = batch.column(1)
            edges = column.offsets.to_numpy()
            ids = column.values.to_numpy(zero_copy_only=False)
            for i in range(0, len(column), 256):
                rows = range(i, min(len(column), i + 256))
                texts = [own.decode(ids[edges[k] : edges[k + 1]]).decode("utf-8", "replace") for k in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), column.slice(i, len(rows)), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = tokens.schema[id_column].dataType.simpleString()
    rows = tokens.select(F.col(id_column).alias("id"), F.coalesce(ids_column, F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(each, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_column)
