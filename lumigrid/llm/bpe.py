"""Operator 5: byte-level BPE encoding and decoding.

The ranks of a tiktoken file are mapped byte by byte to Latin-1, so that
pyahocorasick's trie answers "longest vocabulary entry from here" in C.  A
match of the splitting pattern is encoded by backtracking from the longest
match: a token may follow another only if byte-pair merging of the two joined
would keep the boundary between them.  That compatibility depends on the pair
alone and is memoised; every position is given up at most once, so the work is
linear in the length of the text.

Defined results: a null text counts as empty, an empty text has no ids and
decodes to no bytes; repeated rows are encoded each; other columns are kept.
Ids outside the vocabulary raise KeyError on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.llm.common import small_batches, tidy

#: Entries after which a task's memo of words, pieces or token pairs starts anew.
MEMO = 400_000
#: Bytes of text encoded into one Arrow batch, about.
BATCH_BYTES = 4_000_000


class Ranks:
    """A vocabulary of ranks with the tables that encoding needs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in pairs}
        self.spell = {b: a for a, b in self.rank.items()}
        self.blob = np.frombuffer("".join(self.rank).encode("latin-1"), np.uint8)
        self.sizes, self.starts = np.zeros((2, max(self.spell) + 1), np.int64)
        lengths = np.array([len(x) for x in self.rank])
        self.sizes[list(self.spell)] = lengths
        self.starts[list(self.spell)] = np.cumsum(lengths) - lengths
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in self.rank:
            self.trie.add_word(word)
        self.size = {t: len(s) for s, t in self.rank.items()}
        self.longest = max(self.size.values())
        self.pieces = regex.compile(pattern)
        self.shorter = {t: self._within(s, len(s) - 1) for t, s in self.spell.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, list[int]] = {}
        for t in sorted(self.spell):
            self._learn(t)
        self.fits.clear()
        self.words = _Words(self)

    def _within(self, text: str, most: int) -> int | None:
        """The longest entry that starts ``text`` and has ``most`` characters or fewer."""
        for n in range(most, 0, -1):
            if (t := self.rank.get(text[:n])) is not None:
                return t
        return None

    def _learn(self, token: int) -> None:
        """The merge that makes ``token`` from two tokens of lower rank."""
        spell, left = self.spell[token], self.shorter[token]
        while left is not None:
            right = self.rank.get(spell[len(self.spell[left]) :])
            if right is not None and left < token and right < token and self._keeps(left, right):
                self.pair[left, right] = token
                self.halves[token] = left, right
                return
            left = self.shorter[left]
        self.halves[token] = token, token  # a single byte, or out of reach of merges

    def _keeps(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` leaves exactly these two.

        Undoes merges on both sides of the boundary, the latest first; a merge
        across it would have come earlier if its rank is below what is undone.
        """
        limit, pair, halves = float("inf"), self.pair, self.halves
        while pair.get((a, b), limit) >= limit:
            inner_a, inner_b = halves[a][1], halves[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (inner_a != a and a > b):
                limit, a = a, inner_a
            else:
                limit, b = b + 1, inner_b
        return False

    def merged(self, piece: str) -> list[int]:
        """The ids of one match of the pattern, given as Latin-1 of its bytes."""
        rank, fits, size = self.rank, self.fits, self.size
        whole = rank.get(piece)
        if whole is not None:
            return [whole]
        if len(fits) > MEMO:
            fits.clear()
        longest_prefix, most, length = self.trie.longest_prefix, self.longest, len(piece)
        ids: list[int] = []
        at, shut, last, token = 0, set(), None, None
        while at < length:
            if token is None:  # the longest entry from here
                part = piece[at : at + most]
                n = longest_prefix(part)
                while (token := rank.get(part[:n])) is None:
                    n -= 1
            end = at + size[token]
            if end not in shut:
                if last is None or (fit := fits.get((last, token))):
                    ids.append(token)
                    at, last, token = end, token, None
                    continue
                if fit is None:
                    fits[last, token] = self._keeps(last, token)
                    continue
            token = self.shorter[token]
            if token is None:
                shut.add(at)
                token = ids.pop()
                at -= size[token]
                last = ids[-1] if ids else None
        return ids

    def encode_plain(self, text: str) -> list[int]:
        ids: list[int] = []
        parts = self.parts
        if len(parts) > MEMO:
            parts.clear()
        for piece in self.pieces.findall(text):
            found = parts.get(piece)
            if found is None:
                found = self.merged(piece if piece.isascii() else piece.encode().decode("latin-1"))
                if len(piece) <= 32:
                    parts[piece] = found
            ids += found
        return ids

    #: A blank before white space or the end: only there may a match pass a blank's left side.
    _odd = re.compile(r" (?:\s|\Z)")

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text.  Outside odd runs of white space no match reaches over
        the left side of a blank, so words with their blank are encoded alone."""
        if not text:
            return np.empty(0, np.int32)
        if self._odd.search(text):
            return np.array(self.encode_plain(text), np.int32)
        first, *rest = text.split(" ")
        words = self.words
        if len(words) > MEMO:
            words.clear()
        return np.frombuffer(array("i", self.encode_plain(first)).tobytes() + b"".join(map(words.__getitem__, rest)), np.int32)

    def forget(self) -> None:
        """Empties the memos, so that a worker's later tasks have the memory."""
        for memo in (self.words, self.parts, self.fits):
            memo.clear()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many ids one after another, and how many each has."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise KeyError("an id outside the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[at], sizes


class _Words(dict):
    """Packed ids of words met before, each after a blank."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.ranks.encode_plain(" " + word)).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """One vocabulary per Python worker."""
    return Ranks(path, pattern)


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows cut into parts of bounded text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sums, start = np.cumsum(sizes), 0
    while start < len(texts):
        before = sums[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sums, before + BATCH_BYTES)))
        yield slice(start, stop)
        start = stop


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])), type=pa.list_(pa.field("element", pa.int32(), False)))


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array ``ids`` of each ``text``; a column named ``ids`` is replaced."""
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            for part in _slices(batch.column(at)):
                rows = batch.slice(part.start, part.stop - part.start)
                found = [table.encode(t or "") for t in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists(found)], [*rows.schema.names, ids])
        table.forget()

    return df.mapInArrow(tidy(run), schema)


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes ``out`` that the array ``ids`` stands for; null ids give null."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            for start in range(0, len(batch), 512):
                rows = batch.slice(start, 512)
                lists = rows.column(at)
                values, sizes = table.decode(lists.flatten().to_numpy(zero_copy_only=False))
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
                texts = pc.if_else(pc.is_valid(lists), texts.cast(pa.binary()), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], [*rows.schema.names, out])

    return df.mapInArrow(tidy(run), schema)


def checked(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", digest: str = "text_sha256") -> DataFrame:
    """``df`` without ``text``, with its array ``ids`` and the hex SHA-256 ``digest`` of the bytes that the ids are decoded to.

    Both happen in one Python worker: as two steps a task has two, and texts and bytes go back to the JVM.
    """
    df = small_batches(df.select(*[c for c in df.columns if c not in (ids, digest)]))
    names = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(digest, T.StringType(), False)])

    def digests(table: Ranks, found: list[np.ndarray]) -> Iterator[str]:
        for start in range(0, len(found), 64):
            some = found[start : start + 64]
            values, sizes = table.decode(np.concatenate(some))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, some)])]
            for a, b in zip(ends, ends[1:]):
                yield hashlib.sha256(values[a:b]).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            for part in _slices(batch.column(text)):
                rows = batch.slice(part.start, part.stop - part.start)
                found = [table.encode(t or "") for t in rows.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], _lists(found), pa.array(digests(table, found), pa.string())], [*names, ids, digest])
        table.forget()

    return df.mapInArrow(tidy(run), schema)


def digest_of_ids(ids: str = "ids") -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
