"""Operator 8: document fingerprints by locally consistent parsing.

The bytes of a text are level 0.  On each level runs of one symbol become one
symbol, deterministic coin tossing reduces the symbols to labels below six that
differ between neighbours, phrases start where a label exceeds both its
neighbours, and the name of a phrase is a hash of its symbols; the names are the
next level.  Where phrases start depends on a few symbols around alone, so equal
substrings get equal phrases in their interior wherever they stand.

A fingerprint has a number of slots for each of three levels.  A phrase belongs
to the slot that its name says, the least name of a slot stays, as 16 bits (0:
no phrase).  The likeness of two fingerprints is the share of equal slots among
those that either fills: an estimate of the Jaccard similarity of their phrases.

Defined results: a null text counts as empty; an empty text fills no slot; two
empty fingerprints have likeness 1; equal texts have equal fingerprints, alone or
beside any others, repeated rows too; an empty table gives no rows; extra columns
are ignored, a column named like the result is replaced.  A text over ``CHUNK``
bytes is parsed whole in windows, in memory of its own size, about three bytes a
byte for the names of its first level and some 100 MB for a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.common import written

#: Slots by level.
SLOTS = {2: 16, 3: 32, 4: 16}
#: Bytes of text parsed at once, and runs before a phrase that tossing may look at.
CHUNK, CONTEXT = 1_500_000, 8
_NONE = np.iinfo(np.uint64).max
_LOW = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tossed(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each symbol's lowest bit that differs from the left neighbour's: place and value."""
    diff = np.empty_like(s)
    diff[0] = 1
    np.bitwise_xor(s[1:], s[:-1], out=diff[1:])
    diff[first] = 1
    if s.dtype == np.uint8:
        place = _LOW[diff]
    else:
        place = np.frexp((diff & (~diff + np.uint64(1))).astype(np.float64))[1].astype(np.uint8) - np.uint8(1)
    bit = ((s >> place.astype(s.dtype)) & s.dtype.type(1)).astype(np.uint8)
    return (place << np.uint8(1)) | bit


def _cut(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs and phrases of concatenated texts that start at ``first``: where runs begin, their
    symbols with their lengths, the first run of each phrase and the first run of each text.

    Neighbouring runs differ in their symbol, so tossing needs the symbols alone and takes the
    same steps whatever else is parsed at the same time.
    """
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    new[first] = True
    heads = np.flatnonzero(new)
    label = s[heads]
    run = np.diff(heads, append=len(s)).astype(np.uint64)
    wide = label.astype(np.uint64)
    long = np.flatnonzero(run > 1)
    wide[long] = _mixed(wide[long] + run[long] * np.uint64(0x9E3779B97F4A7C15))
    first = np.searchsorted(heads, first)
    for _ in range(3 if s.dtype == np.uint8 else 4):
        label = _tossed(label, first)
    top = np.zeros(len(label), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    top[first[first + 1 < len(top)] + 1] = False
    if len(first) > 1:
        top[first[1:] - 1] = False
    top[first] = True
    return heads, wide, np.flatnonzero(top), first


def _names(wide: np.ndarray, starts: np.ndarray) -> np.ndarray:
    offset = np.arange(len(wide), dtype=np.uint64) - np.repeat(starts, np.diff(starts, append=len(wide))).astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed(wide + (offset + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), starts))


def _level(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of concatenated texts that start at ``first``, and their starts."""
    _, wide, starts, first = _cut(s, first)
    return _names(wide, starts), np.searchsorted(starts, first)


def _long_level(s: np.ndarray, size: int) -> np.ndarray:
    """Names of the phrases of one long text, parsed in windows of about ``size`` symbols.

    A window begins some runs before the first phrase that has no name yet, so that tossing sees the
    same neighbours as in the whole text; its last phrase is left to the next window.
    """
    out, begin, left, want = [], 0, 0, size
    while begin < len(s):
        stop = min(left + want, len(s))
        heads, wide, starts, _ = _cut(s[left:stop], np.zeros(1, np.int64))
        own = int(np.searchsorted(heads, begin - left))
        starts = np.concatenate([[own], starts[starts > own]])
        end = len(wide) if stop == len(s) else int(starts[-1])
        if end == own:
            want *= 2  # no phrase ends in this window
            continue
        out.append(_names(wide[own:end], starts[starts < end] - own))
        begin = len(s) if end == len(wide) else left + int(heads[end])
        left, want = left + int(heads[max(0, end - CONTEXT)]) if end < len(wide) else begin, size
    return np.concatenate(out)


def fingerprints(texts: list[str]) -> list[bytes]:
    """One fingerprint per text: 16 bits a slot, big-endian."""
    out, part, size = [], [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        if len(b) > CHUNK:
            out += _fingerprints(part) if part else []
            out.append(_long_fingerprint(b))
            part, size = [], 0
            continue
        if size + len(b) > CHUNK and part:
            out += _fingerprints(part)
            part, size = [], 0
        part.append(b)
        size += len(b)
    return out + (_fingerprints(part) if part else [])


def _fill(slots: np.ndarray, of: np.ndarray, base: int, n: int, names: np.ndarray) -> None:
    np.minimum.at(slots, (of, base + (names % np.uint64(n)).astype(np.int64)), names >> np.uint64(8))


def _shown(slots: np.ndarray) -> list[bytes]:
    low = (_mixed(slots) % np.uint64(65535) + np.uint64(1)).astype(">u2")
    low[slots == _NONE] = 0
    return [row.tobytes() for row in low]


def _fingerprints(texts: list[bytes]) -> list[bytes]:
    sizes = np.array([len(t) for t in texts])
    slots = np.full((len(texts), sum(SLOTS.values())), _NONE, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        s, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes[some]) - sizes[some]
        base = 0
        for level in range(1, max(SLOTS) + 1):
            s, first = _level(s, first)
            if n := SLOTS.get(level):
                _fill(slots, np.repeat(some, np.diff(first, append=len(s))), base, n, s)
                base += n
    return _shown(slots)


def _long_fingerprint(text: bytes) -> bytes:
    slots, base, s = np.full((1, sum(SLOTS.values())), _NONE, np.uint64), 0, np.frombuffer(text, np.uint8)
    for level in range(1, max(SLOTS) + 1):
        s = _long_level(s, CHUNK)
        if n := SLOTS.get(level):
            for k in range(0, len(s), CHUNK):
                part = s[k : k + CHUNK]
                _fill(slots, np.zeros(len(part), np.int64), base, n, part)
            base += n
    return _shown(slots)[0]


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, ">u2"), np.frombuffer(b, ">u2")
    filled = (x > 0) | (y > 0)
    n = int(filled.sum())
    return float(((x == y) & filled).sum() / n) if n else 1.0


def fingerprinted(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint (binary) of each text; a column of that name is replaced."""
    df = df.drop(out)

    @F.pandas_udf("binary")
    def udf(column):
        import pandas as pd

        return pd.Series(fingerprints([t or "" for t in column]))

    return df.withColumn(out, udf(F.col(text)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_STATS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _STATS.split(", ")]


def _compared(ids: list, texts: list[str], following: list[str]) -> list[list]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    prints = fingerprints([*texts, *changed, *following[-1:]])
    n = len(texts)
    own, other = prints[:n], prints[n : 2 * n]
    after = own[1:] + prints[2 * n :]
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
        own,
        other,
        [likeness(a, b) for a, b in zip(own, other)],
        [likeness(a, b) for a, b in zip(own, after)],
    ]


def neighbours_compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, made with the text that
    follows in descending doc_id (after the last: the first), and likenesses.

    Texts are dealt once, by ranges of doc_id and, among equal ones, of a hash of the
    text; a null doc_id comes last.  A range leaves out its last text only, whose
    successor starts another range; those are compared afterwards.
    """
    schema = f"kind int, part int, text string, {_STATS}"
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = ["kind", "part", "text", *_NAMES]

    def batch(kind: int, texts: list, columns: list[list]) -> pa.RecordBatch:
        n, part = len(columns[0]), TaskContext.get().partitionId()
        columns = [[kind] * n, [part] * n, texts, *columns, *([[None] * n] * (len(names) - 3 - len(columns)))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, begun = [], [], 0, False
        for rows in batches:
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if not begun:
                    yield batch(1, [t], [[i]])
                    begun = True
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > CHUNK and len(ids) > 1:
                    yield batch(0, [None] * (len(ids) - 1), _compared(ids[:-1], texts[:-1], texts[1:]))
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield batch(0, [None] * (len(ids) - 1), _compared(ids[:-1], texts[:-1], texts[1:]))
        if begun:
            yield batch(2, texts[-1:], [ids[-1:]])

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = written(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, schema))
    heads = done.where("kind = 1").select("part", F.col("text").alias("following"))
    parts = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).crossJoin(F.broadcast(heads.agg(F.min("part").alias("top"))))
    parts = parts.select("part", F.coalesce("next", "top").alias("next"))
    pairs = done.where("kind = 2").select("doc_id", "part", "text").join(parts, "part").join(heads.withColumnRenamed("part", "next"), "next")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = [_compared([i], [t], [f]) for i, t, f in zip(*(rows.column(k).to_pylist() for k in range(3)))]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([p[k][0] for p in parts], kinds[k + 3]) for k in range(len(_NAMES))], _NAMES)

    return done.where("kind = 0").select(*_NAMES).unionByName(pairs.select("doc_id", "text", "following").mapInArrow(last, _STATS))


def shown(column: str) -> Column:
    return F.lower(F.hex(column))
