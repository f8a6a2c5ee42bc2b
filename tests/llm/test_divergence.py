"""The divergence audit against plain arithmetic, with nulls, ties, repeats and hash collisions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["term", "n", "docs", "value", "rank", "item", "part", "gid", "tid", "total", "all", "v", "a", "b", "block"]
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def expected(rows, least=3, top=200):
    docs = [(lower(t or ""), a or "", s or "") for _, t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in docs}:
        own = [(TERM.findall(t), s) for t, a, s in docs if a == lang]
        held = Counter(w for words, _ in own for w in set(words))
        kept = {w for w, n in held.items() if n >= least}
        counts = {s: Counter(w for words, x in own if x == s for w in words if w in kept) for s in {s for _, s in own}}
        every = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(x, sum(f(p[s][w], p[x][w]) for w in kept)) for x in counts if x != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in CLASH})
    return sorted(tuple(r) for r in divergence.audited(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = ["the", "The", "naïve", "É", "é", "日本", "x", "a1b", "A_B", "ß-ß", "don't", " ", "co\x00de", "zz"]
EDGES = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, None, "en", "empty"),
    (None, "the cat", "en", "a"),
    (4, "1 2 3 _", "xx", "only"),
    (5, "word " * 50_000, "en", "b"),
    (5, "word " * 50_000, "en", "b"),
    (6, "x" * 300_000, "en", "b"),
    (7, "tie tie", "en", "c"),
    (8, "tie tie", "en", "d"),
    (9, "tie Tie", "en", "e"),
]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_arithmetic(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randrange(12))), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", None])) for i in range(80)]
    assert got(spark, rows + EDGES) == expected(rows + EDGES)
    assert got(spark, rows + EDGES, top=2, least=1) == expected(rows + EDGES, 1, 2)


def test_blocks_and_chunks(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i, " ".join(f"w{chr(97 + r.randrange(26))}" for _ in range(20)), "en", f"s{i % 7}") for i in range(60)]
    monkeypatch.setattr(divergence, "CELLS", 10)
    assert got(spark, rows) == expected(rows)


def test_cuts_of_a_batch_lose_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "CHUNK", 30)
    texts = ["aa bb " * 3, "", "cc " * 40, "aa", "bb cc"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 5), pa.array(list("xyxyx"))], ["text", "lang", "source"])
    found = Counter()
    for part in divergence._counts([batch]):
        for r in part.to_pylist():
            found[r["source"], r["term"]] += r["n"]
    assert {k: n for k, n in found.items() if n} == {("x", "aa"): 3, ("x", "bb"): 4, ("x", "cc"): 41, ("y", "aa"): 1}


def test_colliding_hashes_keep_terms_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda s: len(s))
    terms, term, text = divergence.terms_of([b"cat dog cat", b"", b"dog ox"])
    assert [terms[t] for t in term] == [b"cat", b"dog", b"cat", b"dog", b"ox"] and text.tolist() == [0, 0, 0, 2, 2]


def test_shares_do_not_overflow():
    n, total = np.array([0, 1, 10**12, 10**15]), np.array([10**15] * 4)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * int(x) // 10**15 for x in n]


def test_empty_table(spark):
    assert got(spark, []) == []
