"""Search by treaps against the scores of all documents, with nulls, ties, repeats and long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ["score", "rank", "doc", "n", "terms", "tfs", "at", "t"]


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, n = sum(sum(c.values()) for _, c in counts), len(counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                found.append((s, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, k=50, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASH})
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("mine") for c in CLASH})
    found = search.searched(docs.repartition(3), items, k, **options)
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


WORDS = ["the", "The", "cat", "naïve", "É", "日本", "42", "a_b", "x"] + [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_scores(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choices(WORDS, [60 / (i + 1) for i in range(len(WORDS))], k=r.randrange(n)))
    docs = [(i, text(60)) for i in range(300)] + [(None, "cat w3"), (None, None), (900, None), (901, ""), (902, "!!"), (7, "cat w3"), (7, "cat w3"), (903, "cat " * 50_000), (904, "y" * 200_000)]
    items = [(i, text(30)) for i in range(12)] + [(50, None), (51, ""), (None, "cat w3"), (52, "unknown"), (3, "w3"), (3, "w3")]
    for k, shard in ((5, 200), (50, 1 << 21)):
        assert got(spark, docs, items, k, shard=shard) == expected(docs, items, k)


def test_ties_go_to_the_least_id(spark):
    docs = [(i, "tie here") for i in range(200)] + [(500 + i, "other") for i in range(300)]
    found = got(spark, docs, [(1, "tie")], 50)
    assert sorted(x[2] for x in found) == list(range(50)) and found == expected(docs, [(1, "tie")], 50)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 3)
    docs, items = [(i, f"a{i % 5} b{i % 3}") for i in range(30)], [(i, f"a{i % 6} b1") for i in range(11)]
    assert got(spark, docs, items, 4) == expected(docs, items, 4)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "x")]) == [] and got(spark, [(1, "x")], []) == []


def plain_treap(doc, impact, i, j):
    """Root of postings i..j-1: the greatest impact, the first of equal ones."""
    return i + int(np.argmax(impact[i:j])) if i < j else -1


@pytest.mark.parametrize("seed", range(20))
def test_treaps_have_both_orders(seed):
    r = np.random.default_rng(seed)
    term = np.sort(r.integers(0, 4, 60))
    doc = np.concatenate([np.sort(r.choice(100, n, replace=False)) for n in np.bincount(term) if n])
    impact = r.integers(0, 9, 60)
    t = search.Treaps.of(term, doc, impact)
    for name in np.unique(term):
        todo = [(t.root[int(name)], *np.searchsorted(term, [name, name + 1]))]
        while todo:
            root, i, j = todo.pop()
            assert root == plain_treap(doc, impact, i, j)
            if root >= 0:
                todo += [(t.left[root], i, root), (t.right[root], root + 1, j)]


def test_stretches_are_pruned():
    """A rare term's documents are found without looking at all stretches of a common one."""
    n = 4096
    term = np.concatenate([np.zeros(n, int), np.ones(60, int)])
    doc = np.concatenate([np.arange(n), np.arange(60) * 64])
    impact = np.concatenate([np.arange(n) % 7 + 1, np.full(60, 10_000)])
    best = search.Best(50)
    looked = search.walk(search.Treaps.of(term, doc, impact), [0, 1], np.arange(n), best)
    assert len(best.doc) == 50 and set(best.doc) <= set(range(0, 64 * 60, 64)) and looked < n
