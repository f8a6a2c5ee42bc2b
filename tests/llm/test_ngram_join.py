"""The n-gram join against brute force: candidates, trees and the whole."""

import random

import numpy as np
import pytest

from lumigrid.llm import ngram_join as nj


def near(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        k = rng.randrange(3)
        if k == 0 or len(out) < 2:
            out.insert(rng.randrange(len(out) + 1), rng.getrandbits(63))
        elif k == 1:
            out.pop(rng.randrange(len(out)))
        else:
            out[rng.randrange(len(out))] = rng.getrandbits(63)
    return out


@pytest.mark.parametrize("share", [0.5, 0.6, 0.7])
def test_pairs_share_bands_as_often_as_independent_hashes(share):
    rng, n, pairs = np.random.default_rng(3), 200, 3000
    both = round(2 * n * share / (1 + share))
    x = nj.mixed(rng.integers(0, 1 << 63, (pairs, 2 * n - both), np.uint64))
    sets = [np.unique(part) for row in x for part in (row[:n], row[-n:])]
    found = nj.bands(sets).reshape(pairs, 2, -1)
    missed = (found[:, 0] != found[:, 1]).all(axis=1).mean()
    jaccard = both / (2 * n - both)
    expected = (1 - jaccard**nj.ROWS) ** nj.BANDS
    assert abs(missed - expected) < 4 * (expected * (1 - expected) / pairs) ** 0.5 + 1e-3, (missed, expected)


@pytest.mark.parametrize("split", [0, 70])
def test_trees_find_all_components(split):
    rng = random.Random(split)
    bases = [[rng.getrandbits(60) for _ in range(rng.randrange(1, 80))] for _ in range(12)]
    sets = [np.unique(np.array(near(rng, rng.choice(bases), rng.randrange(12)) or [5], np.uint64)) for _ in range(150)]
    up = list(range(150))
    for i in range(150):
        for j in range(i + 1, 150):
            k = len(np.intersect1d(sets[i], sets[j]))
            if (not split or i < split <= j) and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                up = [up[i] if x == up[j] else x for x in up]
    roots = nj.joined(sets, split, 80).roots().tolist()
    assert len(set(zip(roots, up))) == len(set(roots)) == len(set(up)) < 140


def test_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k], f"x{k % 40}", *base[k:]]) for k in range(60)] + [" ".join(rng.choices("abcdef", k=30)) for _ in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    least = {}
    for i, x in enumerate(up):
        least.setdefault(x, i)
    got = {r["doc"]: r["component"] for r in nj.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: least[x] for i, x in enumerate(up)} and len(set(got.values())) < 70
