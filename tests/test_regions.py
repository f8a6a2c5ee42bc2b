"""Merging of regions against plain versions that look at pixels."""

import numpy as np
import pandas as pd
import pytest

from lumigrid.functions.distributions import Watson, watson_statistic
from lumigrid.model import COLOUR, NORMAL, PIXELS, POSITION, MergeConfig
from lumigrid.operators import regions
from lumigrid.operators.tiles import Tile
from test_algorithms import noisy


def small(seed, h=6, w=6, k=5):
    """A 6 by 6 image: a few regions, normals and depths near one of two planes."""
    r = np.random.default_rng(seed)
    df = noisy(h, w, seed)
    blocks = r.integers(0, k, (3, 3))
    df["label"] = 1 + blocks[(df["row"] - 1) * 3 // h, (df["col"] - 1) * 3 // w]
    plane = r.random(20)[df["label"].to_numpy()] < 0.6
    df["z"] = np.where(plane, 2.0, 3 + df["x"])
    n = np.where(plane[:, None], [0, 0, 1.0], [1.0, 0, 0]) + r.normal(size=(len(df), 3)) * 0.05
    df[list(NORMAL)] = n / np.linalg.norm(n, axis=1, keepdims=True)
    df[["c1", "c2", "c3"]] = r.random((20, 3))[df["label"]] * 0.1 + 0.4
    return df.sort_values("pid").reset_index(drop=True)


def dilated(mask, erode=False):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for i in range(h):
        for j in range(w):
            near = mask[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
            out[i, j] = near.all() if erode else near.any()
    return out


def boundary(labels, k):
    return dilated(labels == k) & ~dilated(labels == k, True)


def gradients(image):
    """Sobel magnitudes with repeated borders, the greatest by the image's greatest."""
    h, w = image["row"].max(), image["col"].max()
    out = np.zeros((h, w))
    for c in ("c1", "c2", "c3", "z"):
        g = np.zeros((h, w))
        g[image["row"] - 1, image["col"] - 1] = image[c]
        at = lambda i, j: g[min(max(i, 0), h - 1), min(max(j, 0), w - 1)]  # noqa: B023, E731
        for i in range(h):
            for j in range(w):
                x = sum((2 - abs(a)) * b * at(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
                y = sum((2 - abs(b)) * a * at(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
                out[i, j] = max(out[i, j], np.hypot(x, y))
    return out / out.max() if out.max() > 0 else out


def touching(labels, a, b):
    return (dilated(labels == a) & (labels == b)).any()


def plain_merge(image, config):
    """The same by masks: boundaries are united masks, areas and means are taken anew."""
    h, w = image["row"].max(), image["col"].max()
    labels = np.zeros((h, w), int)
    labels[image["row"] - 1, image["col"] - 1] = image["label"]
    mog, stat = gradients(image), watson_statistic(image[list(NORMAL)].to_numpy())
    at = lambda k: (labels[image["row"] - 1, image["col"] - 1] == k)
    colour = {k: image.loc[at(k), list(COLOUR)].to_numpy().mean(axis=0) for k in np.unique(labels)}
    rims = {k: boundary(labels, k) for k in np.unique(labels)}

    def join(a, b):
        nonlocal labels
        new = max(colour) + 1
        colour[new], rims[new] = (colour.pop(a) + colour.pop(b)) / 2, rims.pop(a) | rims.pop(b)
        labels = np.where(np.isin(labels, (a, b)), new, labels)

    again = True
    while again:
        again = False
        for n, k in sorted(((labels == k).sum(), k) for k in colour):
            if k in colour and n < config.small_area:
                near = [m for m in colour if m != k and touching(labels, k, m)]
                if near:
                    join(k, min(near, key=lambda m: (np.linalg.norm(colour[m] - colour[k]), m)))
                    again = True
    merged = 0
    again = True
    while again:
        again = False
        for a in sorted(colour):
            wa = Watson(stat[at(a)].mean(axis=0))
            if wa.kappa <= config.kappa:
                continue
            pairs = []
            for b in colour:
                if b != a and touching(labels, a, b):
                    wb = Watson(stat[at(b)].mean(axis=0))
                    pairs.append((min(wa.divergence(wb), wb.divergence(wa)), b, wb.kappa))
            for wd, b, kappa in sorted(pairs):
                rim = mog[rims[a] & rims[b]]
                points = image.loc[at(a) | at(b), list(POSITION)].to_numpy()
                if kappa > config.kappa and wd < config.thd and (rim.mean() if len(rim) else 1.0) < config.thb and regions.plane_share(points, config.distance, config.seed) > config.inliers:
                    join(a, b)
                    merged += 1
                    again = True
                    break
            if again:
                break
    return labels[image["row"] - 1, image["col"] - 1], merged


def same_parts(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_merging_equals_masks():
    merges = 0
    for seed in range(40):
        image, config = small(seed), MergeConfig(thb=0.6, small_area=3, distance=0.05, inliers=0.8)
        expected, n = plain_merge(image, config)
        assert same_parts(regions.planar_labels(image, config), expected), seed
        merges += n
    assert merges > 20


@pytest.mark.parametrize("seed", range(10))
def test_small_regions_by_passes(seed):
    image = small(seed, 9, 9, 12)
    config = MergeConfig(small_area=12, kappa=1e9)
    expected, _ = plain_merge(image, config)
    g = regions.graph_of(image)
    regions.without_small(g, 12)
    assert same_parts(regions.labels_of(g, len(image)), expected)


@pytest.mark.parametrize("seed", range(10))
def test_rims_after_contractions(seed):
    """Sums and counts on edges equal those of united masks, whatever was merged."""
    r = np.random.default_rng(seed)
    image = small(seed, 8, 9, 7)
    t = Tile.whole(image, ["label", "c1"], 1)
    rims = regions.rims_of(t, t.near(t.grid("c1")))
    labels, value = np.zeros((8, 9), int), np.zeros((8, 9))
    labels[image["row"] - 1, image["col"] - 1], value[image["row"] - 1, image["col"] - 1] = image["label"], image["c1"]
    masks = {int(k): boundary(labels, k) for k in np.unique(labels)}
    while len(masks) > 1:
        for a in masks:
            for b in masks:
                if a < b:
                    both = value[masks[a] & masks[b]]
                    total, n = rims.edges[a].get(b, (0.0, 0))
                    assert n == len(both) and total == pytest.approx(both.sum())
                    assert rims.mean(a, b) == pytest.approx(both.mean() if len(both) else 1.0)
        a, b = (int(x) for x in r.choice(sorted(masks), 2, replace=False))
        new = max(masks) + 1
        masks[new] = masks.pop(a) | masks.pop(b)
        rims.contract(a, b, new)


@pytest.mark.parametrize("seed", range(10))
def test_pruning_equals_pixels(seed):
    """Pruning on the table of regions equals relabelling pixels pass by pass."""
    r = np.random.default_rng(seed)
    labels = r.integers(0, 6, (7, 7)).ravel()
    at = np.arange(49).reshape(7, 7)
    pairs = np.concatenate([np.stack([at[:-1].ravel(), at[1:].ravel()]), np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()])], axis=1)
    got, now = regions.pruned(labels, pairs, 9), labels.copy()
    while True:
        size = {k: int((now == k).sum()) for k in np.unique(now).tolist()}
        near = {k: {int(b) for i, j in pairs.T for a, b in ((now[i], now[j]), (now[j], now[i])) if a == k != b} for k in size}
        small_ = sorted((n, k) for k, n in size.items() if n < 9 and near[k])
        if not small_:
            break
        into = {}
        for _, k in small_:
            if k not in into.values():
                best = max(near[k], key=lambda m: (size[m], -m))
                if best not in into:
                    into[k] = best
        for k, m in into.items():
            now[now == k] = m
    assert same_parts(got, now) and set(got.tolist()) <= set(labels.tolist())


def test_merging_as_a_plan(spark):
    images = pd.concat([small(s).assign(image_id=s) for s in range(6)])
    config = MergeConfig(thb=0.6, small_area=3, distance=0.05, inliers=0.8)
    got = regions.merge_planar(spark.createDataFrame(images, PIXELS), config).toPandas()
    for s, image in images.groupby("image_id"):
        assert same_parts(got[got["image_id"] == s].sort_values("pid")["label"].to_numpy(), plain_merge(image.sort_values("pid").reset_index(drop=True), config)[0])
