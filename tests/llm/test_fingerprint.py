"""Fingerprints against a plain parser, alone and beside other texts, whole and in windows."""

import random

import numpy as np

from lumigrid.llm import fingerprint as fp

M = (1 << 64) - 1


def mixed(x):
    x &= M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain(text):
    """The parser, one text and one symbol at a time."""
    symbols, slots = list(text.encode("utf-8", "surrogatepass")), []
    for level in range(1, 5):
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        label = [s for s, _ in runs]
        for _ in range(3 if level == 1 else 4):
            tossed = []
            for i, s in enumerate(label):
                diff = s ^ label[i - 1] if i else 1
                place = (diff & -diff).bit_length() - 1
                tossed.append(place * 2 + (s >> place & 1))
            label = tossed
        starts = [i for i in range(len(runs)) if i == 0 or 1 < i < len(runs) - 1 and label[i - 1] < label[i] > label[i + 1]]
        symbols = []
        for a, b in zip(starts, [*starts[1:], len(runs)]):
            total = 0
            for k, (s, n) in enumerate(runs[a:b]):
                wide = mixed(s + n * 0x9E3779B97F4A7C15) if n > 1 else s
                total += mixed(wide + (k + 1) * 0xD6E8FEB86659FD93)
            symbols.append(mixed(total))
        if n := fp.SLOTS.get(level):
            least = [min((x >> 8 for x in symbols if x % n == k), default=None) for k in range(n)]
            slots += [0 if x is None else mixed(x) % 65535 + 1 for x in least]
    return b"".join(x.to_bytes(2, "big") for x in slots)


def texts():
    rng = random.Random(3)
    out = ["", "a", "aa", "ab", "aab", "é", "a" * 5000, "ab" * 3000, "\udcff x"]
    for alphabet in ("ab", "abc ", "the quick brown fox", "xyz\n", "é è ü ñ"):
        out += ["".join(rng.choices(alphabet, k=rng.randrange(1, 900))) for _ in range(25)]
    return out + ["".join(c for c in rng.choices("abcdefgh", k=400))[::1] for _ in range(20)]


def test_equals_a_plain_parser():
    every = texts()
    assert fp.fingerprints(every) == [plain(t) for t in every]


def test_a_text_has_one_fingerprint_beside_any_others():
    single = ["".join(random.Random(k).sample("abcdefghijklmnopqrstuvwxyz", 26)) * 4 for k in range(50)]  # no doubled byte
    alone = [fp.fingerprints([t])[0] for t in single]
    assert fp.fingerprints([*single, "aa"])[:-1] == alone == fp.fingerprints(["bb", *single])[1:]


def test_long_texts_are_parsed_in_windows(monkeypatch):
    every = [t for t in texts() if t] + ["x" * 3000 + "abcab" * 400 + "y" * 2000]
    whole = fp.fingerprints(every)
    for size in (50, 333):
        monkeypatch.setattr(fp, "CHUNK", size)
        assert fp.fingerprints(every) == whole


def test_equal_texts_in_any_partition(spark):
    rng = random.Random(8)
    kinds = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz ", 27)) * 3 for _ in range(5)]
    rows = [(k if k % 7 else None, kinds[k % 5] if k % 3 else f"aa{k}bb" * 9) for k in range(90)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fp.neighbours_compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 90 and sorted(bytes(r["fingerprint"]) for r in got) == sorted(plain(t) for _, t in rows)
    order = sorted((r for r in rows if r[0] is not None), reverse=True)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (k, t), (_, f) in zip(order, order[1:]):
        changed = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        assert bytes(by[k]["edited_fingerprint"]) == plain(changed)
        x, y, z = (np.frombuffer(plain(v), ">u2") for v in (t, changed, f))
        for other, near in ((y, "near_edited"), (z, "near_next")):
            some = (x > 0) | (other > 0)
            assert by[k][near] == ((x == other) & some).sum() / some.sum()
