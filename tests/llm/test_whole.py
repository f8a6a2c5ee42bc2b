"""Places where an operator once did less than its whole job."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from lumigrid.llm import chat, lines, mixlm, pii

DOCS = "doc_id long, text string"


def repeated(texts):
    """Lines by text that lie in any long enough run of lines that stands earlier."""
    seen, out = set(), {}
    for k in sorted(texts):
        rows = texts[k].split("\n")
        words = [len(x.split()) for x in rows]
        gone = set()
        for i in range(len(rows)):
            for j in range(i + 1, len(rows) + 1):
                if sum(words[i:j]) >= 50 or sum(w > 0 for w in words[i:j]) >= 4:
                    if tuple(rows[i:j]) in seen:
                        gone |= set(range(i, j))
                    seen.add(tuple(rows[i:j]))
        out[k] = sorted(gone)
    return out


def deleted(spark, texts):
    found = lines.deduplicated(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    return {r["doc_id"]: r["deleted"] for r in found}


def test_runs_whose_pairs_first_stand_elsewhere(spark):
    rng = random.Random(5)
    rows = ["", "a", "b", "c", "d", "e", "w " * 29 + "w", "v " * 54 + "v"]
    texts = {k: "\n".join(rng.choices(rows, k=rng.randrange(2, 14))) for k in range(200)}
    long = "v " * 54 + "v"
    texts |= {300: f"{long}\nend", 301: f"{long}\np1\nq1", 302: f"new\n{long}\np1\nq1"}
    for k, pair in enumerate(f"p{i}\nq{i}" for i in range(10, 30)):
        texts |= {1000 + k: f"s{k}\nt{k}\n{pair}\nu{k}", 2000 + k: f"l{k}\n{pair}\nr{k}", 3000 + k: f"x{k}\nl{k}\n{pair}\nr{k}\ny{k}"}
    assert deleted(spark, texts) == repeated(texts)


def test_turns_are_shared_below_the_fourth(spark):
    """All conversations share four turns, branch at the fifth, share the sixth and part after it."""
    turns = [(k, t, "user", f"turn {t}" if t < 4 else f"turn {t} of {k % 2}" if t < 6 else f"own {k}") for k in range(200) for t in range(7)]
    packs = chat.packed(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(len(p["conversations"]) for p in packs) == 200
    for p in packs:
        assert [p["formatted"].count(f"turn {t}<") for t in range(4)] == [1] * 4
        assert all(p["formatted"].count(f"turn {t} of {v}<") <= 1 for t in (4, 5) for v in range(2))


def test_rows_without_conversation_stand_alone(spark):
    turns = [(None, t, "user", f"text {t}") for t in range(40)] + [(1, t, "assistant", f"text {t}") for t in range(3)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.packed(df)).collect()
    assert sorted(r["texts"] for r in got if r["conv_id"] is None) == sorted([f"text {t}"] for t in range(40))
    assert [r["learnt"] for r in got if r["conv_id"] == 1] == [[f"text {t}" for t in range(3)]]


def test_ten_shared_turns(spark):
    """Each beginning is written once per pack, and packs repeat one conversation's beginning at most."""
    turns = [(k, t, "user", f"turn {t}" if t < 10 else f"own {k // 3}") for k in range(90) for t in range(11)]
    packs = chat.packed(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert all(p["formatted"].count(f"turn {t}<") == 1 for p in packs for t in range(10))
    assert 30 <= sum(p["formatted"].count("own") for p in packs) < 30 + len(packs)


def test_white_space_of_all_kinds_parts_words(spark):
    tabs = "\t".join(f"word{i}" for i in range(51))
    short = [f"line {i}" for i in range(4)]
    texts = {1: f"a\n{tabs}", 2: f"b\n{tabs}", 3: "\n".join(short), 4: "\r\n".join(f"\t{x}" for x in short) + "\x0b"}
    assert deleted(spark, texts) == {1: [], 2: [1], 3: [], 4: [0, 1, 2, 3]}


def slices():
    """Counts of three slices of random words, a third of them seen once, some long, some not in training."""
    rng = random.Random(6)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 9))) for _ in range(300)} | {b"a" * 90 + bytes([x]) for x in b"xyz"} | {b"\n"})
    uses = np.array([rng.choice([0, 1, 1, 2, 70]) for _ in words], float)
    trees = [mixlm.tree(words[k : k + 120], uses[k : k + 120]) for k in range(0, len(words), 120)]
    table = Counter()
    for t in trees:
        for k, b, n in zip(*(c.tolist() for c in mixlm.met_contexts(t))):
            table[k, b] += n
    every = [np.array(x, np.int64) for x in zip(*((k, b, n) for (k, b), n in table.items()))]
    return words, uses, [mixlm.Counts(t, *every) for t in trees]


def test_contexts_count_all_words_without_sharing_places():
    words, uses, found = slices()
    ended = [w if w == b"\n" else w + b" " for w in words]
    after = Counter()
    for w, n in zip(ended, uses):
        for i, byte in enumerate(w):
            for k in range(5):
                after[k, w[max(0, i - k - 1) : i] if k < 4 else w[:i], min(i, k + 1) if k < 4 else i, byte] += n
    bits, checked = {}, 0
    for (k, c, at, byte), n in after.items():
        for j in range(8):
            bits[k, c, at, j, byte >> (8 - j), byte >> (7 - j) & 1] = bits.get((k, c, at, j, byte >> (8 - j), byte >> (7 - j) & 1), 0) + n
    for part, counts in enumerate(found):
        t = counts.tree
        _, zeros, ones = counts.bits(np.arange(len(t.byte)))
        place, last = 0, -1
        for p, (w, e) in enumerate(zip(t.word, t.edge)):
            place, last = (place + 1 if w == last else 0), w
            text = ended[part * 120 + w]
            byte = text[place]
            for k in range(5):
                c = text[max(0, place - k - 1) : place] if k < 4 else text[:place]
                at = min(place, k + 1) if k < 4 else place
                for j in range(8):
                    expected = [bits.get((k, c, at, j, byte >> (8 - j), x), 0) for x in (0, 1)]
                    assert [zeros[8 * e + j, k], ones[8 * e + j, k]] == expected
                    checked += 1
    assert checked > 50_000


def test_learning_meets_every_training_byte():
    words, uses, found = slices()
    total = sum(mixlm.learnt(c, mixlm._start()) for c in found)
    cells = mixlm.GATES // 8 * mixlm.BUCKETS
    expected = 8 * sum(n * (len(w) + (w != b"\n")) for w, n in zip(words, uses))
    assert np.isclose(total[-2 * cells : -cells].sum(), expected)
    assert np.isfinite(mixlm.merged(total, mixlm._start()).weights).all()


def test_slices_score_all_words(spark, monkeypatch):
    rng = random.Random(7)
    texts = [(k, " ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 12))) for _ in range(60))) for k in range(150)]
    docs = spark.createDataFrame(texts, DOCS)
    one = {r["doc"]: r for r in mixlm.scored(docs).collect()}
    monkeypatch.setattr(mixlm, "SLICE", 4000)
    monkeypatch.setattr(mixlm, "FREQUENT", 20)
    many = {r["doc"]: r for r in mixlm.scored(docs).collect()}
    for c in ("base_score", "score"):  # whatever the slices, the model is the same
        assert all(np.isclose(many[k][c], r[c], rtol=1e-6) for k, r in one.items())


def test_long_secrets_are_proposed_whole(spark):
    secrets = ["a1B2" * 60, "head/" + "x9" * 150 + "+tail-end", "k" * 20]
    df = spark.createDataFrame([(f"token = {x} ; end",) for x in secrets], "text string")
    found = df.select(pii.found(df["text"], pii.LOOSE["secret"], pii.LOOSE_NEEDS["secret"]).alias("f")).collect()
    assert [[h["t"] for h in r["f"]] for r in found] == [[x] for x in secrets]


def test_one_row_of_near_copies_is_kept(spark):
    def words(a, b):
        return " ".join(f"w{i}" for i in range(a, b))

    near = words(0, 99) + " other"
    rows = [(3, words(0, 100)), (3, words(0, 100)), (3, near), (None, near), (4, words(200, 300)), (None, words(200, 300))]
    rows += [(None, words(400, 500)), (None, words(400, 499) + " other"), (None, words(600, 700)), (None, words(600, 700)), (5, "a b"), (5, "c d"), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], DOCS + ", lang string, source string, n_chars long")
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if t else set() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (k, t) in zip(group, rows):
        least[g] = min(least.get(g, 1 << 40), 1 << 40 if k is None else k)
    got = [r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]
    assert sorted(1 << 40 if k is None else k for k in got) == sorted(least.values())
