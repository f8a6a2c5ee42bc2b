"""The pipeline against a plain version of its stages."""

import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lumigrid.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    words = {"en": "the house of old river and stone walks under bright sky".split(), "fr": "la maison et le fleuve sous un ciel clair avec des pierres".split()}
    rows = []
    for k in range(120):
        lang = "en" if k % 3 else "fr"
        text = "\n".join(" ".join(rng.choices(words[lang], k=rng.randrange(6, 30))) for _ in range(rng.randrange(1, 7)))
        rows.append([k, text, lang, "web" if k % 5 else "books"])
    passage = "\n".join(" ".join(rng.choices(words["en"], k=15)) for _ in range(5))
    for k in (20, 44, 71):
        rows[k][1] += "\n" + passage
    for k in (80, 81):
        rows[k][1] = rows[10][1]
    rows[90][1] = rows[13][1] + " bright"
    rows += [[200, None, "en", "web"], [201, "", "fr", None], [202, "12345 !!", "en", "web"], [203, rows[5][1], None, None], [None, rows[6][1] + " sky", "en", "web"]]
    return [(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s in rows]


def plain(rows, model):
    table = langid.pieces(model.path)
    at = {t: i for i, t in enumerate(table.texts)}

    def log(word):
        sums = [np.ones(len(model.languages))]
        for t in range(1, len(word) + 1):
            sums.append(sum((sums[t - n] * model.p[at[word[t - n : t]]] for n in range(1, t + 1) if word[t - n : t] in at), sums[t - 1] * model.p[-1] if word[t - 1] not in at else 0))
        return np.log(sums[-1])

    known = []
    for r in rows:
        words = langid.words_of(r[1])
        total = sum(log(langid.MARK + w) for w in words) if words else None
        if words and 1 / np.exp(total - total.max()).sum() >= corpus_pipeline.LEAST_SCORE:
            known.append(list(r))
    seen = set()
    for r in sorted(known, key=lambda r: -1 if r[0] is None else r[0]):
        lines = r[1].split("\n")
        sizes, gone = [len(x.split()) for x in lines], set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(sizes[i:j]) >= 50 or sum(n > 0 for n in sizes[i:j]) >= 4:
                    if tuple(lines[i:j]) in seen:
                        gone |= set(range(i, j))
                    seen.add(tuple(lines[i:j]))
        if gone:
            r[1] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            r[4] = len(r[1])
        r.append(bool(gone))
    known = [r for r in known if r[1] or not r[5]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := r[1].lower().split()) else set() for r in known]
    group = list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = [min((r for r, g in zip(known, group) if g == one), key=lambda r: math.inf if r[0] is None else r[0]) for one in set(group)]
    sources = [r[3] for r in kept]
    out = []
    for r in kept:
        name = "" if r[0] is None else str(r[0])
        u = int(hashlib.md5(f"7:{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
        mean = len(kept) / len(set(sources)) / sources.count(r[3])
        p = total = math.exp(-mean)
        copies = 0
        while total <= u:
            copies += 1
            p *= mean / copies
            total += p
        out += [r] * copies
    with open(corpus_pipeline.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [(r[0], r[2], r[3], library.encode_ordinary(r[1]), hashlib.sha256(r[1].encode()).hexdigest()) for r in out]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in ("doc_id", "lang", "source", "ids", "text_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    model = langid.fitted(docs, corpus_pipeline.PIECES, order=docs["doc_id"])
    expected = plain(rows, model)
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) > 60
