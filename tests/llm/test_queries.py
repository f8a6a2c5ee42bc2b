"""The queries of the text operators over the smallest tables, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest

from lumigrid.llm import registry

SF = "/root/testdata/sf0.001"
Q = registry.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = Q[name](spark, SF).toPandas()
    expected = c.execute(registry.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda df: sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in row) for row in df[list(got.columns)].astype(object).to_numpy())
    assert plain(got) == plain(expected)


def test_join(spark, texts):
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q["op1_ngram_join"](spark, SF).collect()}
    assert got == {k: (len(s), root(k)) for k, s in sets.items()}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    n = lambda m: len(re.sub("[^0-9]", "", m))
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n(m) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, f in rules for m in re.finditer(p, t) if f(m.group())]


def test_personal_data(spark, texts):
    for r in Q["op3_pii"](spark, SF).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r["base_sha256"]
        assert set(spans) <= set(r["spans"].split(",") if r["spans"] else [])


def test_scores(spark, texts):
    tokens = {k: [*t.encode().lower().split(), b"\n"] for k, t in texts.items()}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = Q["op4_lm_score"](spark, SF).collect()
    bits = -sum(r["score"] for r in rows) / math.log10(2)
    assert bits < 3 * sum(len(t.encode()) for t in texts.values())
    for r in rows:
        w = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] < 0


def test_bpe(spark, texts):
    import base64

    import tiktoken

    with open(registry.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in Q["op5_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_lines(spark, texts):
    """All windows of 50 words or 4 lines that an earlier text has are deleted, and nothing that isn't repeated."""
    seen, everywhere = {}, {}
    got = {r["doc_id"]: {int(x) for x in r["deleted_lines"].split(",") if x} for r in Q["op7_line_dedup"](spark, SF).collect()}
    for k in sorted(texts):
        lines = [x.strip(" ") for x in texts[k].split("\n")]
        words = [x.count(" ") + 1 if x else 0 for x in lines]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(words[i:j]) >= 50 or sum(w > 0 for w in words[i:j]) >= 4:
                    run = tuple(lines[i:j])
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.setdefault(run, k)
                    break
        assert gone <= got[k]
        assert all(lines[i] in everywhere or lines.index(lines[i]) < i for i in got[k])
        everywhere.update(dict.fromkeys(lines))


def test_fingerprints(spark, texts):
    from lumigrid.llm.fingerprint import edited, fingerprints, likeness

    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    rows = {r["doc_id"]: r for r in Q["op8_fingerprint"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        changed = edited(texts[k], texts[after[k]])
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and r["n_chars"] == len(texts[k])
        a, b, c = fingerprints([texts[k], changed, texts[after[k]]])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.hex(), b.hex())
        assert (r["near_edited"], r["near_next"]) == (likeness(a, b), likeness(a, c))
    long = [r for r in rows.values() if r["n_chars"] > 1000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.2 > 0.05 > sorted(r["near_next"] for r in long)[len(long) // 2]


def test_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in Q["op10_language_id"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) > 0.97 * len(rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
