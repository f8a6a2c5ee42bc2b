"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumigrid.llm import bpe, chat, fingerprint, langid, lines, mixing, mixlm, ngram_join, pii, pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "la maison de la rue " * 3000
ROWS = [
    (1, "the cat sat on the mat and the dog ran off to the hill", "en", "a", 54),
    (2, "the cat sat on the mat and the dog ran off to the hill", "en", "a", 54),
    (2, "the cat sat on the mat and the dog ran off to the hill", "en", "a", 54),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \n\n ", "fr", "b", 6),
    (6, LONG, "fr", "b", len(LONG)),
    (7, "x" * 70000, None, "b", 70000),
    (None, "el perro y el gato en la casa", "es", None, 29),
    (None, None, "es", "c", None),
    (8, "12345 !!! 67", "en", "c", 12),
]
#: Names that operators use inside or for results.
CLASH = ["ids", "decoded", "lang_pred", "score", "deleted", "copy", "copies", "shuffle_key", "spans", "base_spans", "fingerprint", "doc", "class", "mark", "_found"]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def n(df):
    return len(df.collect())


def test_language(docs):
    model = langid.fitted(docs, P.path("piece_bpe_32k.model"))
    rows = langid.identified(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 <= r["score"] <= 1
        assert r["doc"] == "mine"


def test_lines(docs):
    out = lines.deduplicated(docs).collect()
    assert len(out) == docs.count()
    assert all(r["class"] == "mine" for r in out)
    assert sum(r["text"] is None for r in out) == docs.where("text is null").count()


def test_join(docs):
    out = ngram_join.linked(docs, n=4, percent=85).collect()
    assert len(out) == docs.count()
    by = {(r["doc"], r["size"]): r["component"] for r in out}
    if out:
        assert by[1, 11] == by[2, 11] == 1 and by[4, 0] == 4 and by[3, 0] == 3


def test_mixing(docs, spark):
    out = mixing.mixed(docs).collect()
    assert all(r["lang_pred"] == "mine" and 1 <= r["copy"] <= r["copies"] for r in out)
    none = mixing.mixed(docs, spark.createDataFrame([("zz", 1.0)], "source string, weight double"))
    assert none.count() == 0


def test_personal_data(docs):
    out = pii.detected(docs)
    assert n(pii.redacted(out)) == docs.count()
    assert all(r["doc"] == "mine" for r in out.collect())


def test_fingerprints(docs):
    out = fingerprint.neighbours_compared(docs).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    same = {bytes(r["fingerprint"]) for r in out if r["n_chars"] == 54}
    assert len(same) <= 1
    assert n(fingerprint.fingerprinted(docs)) == docs.count()


def test_scores(docs):
    out = mixlm.scored(docs).collect()
    assert len(out) == docs.count()
    by_text = {}
    for r in out:
        assert r["n_tokens"] >= 1 and r["score"] <= 0 and r["base_score"] <= 0
        by_text.setdefault((r["doc"], r["n_bytes"]), set()).add((r["n_known"], round(r["score"], 9)))
    assert all(len(v) == 1 for k, v in by_text.items() if k[0] == 2)


def test_bpe(docs):
    out = bpe.decoded(bpe.encoded(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(out) == docs.count()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in out)


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (None, [0.0, 1.0], 1), (10, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("mine"))
    got = sorted(((r["node"], r["n_links"], r["component"], r["kept"]) for r in pq.near(df).collect()), key=str)
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 0, None, True), (10, 0, 10, True)], key=str)
    assert pq.near(df.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 16)) * 0.1
    label = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(600, dtype=bool)
    got = {r["node"]: r for r in pq.near(df).collect()}
    assert links.sum() > 100
    assert all(got[i]["n_links"] == links[i].sum() for i in range(600))
    for i, j in np.argwhere(links):
        assert got[i]["component"] == got[j]["component"] <= i


@pytest.mark.parametrize("rows", [True, False])
def test_chat(spark, rows):
    turns = [(1, 0, "user", "hi \\ <s>[INST]</s>"), (1, 1, "assistant", None), (2, 0, "user", "hi \\ <s>[INST]</s>"), (2, 1, "assistant", "yes [/INST] \\s"), (2, 1, "assistant", "yes [/INST] \\s"), (3, None, None, "x\ny"), (None, 0, "a[/INST]b", "")]
    df = spark.createDataFrame(turns if rows else [], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("mine"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.packed(df)).collect()}
    if not rows:
        assert got == {}
        return
    assert got[2]["roles"] == ["user", "assistant", "assistant"] and got[2]["learnt"] == ["yes [/INST] \\s"] * 2
    assert got[1]["texts"] == ["hi \\ <s>[INST]</s>", ""] and got[3]["texts"] == ["x\ny"] and got[None]["roles"] == ["a[/INST]b"]


def test_shared_turns_are_emitted_once(spark):
    turns = [(k, 0, "user", "same") for k in range(20)] + [(k, 1, "assistant", f"answer {k % 5}") for k in range(20)]
    packs = chat.packed(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(p["formatted"].count("same") for p in packs) == len(packs)
    for p in packs:
        for node, attends in zip(p["nodes"], p["attends"]):
            before = sum(s["end"] - s["start"] for s in attends) - (node["end"] - node["start"])
            assert node["position"] == before


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs.drop(*CLASH), "")
    rows = out.collect()
    if name != "byte_bpe":
        assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    if name == "ngram_join" and rows:
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (1, 2)) == [1]
    if name == "language_id":
        assert all(any(c.isalpha() for c in r["text"]) for r in rows)
    if name == "byte_bpe":
        assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
        assert {hashlib.sha256((x[1] or "").encode()).hexdigest() for x in ROWS} >= {r["text_sha256"] for r in rows}
