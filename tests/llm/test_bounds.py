"""Null keys, rare sources, long words and many equal rows: whole results in bounded memory."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from lumigrid.llm import chat, langid, lines, mixing, ngram_join, pq

ROOT = str(Path(__file__).parents[2])


def near_copies():
    words = [f"w{i}" for i in range(101)]
    return [" ".join(words[:100]), " ".join(words), " ".join(words[:100] + ["other"])]


@pytest.mark.parametrize("ids", [(None, None, 5), (None, 7, None), (None, None, None), (3, 4, 5)])
def test_near_copies_without_keys_link(spark, ids):
    rows = [*zip(ids, near_copies()), (None, "something else that is alone here"), (9, "and this one has a key of its own"), (None, None)]
    found = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()
    least = min((i for i in ids if i is not None), default=None)
    assert Counter((r["doc"], r["component"]) for r in found if r["size"] >= 97) == Counter((i, least) for i in ids)
    assert Counter((r["doc"], r["component"]) for r in found if r["size"] < 97) == Counter({(None, None): 2, (9, 9): 1})


def test_probes_fit_a_gigabyte():
    """500 lists of 768 dimensions: a slice of 512 rows."""
    code = (
        "import resource, numpy as np; from lumigrid.llm import pq; r = np.random.default_rng(1); x = pq._unit(r.normal(size=(2000, 768)));"
        "q = pq.Quantiser.__new__(pq.Quantiser); q.centres = x[:500]; b = resource.getrusage(0).ru_maxrss; own, mask = q.probes(x[:512], .2);"
        "assert mask[np.arange(512), own].all(); print(resource.getrusage(0).ru_maxrss - b)"
    )
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout)
    assert used < 100_000


def test_probes_are_those_of_the_distances():
    r = np.random.default_rng(3)
    x = pq._unit(r.normal(size=(300, 12)))
    x[150:] = pq._unit(x[:150] + r.normal(size=(150, 12)) * 0.05)
    q = pq.Quantiser(x, 20)
    own, mask = q.probes(x, 0.2)
    for i, j in np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2):
        assert mask[i, own[j]]


def test_read_back_gives_bounded_batches(spark):
    text = "x" * 100_000
    turns = spark.range(300).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(text).alias("text"))
    packs = chat.packed(turns.coalesce(1))
    sizes = chat.read_back(packs).mapInArrow(lambda bs: (b.select(["conv_id"]).append_column("n", __import__("pyarrow").array([b.nbytes] * len(b))) for b in bs), "conv_id long, n long").collect()
    assert len(sizes) == 300 and all(len(r["texts"][0]) == 100_000 for r in chat.read_back(packs.limit(1)).limit(2).collect())


def test_reading_back_cuts_a_pack():
    import pyarrow as pa

    pack = chat._Pack()
    for k in range(2000):
        pack.add(k, [("assistant", "y" * 10_000)])
    seen = []

    class Packs:
        def mapInArrow(self, f, schema):
            batch = chat._batch([pack.row()], chat._arrow(chat.PACKS))
            seen.extend(b for b in f(iter([batch])))

    real, chat._arrow = chat._arrow, lambda s: real(s)
    try:
        chat.read_back(Packs())
    finally:
        chat._arrow = real
    assert sum(len(b) for b in seen) == 2000 and max(b.nbytes for b in seen) < 3 * chat.READ_CHARS
    assert isinstance(seen[0], pa.RecordBatch)


def test_a_rare_source_is_dealt_in_blocks(spark, monkeypatch):
    rows = [(i, "t", "common") for i in range(4000)] + [(9999, "t", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(map(tuple, mixing.mixed(docs).select("doc_id", "copy", "copies", "shuffle_key").collect()))
    monkeypatch.setattr(mixing, "COPIES", 100)
    cut = sorted(map(tuple, mixing.mixed(docs).select("doc_id", "copy", "copies", "shuffle_key").collect()))
    assert cut == whole
    rare = [r for r in whole if r[0] == 9999]
    assert [r[1] for r in rare] == list(range(1, rare[0][2] + 1)) and 1750 < len(rare) < 2250


def test_large_means_are_poisson(spark):
    """Sums of parts have the mean and the variance of one draw."""
    rows = [(i, "s") for i in range(3000)] + [(10_000 + i, "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit("x"))
    n = np.array([r["c"] for r in mixing.mixed(docs).where("source = 't'").groupBy("doc_id").agg(F.max("copies").alias("c")).collect()])
    assert len(n) == 60 and abs(n.mean() - 25.5) < 3 and 12 < n.var() < 45


def test_long_words_are_fitted():
    pieces = langid.pieces(P.path("piece_bpe_32k.model"))
    p = np.random.default_rng(2).random((len(pieces.texts) + 1, 2)) * 1e-3
    word = "internationalisationen"
    counts = np.array([[2.0, 3.0]])
    np.testing.assert_allclose(pieces.expected_of_long(word, counts[0], p), pieces.expected([word], counts, p), rtol=1e-8, atol=1e-12)
    long = pieces.expected_of_long("donaudampfschiff" * 40, counts[0], p)
    assert np.isfinite(long).all() and long.sum() > 0


def test_line_prints_have_two_hashes():
    """Lines that one hash takes for equal are not."""
    words = np.full(8, 20)
    one, other = (np.arange(8, dtype=np.int64), np.arange(8, dtype=np.int64) + 100)
    *_, a, b = lines.windows([one, one], words)
    *_, c, d = lines.windows([one, other], words)
    assert (a == c).all() and (b != d).all()


def test_a_very_long_text_keeps_its_lines(spark):
    text = "\n".join(f"line {i} of many words that are not repeated anywhere else" for i in range(20_000))
    rows = [(1, text), (2, "\n".join(text.split("\n")[5000:5010]))]
    got = {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["deleted"] == [] and got[1]["text"] == text and len(got[2]["deleted"]) == 10


@pytest.mark.parametrize("seed", range(5))
def test_minima_of_stretches(seed):
    r = np.random.default_rng(seed)
    values = r.integers(0, 9, 50)
    start = r.integers(0, 50, 200)
    end = np.minimum(50, start + r.integers(1, 30, 200))
    at = lines.minima(values, start, end)
    assert all(values[k] == values[i:j].min() and (values[k + 1 : j] > values[k]).all() for k, i, j in zip(at, start, end))
