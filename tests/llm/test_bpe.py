import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumigrid.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_on_random_texts(library):
    ranks, rng = bpe.ranks(PATH, P.PATTERN), random.Random(5)
    letters = " \n\t \x1c\x85abAZ09'.,é日ß𝔘​½²ªа　"
    for n in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))
        assert list(ranks.encode(text)) == library.encode_ordinary(text), text


def test_equals_the_library_on_long_runs(library):
    ranks = bpe.ranks(PATH, P.PATTERN)
    for text in ("a" * 5000, "ab" * 4000 + " " * 300, "\n" * 700 + "x", "1" * 900, "don't " * 500, "zq" * 999 + " end"):
        assert list(ranks.encode(text)) == library.encode_ordinary(text)


def test_nulls_empty_ties_and_extra_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world é", "z"), (3, "Hello  world é", "z"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decoded(bpe.encoded(df, PATH, P.PATTERN), PATH, P.PATTERN).orderBy("doc_id", "text").collect()
    assert len(out) == 5
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decoded(bpe.encoded(df, PATH, P.PATTERN), PATH, P.PATTERN).collect() == []


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decoded(df, PATH, P.PATTERN).collect()] == [None, bytearray()]


def test_checked_is_encoding_and_decoding_in_one_worker(spark):
    """The same ids and digests as by two steps, with one Python step in the plan."""
    texts = [None, "", " ", "Ünïcode \U0001f600  and\n\n blanks", *[f"word {k} " * (k % 7) for k in range(200)], "long " * 30_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    path, pattern = PATH, P.PATTERN
    got = bpe.checked(df, path, pattern)
    two = bpe.decoded(bpe.encoded(df, path, pattern), path, pattern)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, two.select("id", "ids", F.sha2("decoded", 256)).collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
