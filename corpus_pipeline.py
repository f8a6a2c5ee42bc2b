"""A corpus pipeline of five stages, each one of the text operators.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps;
all but the last have the columns of ``documents``.  Each result is written as
Parquet to the shared folder and read again as the next stage's input.

Defined results: a null or empty text has no language and is rejected by the first stage
(later ones, given such rows, keep them: no lines to delete, no near copies, no tokens); a text
all of whose lines go is dropped; of rows with equal or null ids each is a document of
its own, and copies among them count; ties among copies go to the least id, then the
least hash of the text; an empty table passes all stages; texts are never cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm import bpe, langid, lines, mixing, ngram_join
from lumigrid.llm.common import table, written

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language."""
    model = langid.fitted(docs, PIECES, order=F.col("doc_id"))
    found = langid.identified(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines, and documents that nothing is left of."""
    found = lines.deduplicated(docs)
    left = found.where((F.size("deleted") == 0) | (F.length("text") > 0))
    n_chars = F.when(F.size("deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8): that of the least id,
    then of the least hash of its text; null ids come last."""
    place = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    numbered = written(docs.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_row", F.monotonically_increasing_id()))
    found = ngram_join.linked(numbered, n=5, percent=80, key="_row")
    kept = written(found.where(F.col("doc") == F.col("component")).select(F.col("doc").alias("_row")))
    return numbered.join(kept.hint("merge"), "_row", "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that all sources have equal weight, in one global shuffle."""
    return mixing.mixed(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    found = bpe.checked(docs.select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "text_sha256")


STAGES = [
    ("language_id", language),
    ("line_dedup", without_repeats),
    ("ngram_join", without_near_copies),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]
#: Language ID, and what follows from it, is not expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
