"""Queries of the text operators over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm import bpe, chat, divergence, fingerprint, langid, lines, mixing, mixlm, ngram_join, pii, pq, search, warc
from lumigrid.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_join.linked(docs, n=4, percent=85)
    return found.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

OP2_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scaled AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM sound),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM scaled a JOIN scaled b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / a.size / b.size >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, n.component_id, n.component_id = e.vec_id AS kept
FROM embeddings e JOIN named n ON n.a = e.vec_id
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq.near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("node").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detected(docs)
    counts = [F.size(F.filter("base_spans", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.scored(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decoded(ids, RANKS, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest_of_ids().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: A conversation whose texts look like the template's own markup.
TRICKY = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
    both = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    loss = F.array_join("learnt", "")
    return chat.read_back(chat.packed(turns)).select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(both, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, length(replace(replace(replace(replace(replace(t, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) AS n
  FROM (SELECT *, role || chr(10) || text AS t, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM turns))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n - 1 + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id, lone
""".replace("\\\\", "\\")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs).select(
        "doc_id",
        F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted_lines"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.neighbours_compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: fingerprint.shown(c) for c in ("fingerprint", "edited_fingerprint")})


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "source", "copy", "copies", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP9_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT CAST(count(*) AS DOUBLE) FROM counts) * (SELECT sum(n) FROM counts) / n AS mean FROM counts),
steps AS (
  SELECT source, mean, CAST(0 AS BIGINT) AS k, exp(-mean) AS p, exp(-mean) AS total FROM rates
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM steps WHERE k < 63),
drawn AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.total <= d.u) AS copies
  FROM (SELECT *, CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM documents) d)
SELECT doc_id, source, copy, copies, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key,
  sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder("doc_id", 3) == 1
    model = langid.fitted(docs.where(~held_out), PIECES, order=F.col("doc_id"))
    return langid.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html")).records(payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits are four of base 32.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hash, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hash FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_TERM = r"[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_CAPITALS}) AS text FROM documents),
o AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v)::HUGEINT AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search.searched(docs, items)


_WORD = r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"
OP13_SQL = f"""
WITH o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_CAPITALS}), '{_WORD}')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY 1),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, a GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_CAPITALS}), '{_WORD}')) AS term FROM benchmark),
s AS (
  SELECT item_id, t.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM q JOIN t ON t.term = q.term JOIN w ON w.term = q.term JOIN d ON d.doc_id = t.doc_id, a GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_embedding_dedup, op3_pii, op4_lm_score, op5_byte_bpe, op6_chat_format, op7_line_dedup, op8_fingerprint, op9_mixing, op10_language_id, op11_warc, op12_divergence, op13_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op6_chat_format": OP6_SQL, "op9_mixing": OP9_SQL, "op11_warc": OP11_SQL, "op12_divergence": OP12_SQL, "op13_search": OP13_SQL}
