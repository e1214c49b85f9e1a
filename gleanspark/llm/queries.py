"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import bpe, embed_dedup, fingerprint, html_text, jaccard, langid, packing, quality, secret_scan, suffix_dedup, toxicity, trie, whitening
from gleanspark.llm.common import shipped

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text they decode to."""
    ids = bpe.encode(_table(spark, sf_dir, "documents"), TOKENIZER)
    texts = bpe.decode(ids, TOKENIZER)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document piece in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), TOKENIZER))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start more than once."""
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"), as_text=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"))


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return jaccard.cluster(_table(spark, sf_dir, "documents"))


@query
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return embed_dedup.cluster(_table(spark, sf_dir, "embeddings"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edited text."""
    found = fingerprint.fingerprints(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return langid.identify(_table(spark, sf_dir, "documents"))


@query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, by patterns and by a conditional random field."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.sha2(secret_scan.written(F.col("base")), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components, whitened; null for a deviation that no long can hold."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every beginning that conversations share, once each takes the first turns of the first of its hundred."""
    found = trie.prefix_trie(trie.rebuilt(trie.conversations(_table(spark, sf_dir, "conversations"))))
    return found.withColumn("ends_sha256", trie.hex_digest(F.col("ends"))).drop("ends")


# CRC-32 bit by bit: eight steps for each byte of the number's decimal text.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT FOR i IN range(8)]),
        lambda c, zero: xor(c >> 1, 3988292384::BIGINT * (c & 1)))))"""
ORACLES["op13_prefix_trie"] = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM said
), ids AS (
  SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM said)
), rebuilt AS (
  SELECT i.conv_id, t.n, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.n <= i.h
  UNION ALL
  SELECT i.conv_id, t.n, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.n > i.h
), whole AS (
  SELECT i.conv_id, coalesce(list(struct_pack(r := r.role, t := r.text) ORDER BY r.n) FILTER (r.n IS NOT NULL), []) AS path
  FROM ids i LEFT JOIN rebuilt r USING (conv_id) GROUP BY i.conv_id
), begins AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM whole
), nodes AS (
  SELECT path[:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(path)) AS ends
  FROM begins GROUP BY ALL
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.node[:n.depth] = n.node) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
  CAST(sum(CASE WHEN b.depth = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.node[b.depth].t) END) AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256
FROM linked n JOIN linked b ON b.depth >= n.depth AND b.node[:n.depth] = n.node
GROUP BY n.node, n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, n.ends
"""
