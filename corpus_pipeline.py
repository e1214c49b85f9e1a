"""The corpus pipeline: documents of low quality or no known language go, near copies and repeated passages go, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import jaccard, langid, packing, quality, suffix_dedup
from gleanspark.llm.common import checkpointed, shipped
from gleanspark.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, predicts to be of quality.

    A null text is judged as an empty one; repeated rows are judged alike and all stay or go.
    """
    return quality.good(docs, shipped(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with some certainty; null and empty texts go, repeated rows are told alike."""
    shipped(spark)
    return langid.known(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document of the smallest id; documents without an id stay.

    Equal rows of id and text stay once. Rows that share an id but not a text are one document: all its texts stay.
    """
    shipped(spark)
    first = jaccard.cluster(docs).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur again; characters that a cut splits go."""
    shipped(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.dedup(docs, keep=rest, as_text=True)
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document piece in sequences of 4096 tokens; a null text is an empty one, repeated rows are packed each."""
    shipped(spark)
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", no_near_copies),
    ("suffix-array dedup", no_repeated_passages),
    ("best-fit packing", pack),
]
#: No stage can be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))  # else every scan of a stage would compute the stages before it again
    return STAGES[-1][1](spark, docs, sf_dir)
