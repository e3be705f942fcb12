"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import crc_mod, documents, kept
from fleetlens.llm.curriculum_mix import mix_documents
from fleetlens.llm.cutting_stock import pack
from fleetlens.llm.exact_dedup import keep_documents
from fleetlens.llm.jaccard_groups import surplus_rows, text_digest
from fleetlens.llm.langid_ecoc import identify
from fleetlens.llm.queries import RANKS, tokenizer_path

#: word shingles and similarity (percent) of near duplicates
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter are rejected."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    out = identify(docs, learn=crc_mod("doc_id", 5) != 0, carry=rest, known_only=True)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest id."""
    return keep_documents(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the smallest id (of rows that
    repeat it, the smallest text digest); rows go by id and text, so an id's other texts stay."""
    gone = surplus_rows(docs, words=WORDS, percent=PERCENT)
    return docs.join(gone, (F.col("doc_id") == gone["_id"]) & (text_digest(F.col("text")) == gone["_d"]),
                     "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in training order: every document once for each time the mix takes it."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack(docs, tokenizer_path(), tokenizer_path(RANKS))


STAGES = [("language", language), ("exact_duplicates", exact_duplicates),
          ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: no SQL: language ID and packing are not SQL-expressible; tests hold each stage against a brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
