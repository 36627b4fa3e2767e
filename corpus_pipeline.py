"""A training-data pipeline over `documents`: five stages, each written and reread before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, linedup, minhash, mixing, quality
from lodestar.llm.common import Scratch
from lodestar.llm.queries import WORD_BPE, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents of its input.

    Null and empty texts are scored as such; repeated rows share a fate; without labels every document stays, as each score
    is then 0.5; an empty table gives an empty one; columns other than those of documents are left out.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs.select(*COLUMNS), model, held_out=F.lit(False)).where("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so do documents of which only white space is left.

    Null, empty and blank texts stay; rows that repeat a doc_id and a text are one document and stay as they are.
    """
    out = linedup.dedup(docs.select(*COLUMNS))
    return _columns(out.where(~((F.col("n_deleted") > 0) & (F.trim(F.regexp_replace("text", "[\\t-\\r]", " ")) == ""))))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more.

    Of rows that repeat an id and a text one stays; rows without words all stay; a null id is an id like others.
    """
    return minhash.one_of_each(docs.select(*COLUMNS), k=5, share=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is one source; documents of a source without words go."""
    return mixing.repeat(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, one row for each row; a null text counts as empty."""
    return bpe.digests(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify_quality),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier and the cube draw cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each one's table goes when the next one's is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop_but(docs)
    return docs
