"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Most labelled documents that a classifier is fitted on (in expectation; a hash of the id chooses them).
MOST_LABELLED = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most about `most` documents whose id `learn` accepts.

    Of several labels of one document the largest counts; null labels and ids count as none. The chosen labels are
    bounded by `most`, so they are broadcast and the texts are not shuffled.
    """
    tune(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    ).where(learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).join(F.broadcast(chosen), "doc_id")
