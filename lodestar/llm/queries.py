"""One query for each training-data operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, linedup, media, minhash, mixing, quality, secrets, toxicity, warc
from .common import fold

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), k != 1)
    return toxicity.score(docs, model, held_out=k == 1, threshold=0.7)


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=85).select("doc_id", "n_shingles", "component_id", "kept")


def op5_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.made_findings(spark))
    return found.select("doc_id", "kind", secrets.redact(F.col("value")).alias("value_sha256"), "found_at", "times", "score", "secret")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


#: The replica that op9_warc audits has one letter changed in the records that this rule picks.
DAMAGED = "pmod(crc32(cast(cast(page_id as string) as binary)), 101) = 7"


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    recs = warc.records(pages, max(1, -(-pages.count() // warc.RECORDS_PER_FILE)))
    replica = recs.withColumn("body", F.when(F.expr(DAMAGED), F.concat(F.lit("w"), F.expr("substr(body, 2)"))).otherwise(F.col("body")))
    return warc.audit(recs, replica)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), k != 0)
    return quality.score(docs.select("doc_id", "text"), model, held_out=k == 0, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.decide(table(spark, sf_dir, "documents"))
    rows = units.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (op1_bpe, op2_toxicity, op3_embeddings, op4_minhash, op5_linedup, op6_secrets, op7_media, op8_quality, op9_warc, op10_mixing)
    }


def oracle_sql() -> dict[str, str]:
    return {}
