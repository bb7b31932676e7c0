"""The corpus pipeline: toxicity, near duplicates, personal data, source mix, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame and is written as Parquet before the next reads it. All but the last
return the columns that they got, whatever other columns those are and however they are named.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import bpe, mixing, pii, simhash, toxicity
from lexspan.llm.common import documents, shared_dir, table
from lexspan.plans.staging import released, removed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among docs.

    Without any usable label nothing is rejected. Null and empty texts get the bias alone, repeated rows the same score.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest doc_id, null ids last; of rows that tie the
    first as read. Null, empty and wordless texts are one group. Candidates come from SimHash rings by pigeonring chains,
    their links are exact similarities."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars is that of the new text. Null texts stay null."""
    return pii.scanned(docs, masked=True).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time, in the order of the mix's slots.

    Null and wordless texts have no words to take and are in no mix; null ids and sources are kinds of their own.
    """
    at = mixing.whole_times(mixing.mix(docs)).select(F.col("h").alias("h_"), F.col("doc_id").alias("id_"), F.col("source").alias("source_"), "slots")
    rows = docs.select(F.struct(*docs.columns).alias("row"), mixing.row_hash().alias("h"))  # as one column, no name clashes
    same = (F.col("h") == F.col("h_")) & F.col("row.doc_id").eqNullSafe(F.col("id_")) & F.col("row.source").eqNullSafe(F.col("source_"))
    rows = rows.join(at, same).select("row", F.explode("slots").alias("slot"))
    return rows.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the digests of ids and decoded text, and the ids themselves, a row per row of docs. Null
    and empty texts have no ids and the digests of nothing."""
    out = bpe.encoded(docs.select("doc_id", "source", "text"), keep_ids=True)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
    ("bpe", to_tokens),
]

#: Classifier scores and exact tokens can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again. What a stage has written on its way,
    and its predecessor's output, are deleted once its own output stands."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid4().hex}"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
