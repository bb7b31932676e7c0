"""The built knowledge base on disk, under a name that changes with its content."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kb
from ..operators.decisions import KnowledgeBase
from .staging import shared_dir

#: Goes up when the same texts would give another knowledge base.
VERSION = 2


def signature(documents: DataFrame) -> str:
    """A hash of the rows, whatever their order: two sums of 64-bit hashes with different seeds, and the count."""
    hashed = [F.sum(F.xxhash64(F.lit(seed), *documents.columns).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    row = documents.agg(F.count("*").alias("n"), *hashed).first()
    return hashlib.sha256(f"{VERSION} {row.n} {row.h1} {row.h2}".encode()).hexdigest()[:16]


def build(documents: DataFrame) -> KnowledgeBase:
    """From id, tribunal, natureza, texto."""
    other = F.coalesce("natureza", F.lit("")).isin("sumula", "dispositivo")
    keys = kb.rulings(documents.where(~other)).select(F.explode("chaves").alias("chave"), "id", "tribunal", "classes")
    return KnowledgeBase(keys, kb.statements(documents.where("natureza = 'sumula'")), kb.articles(documents.where("natureza = 'dispositivo'")))


def load(documents: DataFrame, folder: str | None = None) -> KnowledgeBase:
    """The stored relations of these documents; built and written first if they are not there."""
    spark = documents.sparkSession
    base = f"{folder or shared_dir(spark)}/kb-{signature(documents)}"
    parts = ("keys", "statements", "articles")
    made = build(documents)
    for name in parts:
        df = getattr(made, name)
        # a write that another run has finished is left alone
        df.write.mode("ignore").parquet(f"{base}/{name}")
    return KnowledgeBase(*(spark.read.schema(getattr(made, n).schema).parquet(f"{base}/{n}") for n in parts))
