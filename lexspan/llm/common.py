"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir, staged  # noqa: F401

#: A word, as every operator here counts words.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast at most; every use counts them first and has another way beyond.
BROADCAST_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters of a table that may be broadcast at most, where rows have no bounded size.
BROADCAST_CHARS = 64 << 20


def small_or_not(df: DataFrame, rows: int, chars: int = 0) -> DataFrame:
    """A broadcast hint if the counted rows and characters are within the bounds, else df for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones: bounds what a Python worker holds beside the batch itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def texts(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return pc.fill_null(column, "").to_pylist()
