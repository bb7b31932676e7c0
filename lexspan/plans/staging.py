"""Written intermediate tables: they cut long plans, and survive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a new local one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lexspan_stage", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._lexspan_stage = "file://" + tempfile.mkdtemp(prefix="lexspan-")
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    getattr(spark, "_lexspan_made", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what staged() has written within. What is made of those tables must be written by then."""
    outer, made = getattr(spark, "_lexspan_made", None), []
    spark._lexspan_made = made
    try:
        yield
    finally:
        if outer is None:
            del spark._lexspan_made
        else:
            spark._lexspan_made = outer
        for path in made:
            removed(spark, path)
