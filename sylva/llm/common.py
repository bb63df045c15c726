"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` only, so that further columns of any name can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
