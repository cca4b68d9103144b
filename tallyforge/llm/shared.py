"""Small helpers that several text operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.tables import durable, forget, new_folder, remove

__all__ = ["durable", "forget", "held_out", "new_folder", "remove", "table", "utf8"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows whose crc32 of the id's text leaves `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def utf8(text: Column) -> Column:
    """The text's bytes, so that Python workers need not decode them; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
