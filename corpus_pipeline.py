"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

All stages take whole texts of any length, null and empty ones too, rows that repeat, null ids and an empty table, and
the columns of `documents` in any order; all but the last return these columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.tables import scratch
from tallyforge.llm import bestfit, decontaminate, langid, linededup, neardup
from tallyforge.llm.shared import durable, held_out, new_folder, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those that score or lead less than the labelled rows kept out of the fit.

    All other labelled rows are fitted, and all that are kept out set the limits. A null or empty text has no letter and
    goes. Equal texts stay or go together. An empty table stays empty.
    """
    out = held_out(F.col("doc_id"), 3, 1)
    scored = durable(langid.predict(docs, langid.fit_whole(docs.where(~out))))
    return scored.where(langid.accepted(*langid.limits(scored.where(out)))).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many documents of one source share out of their texts; keeps every document.

    Repeated rows are pages of their own. A null source shares lines with none, a null text stays null, and n_chars follows
    the text.
    """
    out = linededup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (Jaccard similarity of five-word shingles), the one with the smallest id.

    Null ids come last; of rows that repeat id and text one stays. All null and blank texts are one class.
    """
    return neardup.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the folder's benchmark, whole or edited.

    Null and empty texts hold none. Repeated rows stay or go together. An empty benchmark drops nothing.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences of at most 1024 tokens: a row a piece.

    A null text counts as empty, which is one end token. Repeated rows are packed each. No documents give no pieces.
    """
    return bestfit.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", keep_known_languages),
    ("line dedup", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Language identification, fingerprints, edit distances and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents, with a written table between one stage and the next.

    Of the folder's table the columns of COLUMNS are taken. What a stage writes on its way goes when it ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    last = None
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
