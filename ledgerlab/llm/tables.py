"""Reading the tables of a folder, and one row per input row."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a folder.

    Python workers import this package too; where it isn't installed, they find it where the driver does.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only: other columns, whatever their names, stay out of an operator's way; a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def is_held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
