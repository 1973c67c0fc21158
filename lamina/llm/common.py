"""Helpers shared by the text operators: reading, shared scratch tables, chunked span arithmetic."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.tables import scratch_root, stored

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: White space between words, as a Java regular expression.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Stands for a null identifier where rows are compared; it sorts below all others.
LOWEST_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LOWEST_ID))


def packed_row(docs: DataFrame) -> Column:
    """The whole row as one column `row`, so that columns which an operator adds can't replace columns of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lamina/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder once and read back from there."""
    return stored(df, name, compression="zstd")


def small_arrow_batches(spark: SparkSession, rows: int = 1024, size: str = "8m") -> None:
    """Long texts must not meet in one Arrow batch: bound it by rows and bytes. Python workers started from now on
    also find this package where the driver has it, if that place exists for them."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
