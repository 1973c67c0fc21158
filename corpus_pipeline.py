"""From raw documents to packed training sequences, in five stages of the text operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of `documents`; the last returns the pieces with their place in a sequence.

Results for unusual input: a null or empty text has no words, so the quality rules reject it; of rows with equal
texts the one with the largest identifier stays, of rows that repeat identifier and text one; of near-duplicates the
one with the smallest identifier stays; a null identifier ranks below all others; texts of any length are read whole;
columns beside those of `documents` are carried through all stages but the last, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import exact_dedup, packing, quality_rules, secret_scans, simhash
from lamina.llm.chunk_encoder import tokenizer_path
from lamina.llm.common import text_of, written


def _carried(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that columns which an operator adds can't replace columns of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list let pass."""
    rules = quality_rules.learned(spark, docs, sf_dir)
    return quality_rules.judged(_carried(docs), rules).where("kept").select("__row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within 3 bits, or five-word similarity of 0.8."""
    return simhash.keep_one(docs, similar=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; the number of characters follows the text."""
    text = text_of("text")
    clean = secret_scans.scan(_carried(docs)).withColumn("__clean", secret_scans.redacted(text, F.col("all_spans")))
    changed = F.size("all_spans") > 0
    new = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}

    def column(name: str) -> Column:
        old = F.col("__row").getField(name)
        return (F.when(changed, new[name]).otherwise(old) if name in new else old).alias(name)

    return clean.select(*[column(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    # Executors have run the other stages before, so the encoder's memo is kept small.
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), memo_chunks=300_000))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("secret scans", secrets), ("best-fit packing", pack)]

#: Hash-function and learned stages have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
