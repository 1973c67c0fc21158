"""Sinks and stores: stage cache, numbered snapshots, tables and documents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_key(stage: str, config: dict, version: str, skip: tuple[str, ...] = ()) -> str:
    """A key that changes with the stage's code version and the configuration that can affect it."""
    used = {k: v for k, v in config.items() if k not in skip}
    return hashlib.sha1(json.dumps([stage, version, used], sort_keys=True).encode()).hexdigest()[:12]


def stale(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Inputs whose fingerprint has no row in `results` (fingerprint, stage_key) under the key."""
    return inputs.join(results.where(F.col("stage_key") == key).select("fingerprint"), "fingerprint", "left_anti")


class StageCache:
    """Results by content fingerprint, a parquet partition for each stage key."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key

    def _rows(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(self.folder).where(F.col("stage_key") == self.key)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def stale(self, inputs: DataFrame) -> DataFrame:
        """Inputs whose fingerprint has no result under this key."""
        rows = self._rows()
        return inputs if rows is None else stale(inputs, rows, self.key)

    def add(self, results: DataFrame) -> None:
        results.withColumn("stage_key", F.lit(self.key)).write.mode("append").partitionBy("stage_key").parquet(self.folder)

    def results(self, inputs: DataFrame) -> DataFrame:
        rows = self._rows()
        if rows is None:
            raise ValueError("nothing is cached yet")
        return inputs.join(rows.drop("stage_key"), "fingerprint")


class Snapshots:
    """Accepted tables of facts, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.parquet(self.folder).select("snapshot").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise
        return sorted(int(r[0]) for r in found)

    def accept(self, facts: DataFrame) -> int:
        number = (self.numbers() or [0])[-1] + 1
        facts.write.parquet(f"{self.folder}/snapshot={number}")
        return number

    def last(self) -> DataFrame | None:
        numbers = self.numbers()
        return self.spark.read.parquet(f"{self.folder}/snapshot={numbers[-1]}") if numbers else None


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with header under an explicit schema; NaN becomes null, as statistics expect."""
    table = spark.read.schema(schema).option("header", "true").csv(path)
    return table.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes])


def to_documents(rows: DataFrame, key: str) -> DataFrame:
    """`key, document`: each row as JSON."""
    return rows.select(key, F.to_json(F.struct("*")).alias("document"))


def baseline_version(samples: DataFrame) -> DataFrame:
    """`n, version`: eight hexadecimal digits over the sorted identifiers."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("sample_id").cast("string"))), ",")
    return samples.agg(F.count(F.lit(1)).alias("n"), F.substring(F.sha1(ids), 1, 8).alias("version"))
