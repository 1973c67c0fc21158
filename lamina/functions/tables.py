"""Cutting lineage through the shared folder, dealing rows over tasks, and the search path of Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def with_workers(spark: SparkSession) -> SparkSession:
    """Python workers started from now on find this package where the driver has it, if that place exists for them."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets a temporary one; on a
    cluster that would be a folder which other machines can't see, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows of `df`, written once to the folder that spark.checkpoint.dir names and read back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` dealt by `keys` over all shuffle partitions, for work that is dear by row: adaptive execution joins small
    partitions by their bytes, and leaves a number that is asked for alone. Rows that a join or a grouping has dealt by the same
    keys are not dealt anew, so `df` should be stored ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
