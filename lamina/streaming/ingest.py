"""Continuous ingest of facts: files of measurements arrive in a folder and become deduplicated fact rows.

The comparison engine itself works on tables; this is the only streaming part, for feeding them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MEASUREMENTS = "sample_id string, batch long, strip int, kpi string, value double, taken timestamp"


def measurements(spark: SparkSession, folder: str, late: str = "1 day", files_a_batch: int = 1000) -> DataFrame:
    """A stream of measurements without repeats; a repeat that comes later than `late` is not recognised."""
    rows = spark.readStream.schema(MEASUREMENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    clean = rows.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    return clean.withWatermark("taken", late).dropDuplicatesWithinWatermark(["sample_id", "strip", "kpi", "taken"])


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends what has arrived to a table partitioned by batch, then stops; run again, it takes up where it was."""
    rows = measurements(spark, folder, late)
    return rows.writeStream.format("parquet").partitionBy("batch").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
