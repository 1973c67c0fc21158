from datetime import datetime

from lamina.streaming.ingest import MEASUREMENTS, ingest


def test_ingest_takes_up_where_it_was(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = datetime(2024, 5, 1)
    rows = [("a", 3, 0, "x", 1.0, at), ("a", 3, 0, "x", 1.0, at), ("a", 3, 1, "x", float("nan"), at)]
    spark.createDataFrame(rows, MEASUREMENTS).write.parquet(source)
    ingest(spark, source, target, state).awaitTermination()
    spark.createDataFrame([("b", 1, 0, "x", 2.0, at), rows[0]], MEASUREMENTS).write.mode("append").parquet(source)
    ingest(spark, source, target, state).awaitTermination()
    got = spark.read.parquet(target).collect()
    assert sorted((r["sample_id"], r["strip"], r["value"]) for r in got if r["value"]) == [("a", 0, 1.0), ("b", 0, 2.0)] and len(got) == 3
