"""Job: quality control of documents as they arrive.

Deliveries of documents land as Parquet files in a folder. A sample is what one source delivers in one language, the
language is its batch. A file stream with a checkpoint takes the files that are new, measures their texts with
column expressions and stores sums for each micro-batch, in a partition of its own: a micro-batch that runs again after a
failure replaces its partition, so nothing counts twice. From all sums follow the facts (a mean and the standard error
that the strips imply), and with the library's comparison the robust baseline, z-scores and each sample's verdict. The
report is partitioned by batch; every run writes it anew from the sums, so a run without new files changes nothing.

    python -m jobs.text_quality --documents PATH --output PATH --checkpoint PATH [--config FILE]

Null texts count as empty, null identifiers as 0, null or empty languages and sources as `unknown`; repeated rows count as
often as they occur; other columns are ignored. A sample without words or characters has no value for shares of them.
"""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.tables import scratch_root
from lamina.operators import baseline as B

LOG = logging.getLogger(__name__)
DOCUMENTS = "doc_id long, text string, lang string, source string"
COUNTS = ["documents", "empty", "chars", "bytes", "words", "lines", "digits"]
SUMS = "sample_id string, batch string, strip int, " + ", ".join(f"{c} long" for c in COUNTS) + ", ingest long"
REPORT = "sample_id string, kpi string, value double, se double, z double, documents long, decision string, batch string"
#: Indicators as a sum over a sum.
INDICATORS = {
    "chars_mean": ("chars", "documents"),
    "words_mean": ("words", "documents"),
    "lines_mean": ("lines", "documents"),
    "empty_share": ("empty", "documents"),
    "chars_per_word": ("chars", "words"),
    "bytes_per_char": ("bytes", "chars"),
    "digit_share": ("digits", "chars"),
}


def _named(column: str) -> Column:
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("unknown"))


def sums(docs: DataFrame, strips: int) -> DataFrame:
    """Whole-number sums of a micro-batch by sample and strip: what later micro-batches add to."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(
        F.concat_ws("/", _named("lang"), _named("source")).alias("sample_id"),
        _named("lang").alias("batch"),
        # By a digest, as identifiers often follow their source.
        F.pmod(F.conv(F.substring(F.md5(F.coalesce("doc_id", F.lit(0)).cast("string")), 1, 7), 16, 10).cast("long"), F.lit(strips)).cast("int").alias("strip"),
        F.lit(1).alias("documents"),
        (text == "").cast("long").alias("empty"),
        F.char_length(text).alias("chars"),
        F.octet_length(text).alias("bytes"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).alias("words"),
        (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).alias("lines"),
        (F.char_length(text) - F.char_length(F.translate(text, "0123456789", ""))).alias("digits"),
    )
    return measured.groupBy("sample_id", "batch", "strip").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def facts(stored_sums: DataFrame) -> DataFrame:
    """`sample_id, batch, kpi, value, se, documents` over all that has arrived."""
    by_strip = stored_sums.groupBy("sample_id", "batch", "strip").agg(*[F.sum(c).alias(c) for c in COUNTS])
    ratio = {k: F.try_divide(F.col(a), F.col(b)) for k, (a, b) in INDICATORS.items()}
    whole = {k: F.try_divide(F.sum(a), F.sum(b)) for k, (a, b) in INDICATORS.items()}
    error = {k: F.when(F.count(r) >= 2, F.stddev_samp(r) / F.sqrt(F.count(r))) for k, r in ratio.items()}
    wide = by_strip.groupBy("sample_id", "batch").agg(F.sum("documents").alias("documents"), *[F.struct(whole[k].alias("value"), error[k].alias("se")).alias(k) for k in INDICATORS])
    long = wide.unpivot(["sample_id", "batch", "documents"], list(INDICATORS), "kpi", "fact")
    return long.select("sample_id", "batch", "documents", "kpi", "fact.value", "fact.se")


def report(measured: DataFrame, baseline: str) -> DataFrame:
    """Every fact with its z-score against the baseline batch, and its sample's verdict."""
    scored = B.zscores(measured, B.baseline(measured, baseline))
    decided = B.verdicts(scored).select("sample_id", "decision")
    return scored.join(decided, "sample_id").select("sample_id", "kpi", "value", "se", "z", "documents", "decision", "batch")


def _partitioned(rows: DataFrame, column: str, path: str) -> None:
    """Replaces the partitions that `rows` has and no others."""
    rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _ingested(spark: SparkSession, path: str) -> DataFrame | None:
    """The sums so far; none before the first file has come."""
    try:
        return spark.read.schema(SUMS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def take(batch: DataFrame, ingest: int, output: str, strips: int) -> None:
    """One micro-batch; run twice under the same number it has the same effect as once."""
    _partitioned(sums(batch, strips).withColumn("ingest", F.lit(ingest).cast("long")), "ingest", f"{output}/sums")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new in `documents`, a folder or a pattern of paths, and returns the report as it stands then."""
    before = _ingested(spark, f"{output}/sums")
    last = -1 if before is None else before.agg(F.max("ingest")).first()[0]
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_trigger"]).parquet(documents)
    writer = stream.writeStream.foreachBatch(lambda batch, n: take(batch, n, output, config["strips"]))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    after = _ingested(spark, f"{output}/sums")
    if after is None:
        LOG.info("no file has come to %s yet", documents)
        return spark.createDataFrame([], REPORT)
    new = after.where(F.col("ingest") > last).agg(F.countDistinct("ingest"), F.coalesce(F.sum("documents"), F.lit(0))).first()
    LOG.info("read %d new documents in %d micro-batches from %s", new[1], new[0], documents)
    _partitioned(report(facts(after), config["baseline"]), "batch", f"{output}/report")
    out = spark.read.schema(REPORT).parquet(f"{output}/report")
    LOG.info("wrote %d rows to %s/report", out.count(), output)
    return out


def job1_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table into one new folder; the report after the second, which finds nothing new."""
    folder, config = f"{scratch_root(spark)}/lamina/job1-{uuid.uuid4().hex}", default_config()
    # A file stream takes folders or patterns; the table may be a single file, so it is named by a pattern.
    for _ in range(2):
        out = run(spark, f"{sf_dir}/documents.[p]arquet", f"{folder}/output", f"{folder}/checkpoint", config)
    return out.withColumns({c: F.round(c, 8) for c in ("value", "se", "z")})


def default_config() -> dict:
    return json.loads(Path(__file__).with_suffix(".json").read_text())


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file on the driver; its entries replace the defaults")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = default_config() | (json.loads(Path(given.config).read_text()) if given.config else {})
    spark = SparkSession.builder.appName("text-quality").getOrCreate()
    try:
        run(spark, given.documents, given.output, given.checkpoint, config)
    finally:
        spark.stop()


def _sql() -> str:
    """The report from the definition, over the whole table at once."""
    long = " UNION ALL ".join(
        f"SELECT sample_id, batch, '{k}' AS kpi, sum({a}) / nullif(sum({b}), 0)::DOUBLE AS value, sum(documents)::BIGINT AS documents, "
        f"CASE WHEN count({a} / nullif({b}, 0)) >= 2 THEN stddev_samp({a} / nullif({b}, 0)::DOUBLE) / sqrt(count({a} / nullif({b}, 0))) END AS se FROM strips GROUP BY ALL"
        for k, (a, b) in INDICATORS.items()
    )
    return rf"""
WITH named AS (
  SELECT ('0x' || substr(md5(coalesce(doc_id, 0)::VARCHAR), 1, 7))::BIGINT % 5 AS strip, coalesce(text, '') AS t, coalesce(nullif(lang, ''), 'unknown') AS batch,
    coalesce(nullif(source, ''), 'unknown') AS source FROM documents),
strips AS (
  SELECT batch || '/' || source AS sample_id, batch, strip, count(*) AS documents, count(*) FILTER (t = '') AS empty, sum(length(t)) AS chars,
    sum(strlen(t)) AS bytes, sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS words, sum(len(string_split(t, chr(10)))) AS lines,
    sum(len(regexp_extract_all(t, '[0-9]'))) AS digits
  FROM named GROUP BY batch, source, strip),
facts AS ({long}),
centre AS (SELECT kpi, median(value) AS med, coalesce(median(se), 0) AS wse FROM facts WHERE batch = 'en' GROUP BY kpi),
stats AS (
  SELECT kpi, any_value(med) AS med, greatest(1.4826::DOUBLE * median(abs(value - med)), any_value(wse), 0.05::DOUBLE * abs(any_value(med))) AS s
  FROM facts JOIN centre USING (kpi) WHERE batch = 'en' GROUP BY kpi),
scored AS (SELECT f.*, (value - med) / CASE WHEN s > 0 THEN s ELSE 1e-9 END AS z FROM facts f LEFT JOIN stats USING (kpi)),
decided AS (
  SELECT sample_id, CASE WHEN count(*) FILTER (abs(z) > 12.8) > 0 OR count(*) FILTER (abs(z) > 8) >= 3 THEN 'REJECT'
    WHEN count(*) FILTER (abs(z) > 8) > 0 OR count(*) FILTER (abs(z) > 6.4) >= 2 THEN 'INVESTIGATE' ELSE 'ACCEPT' END AS decision
  FROM scored GROUP BY sample_id)
SELECT sample_id, kpi, round(value, 8) AS value, round(se, 8) AS se, round(z, 8) AS z, documents, decision, batch
FROM scored JOIN decided USING (sample_id)"""


JOB1_SQL = _sql()

if __name__ == "__main__":
    main()
