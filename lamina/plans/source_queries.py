"""Queries of discovery, hashing and simulation indices, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import facts as X
from lamina.sources import samples as S
from lamina.sources import stores


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of channel files made from page numbers, one of five not of that form."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("BSE", "etd", "SE", "Inlens", "note")]), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    folder = F.concat(F.lit("Batch_"), F.pmod("page_id", F.lit(3)) + 1)
    name = F.concat(F.lit("IMG_X"), F.floor(F.col("page_id") / 5).cast("string"), F.lit("_"), kind, F.lit(".tif"))
    return X.table(spark, sf_dir, "pages").select(F.concat_ws("/", folder, name).alias("path"))


def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parsed(_names(spark, sf_dir)).select("path", "sample_id", "channel", "etd_is_se", "batch")


def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.group(S.parsed(_names(spark, sf_dir)))
    return found.select("sample_id", "batch", F.col("paths")["ETD"].alias("etd"), "n_duplicates", "complete", "etd_is_se")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))


def baseline_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.baseline_version(X.samples(spark, sf_dir).where(F.col("batch") == X.BASELINE))


def queries() -> dict:
    return {f.__name__: f for f in (filename_parse, discover, content_hash, baseline_version)}


_NAMES = """
WITH n AS (SELECT page_id, 'Batch_' || (page_id % 3 + 1) AS folder, page_id // 5 AS k, ['BSE', 'etd', 'SE', 'Inlens', 'note'][page_id % 5 + 1] AS kind FROM pages),
p AS (SELECT folder || '/IMG_X' || k || '_' || kind || '.tif' AS path, 'img_x' || k AS sample_id, page_id % 3 + 1 AS b,
             CASE kind WHEN 'BSE' THEN 'BSE' WHEN 'Inlens' THEN 'Inlens' ELSE 'ETD' END AS channel, kind = 'SE' AS etd_is_se FROM n WHERE kind <> 'note')"""


def oracle_sql() -> dict[str, str]:
    return {
        "filename_parse": _NAMES + " SELECT path, sample_id, channel, etd_is_se, b::VARCHAR AS batch FROM p",
        "discover": _NAMES
        + """, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY path) AS i FROM p)
SELECT sample_id, (min_by(b, path))::VARCHAR AS batch, max(path) FILTER (channel = 'ETD' AND i = 1) AS etd, count(*) FILTER (i > 1) AS n_duplicates,
       count(DISTINCT channel) = 3 AS complete, bool_or(etd_is_se) FILTER (i = 1) AS etd_is_se
FROM r GROUP BY sample_id HAVING bool_or(channel = 'BSE')""",
        "content_hash": "SELECT page_id, sha1(html) AS sha FROM pages",
        "baseline_version": "SELECT count(*) AS n, substr(sha1(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR)), 1, 8) AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3",
    }
