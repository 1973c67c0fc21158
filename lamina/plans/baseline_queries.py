"""Queries of the baseline comparison, with DuckDB counterparts written from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.robust import weighted_quantiles
from lamina.operators import baseline as B
from lamina.operators import facts as X


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def robust_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.baseline(X.facts(spark, sf_dir)), "med", "mad", "within_se", "scale", "min", "max")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts(spark, sf_dir)
    return B.zscores(facts, B.baseline(facts))


def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("sample_id", "batch", "kpi", "value", "z"), "value", "z")


def strip_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.facts(spark, sf_dir).select("sample_id", "kpi", "se"), "se")


def topk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.top_score(scored(spark, sf_dir)), "score")


def _defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned and discounted line items of a sample, over its number of line items as the area."""
    lines = X.table(spark, sf_dir, "lineitem")
    count = lines.groupBy(F.col("l_suppkey").alias("sample_id")).agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned_count"), F.count(F.when(F.col("l_discount") > 0.095, 1)).alias("deep_discount_count"), F.count(F.lit(1)).cast("double").alias("area")
    )
    return count.join(X.samples(spark, sf_dir), "sample_id").unpivot(["sample_id", "batch", "area"], ["returned_count", "deep_discount_count"], "kpi", "observed")


def defect_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.defect_alarms(_defect_counts(spark, sf_dir)), "expected")


def verdict_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.verdicts(scored(spark, sf_dir), B.defect_alarms(_defect_counts(spark, sf_dir)))


def loo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.loo_scores(X.facts(spark, sf_dir)), "score")


def conformal_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts(spark, sf_dir)
    scores = B.top_score(B.zscores(facts, B.baseline(facts)))
    return rounded(B.conformal(scores, B.loo_scores(facts)), "score", "p_rank", "p_floor")


def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = X.facts(spark, sf_dir, X.GATES).drop("se")
    return B.gate_status(B.zscores(gates, B.baseline(gates, floors=False)))


def area_weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = X.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_quantity").alias("size")).withColumn("area", F.col("size") * F.col("size"))
    return rounded(weighted_quantiles(sizes, ["sample_id"], "size", "area", [0.1, 0.5, 0.9]), "value")


def queries() -> dict:
    return {f.__name__: f for f in (robust_baseline, zscores, strip_se, topk_score, verdict_zones, defect_alarm, loo_scores, conformal_p, gate_status, area_weighted_quantile)}


_LINES = """
lines AS (
  SELECT s_suppkey AS sample_id, n_regionkey::BIGINT AS batch, l_orderkey % 5 AS strip, l_quantity, l_extendedprice, l_discount, l_tax,
         l_linenumber, l_returnflag, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def _facts(named: dict[str, str]) -> str:
    parts = [
        f"""SELECT sample_id, batch, '{k}' AS kpi, avg({e}) AS value,
       (SELECT CASE WHEN count(*) >= 2 THEN stddev_samp(m) / sqrt(count(*)) END
        FROM (SELECT avg({e}) AS m FROM lines i WHERE i.sample_id = o.sample_id GROUP BY strip)) AS se
FROM lines o GROUP BY sample_id, batch"""
        for k, e in named.items()
    ]
    return "facts AS (" + "\nUNION ALL\n".join(parts) + ")"


FACTS = (
    "WITH "
    + _LINES
    + ",\n"
    + _facts(
        {
            "qty_mean": "l_quantity",
            "price_mean": "l_extendedprice",
            "unit_price_mean": "l_extendedprice / l_quantity",
            "discount_mean": "l_discount",
            "returned_frac": "(l_returnflag = 'R')::INT::DOUBLE",
            "open_frac": "(l_linestatus = 'O')::INT::DOUBLE",
        }
    )
)
_FLOOR = "CASE WHEN kpi IN ('discount_mean', 'returned_frac', 'open_frac') THEN 0.005::DOUBLE ELSE 0 END"
STATS = (
    FACTS
    + f""",
centre AS (
  SELECT kpi, count(value) AS n, median(value) AS med, coalesce(median(se), 0) AS within_se, min(value) AS min, max(value) AS max
  FROM facts WHERE batch = 3 GROUP BY kpi
),
stats AS (
  SELECT kpi, any_value(n) AS n, any_value(c.med) AS med, 1.4826::DOUBLE * median(abs(value - c.med)) AS mad, any_value(within_se) AS within_se,
         greatest(1.4826::DOUBLE * median(abs(value - c.med)), any_value(within_se), 0.05::DOUBLE * abs(any_value(c.med)), {_FLOOR}) AS scale,
         any_value(c.min) AS min, any_value(c.max) AS max
  FROM facts JOIN centre c USING (kpi) WHERE batch = 3 GROUP BY kpi
),
scored AS (SELECT sample_id, batch, kpi, value, (value - med) / scale AS z FROM facts LEFT JOIN stats USING (kpi))"""
)
_TOP = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(z) DESC) AS r FROM scored WHERE z IS NOT NULL),
scores AS (SELECT sample_id, batch, avg(abs(z)) FILTER (r <= 3) AS score FROM ranked GROUP BY sample_id, batch)"""
_COUNTS = """
counts AS (
  SELECT sample_id, batch, count(*)::DOUBLE AS area, count(*) FILTER (l_returnflag = 'R') AS returned_count,
         count(*) FILTER (l_discount > 0.095) AS deep_discount_count
  FROM lines GROUP BY ALL
),
defects AS (
  SELECT sample_id, batch, area, 'returned_count' AS kpi, returned_count AS observed FROM counts
  UNION ALL SELECT sample_id, batch, area, 'deep_discount_count', deep_discount_count FROM counts
),
alarms AS (
  SELECT sample_id, kpi, observed, most * area / mid AS expected,
         observed > most * area / mid + 3 * sqrt(greatest(most * area / mid, 1)) AS alarm
  FROM defects JOIN (SELECT kpi, max(observed) AS most FROM defects WHERE batch = 3 GROUP BY kpi) USING (kpi),
       (SELECT median(area) AS mid FROM counts WHERE batch = 3)
)"""
_LOO = f"""
base AS (SELECT * FROM facts WHERE batch = 3),
pairs AS (SELECT a.sample_id AS out_id, b.* FROM (SELECT DISTINCT sample_id FROM base) a JOIN base b ON a.sample_id <> b.sample_id),
loo_centre AS (SELECT out_id, kpi, median(value) AS med, median(se) AS wse FROM pairs GROUP BY ALL),
loo_scale AS (
  SELECT out_id, kpi, any_value(c.med) AS med,
         greatest(1.4826::DOUBLE * median(abs(value - c.med)), coalesce(any_value(wse), 0), 0.05::DOUBLE * abs(any_value(c.med)), {_FLOOR}) AS scale
  FROM pairs JOIN loo_centre c USING (out_id, kpi) GROUP BY out_id, kpi
),
loo_z AS (SELECT b.sample_id, abs((b.value - s.med) / s.scale) AS z FROM base b JOIN loo_scale s ON b.sample_id = s.out_id AND b.kpi = s.kpi),
loo AS (SELECT sample_id, avg(z) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY z DESC) AS r FROM loo_z) WHERE r <= 3 GROUP BY sample_id)"""


def oracle_sql() -> dict[str, str]:
    gates = "WITH " + _LINES + ",\n" + _facts({"tax_mean": "l_tax", "line_number_mean": "l_linenumber::DOUBLE"})
    return {
        "robust_baseline": STATS + " SELECT kpi, n, round(med, 8) AS med, round(mad, 8) AS mad, round(within_se, 8) AS within_se, round(scale, 8) AS scale, round(min, 8) AS min, round(max, 8) AS max FROM stats",
        "zscores": STATS + " SELECT sample_id, batch, kpi, round(value, 8) AS value, round(z, 8) AS z FROM scored",
        "strip_se": FACTS + " SELECT sample_id, kpi, round(se, 8) AS se FROM facts",
        "topk_score": STATS + "," + _TOP + " SELECT sample_id, batch, round(score, 8) AS score FROM scores",
        "defect_alarm": "WITH " + _LINES + "," + _COUNTS + " SELECT sample_id, kpi, observed, round(expected, 8) AS expected, alarm FROM alarms",
        "verdict_zones": STATS
        + ","
        + _COUNTS
        + """,
n AS (SELECT sample_id, batch, count(*) FILTER (abs(z) > 12.8) AS n_reject, count(*) FILTER (abs(z) > 8) AS n_investigate,
             count(*) FILTER (abs(z) > 6.4) AS n_watch,
             (SELECT count(*) FROM alarms a WHERE a.sample_id = s.sample_id AND alarm) AS n_alarms
      FROM scored s GROUP BY sample_id, batch)
SELECT *, CASE WHEN n_reject > 0 OR n_investigate >= 3 OR n_alarms > 0 THEN 'REJECT'
               WHEN n_investigate > 0 OR n_watch >= 2 THEN 'INVESTIGATE' ELSE 'ACCEPT' END AS decision FROM n""",
        "loo_scores": FACTS + "," + _LOO + " SELECT sample_id, round(score, 8) AS score FROM loo",
        "conformal_p": STATS
        + ","
        + _TOP
        + ","
        + _LOO
        + """
SELECT sample_id, batch, round(score, 8) AS score,
       round((1 + (SELECT count(*) FROM loo WHERE loo.score >= s.score)) / ((SELECT count(*) FROM loo) + 1)::DOUBLE, 8) AS p_rank,
       round(1 / ((SELECT count(*) FROM loo) + 1)::DOUBLE, 8) AS p_floor
FROM scores s WHERE score IS NOT NULL""",
        "gate_status": gates
        + """,
c AS (SELECT kpi, median(value) AS med FROM facts WHERE batch = 3 GROUP BY kpi),
s AS (SELECT kpi, any_value(med) AS med, greatest(1.4826::DOUBLE * median(abs(value - med)), 0.05::DOUBLE * abs(any_value(med))) AS scale
      FROM facts JOIN c USING (kpi) WHERE batch = 3 GROUP BY kpi)
SELECT sample_id, count(*) FILTER (abs(value - med) / scale > 4) AS n_flags,
       CASE WHEN count(*) FILTER (abs(value - med) / scale > 4) > 0 THEN 'caution' ELSE 'ok' END AS status
FROM facts JOIN s USING (kpi) GROUP BY sample_id""",
        "area_weighted_quantile": """
WITH d AS (SELECT l_suppkey AS sample_id, l_quantity AS x, sum(l_quantity * l_quantity) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT sample_id, x, sum(w) OVER (PARTITION BY sample_id ORDER BY x) / sum(w) OVER (PARTITION BY sample_id) AS s FROM d),
p AS (SELECT *, lag(s) OVER (PARTITION BY sample_id ORDER BY x) AS s0, lag(x) OVER (PARTITION BY sample_id ORDER BY x) AS x0 FROM c)
SELECT sample_id, q, round(CASE WHEN s0 IS NULL THEN x ELSE x0 + (q - s0) / (s - s0) * (x - x0) END, 8) AS value
FROM p, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS q) WHERE q <= s AND (s0 IS NULL OR q > s0)""",
    }
