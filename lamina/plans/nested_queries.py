"""Queries of the nested validation, with DuckDB counterparts that do the cubic join of folds, inner samples and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import assign as A
from lamina.operators import facts as X
from lamina.operators import nested as N
from lamina.plans.assign_queries import _WEIGHT
from lamina.plans.baseline_queries import _FLOOR, FACTS, rounded


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nested_tuning(X.facts(spark, sf_dir), X.strip_facts(spark, sf_dir))


def nested_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample judged by what the others teach: chosen shrinkage and temperature, batch, agreement of its strips, verdict."""
    out = _nested(spark, sf_dir).withColumn("p_top", F.array_max(F.map_values("chances")))
    return rounded(out.select("sample_id", "batch", "delta", "temperature", "assigned", "p_top", "strip_agreement", "decision"), "p_top", "strip_agreement", digits=6)


def nested_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.summary(_nested(spark, sf_dir)), "accuracy", "nll", "brier", "strip_consistency", digits=6)


def queries() -> dict:
    return {f.__name__: f for f in (nested_tuning, nested_summary)}


def _list(values: list[float]) -> str:
    return f"(SELECT unnest([{', '.join(map(str, values))}]::DOUBLE[]) AS v)"


_STRIP_FACTS = " UNION ALL ".join(
    f"SELECT sample_id, strip, '{k}' AS kpi, avg({e}) AS value FROM lines GROUP BY ALL"
    for k, e in (
        ("qty_mean", "l_quantity"),
        ("price_mean", "l_extendedprice"),
        ("unit_price_mean", "l_extendedprice / l_quantity"),
        ("discount_mean", "l_discount"),
        ("returned_frac", "(l_returnflag = 'R')::INT::DOUBLE"),
        ("open_frac", "(l_linestatus = 'O')::INT::DOUBLE"),
    )
)
_DRAWN = "g + sign(m - g) * greatest(abs(m - g) - {0}, 0)"
_SQL = (
    FACTS
    + f""",
fold AS (SELECT DISTINCT sample_id AS f, batch AS own FROM facts),
train AS (SELECT f, own, t.* FROM fold JOIN facts t ON sample_id <> f),
c AS (SELECT f, kpi, median(value) AS med, coalesce(median(se), 0) AS wse FROM train WHERE batch = 3 GROUP BY ALL),
s AS (SELECT f, kpi, any_value(c.med) AS med, greatest(1.4826::DOUBLE * median(abs(value - c.med)), any_value(wse), 0.05::DOUBLE * abs(any_value(c.med)), {_FLOOR}) AS scale
      FROM train JOIN c USING (f, kpi) WHERE batch = 3 GROUP BY f, kpi),
feat AS (SELECT f, sample_id, batch, kpi, (value - med) / scale * {_WEIGHT} AS x FROM train JOIN s USING (f, kpi)),
cen AS (SELECT a.f, a.sample_id AS i, a.batch AS ib, b.batch AS candidate, b.kpi, median(b.x) AS m
        FROM (SELECT DISTINCT f, sample_id, batch FROM feat) a JOIN feat b ON a.f = b.f AND a.sample_id <> b.sample_id GROUP BY ALL),
mid AS (SELECT f, i, kpi, median(m) AS g FROM cen GROUP BY ALL),
dist AS (SELECT cen.f, cen.i, ib, candidate, v AS delta, sum((x - ({_DRAWN.format("v")})) ** 2) AS d2
         FROM cen JOIN mid USING (f, i, kpi) JOIN feat ON feat.f = cen.f AND feat.sample_id = cen.i AND feat.kpi = cen.kpi, {_list(A.SHRINKAGES)} GROUP BY ALL),
ex AS (SELECT f, i, ib, candidate, delta, v AS temperature, exp((min(d2) OVER (PARTITION BY f, i, delta) - d2) / (2 * v)) AS e FROM dist, {_list(A.TEMPERATURES)}),
loss AS (SELECT f, i, delta, temperature, -ln(greatest(coalesce(sum(e) FILTER (candidate = ib), 0) / sum(e), {A.LEAST_P}::DOUBLE)) AS l FROM ex GROUP BY ALL),
tried AS (SELECT f, delta, temperature, round(avg(l), 9) AS nll FROM loss GROUP BY ALL),
best AS (SELECT f, delta, temperature FROM tried QUALIFY row_number() OVER (PARTITION BY f ORDER BY nll, delta, temperature) = 1),
few AS (SELECT f, count(DISTINCT sample_id) < 3 OR count(DISTINCT batch) < 2 AS few FROM feat GROUP BY f),
tuned AS (SELECT f, CASE WHEN few THEN {A.SHRINKAGES[0]}::DOUBLE ELSE delta END AS delta, CASE WHEN few THEN {sorted(A.TEMPERATURES)[len(A.TEMPERATURES) // 2]}::DOUBLE ELSE temperature END AS temperature
          FROM few LEFT JOIN best USING (f)),
cen1 AS (SELECT f, batch AS candidate, kpi, median(x) AS m FROM feat GROUP BY ALL),
mid1 AS (SELECT f, kpi, median(m) AS g FROM cen1 GROUP BY ALL),
strip AS ({_STRIP_FACTS}),
asked AS (
  SELECT sample_id AS f, -1 AS strip, kpi, value FROM facts
  UNION ALL SELECT t.sample_id, strip, t.kpi, facts.value + t.value - avg(t.value) OVER (PARTITION BY t.sample_id, t.kpi) FROM strip t JOIN facts ON facts.sample_id = t.sample_id AND facts.kpi = t.kpi),
d1 AS (SELECT asked.f, strip, candidate, temperature, sum(((value - med) / scale * {_WEIGHT.replace("kpi", "asked.kpi")} - ({_DRAWN.format("delta")})) ** 2) AS d2
       FROM asked JOIN s ON s.f = asked.f AND s.kpi = asked.kpi JOIN cen1 ON cen1.f = asked.f AND cen1.kpi = asked.kpi JOIN mid1 ON mid1.f = asked.f AND mid1.kpi = asked.kpi
       JOIN tuned ON tuned.f = asked.f GROUP BY ALL),
p1 AS (SELECT f, strip, candidate, exp(-d2 / (2 * temperature)) / sum(exp(-d2 / (2 * temperature))) OVER (PARTITION BY f, strip) AS p FROM d1),
top AS (SELECT f, strip, candidate AS assigned, p FROM p1 QUALIFY row_number() OVER (PARTITION BY f, strip ORDER BY round(p, 9) DESC, candidate) = 1),
agree AS (SELECT a.f, avg((a.assigned = b.assigned)::INT) AS strip_agreement FROM top a JOIN top b ON a.f = b.f AND b.strip = -1 WHERE a.strip >= 0 GROUP BY a.f),
z AS (SELECT sample_id AS f, abs((value - med) / scale) AS z FROM facts JOIN s ON s.f = sample_id AND s.kpi = facts.kpi),
verdict AS (SELECT f, CASE WHEN count(*) FILTER (z > 12.8) > 0 OR count(*) FILTER (z > 8) >= 3 THEN 'REJECT'
                      WHEN count(*) FILTER (z > 8) > 0 OR count(*) FILTER (z > 6.4) >= 2 THEN 'INVESTIGATE' ELSE 'ACCEPT' END AS decision FROM z GROUP BY f),
rows AS (SELECT f AS sample_id, own AS batch, delta, temperature, assigned, p AS p_top, strip_agreement, decision
         FROM fold JOIN tuned USING (f) JOIN (SELECT * FROM top WHERE strip = -1) USING (f) LEFT JOIN agree USING (f) JOIN verdict USING (f))"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "nested_tuning": _SQL + " SELECT sample_id, batch, delta, temperature, assigned, round(p_top, 6) AS p_top, round(strip_agreement, 6) AS strip_agreement, decision FROM rows",
        "nested_summary": _SQL
        + f""",
pt AS (SELECT f AS sample_id, coalesce(sum(p) FILTER (candidate = own), 0) AS pt, sum(p * p) AS pp FROM p1 JOIN fold USING (f) WHERE strip = -1 GROUP BY f)
SELECT count(*) AS n, round(avg((assigned = batch)::INT), 6) AS accuracy, round(avg(-ln(greatest(pt, {A.LEAST_P}::DOUBLE))), 6) AS nll, round(avg(pp - pt * pt + (1 - pt) ** 2), 6) AS brier,
       count(*) FILTER (batch = 3 AND decision <> 'ACCEPT') AS false_alarms, count(*) FILTER (batch = 3) AS n_baseline,
       count(*) FILTER (batch <> 3 AND decision <> 'ACCEPT') AS detections, count(*) FILTER (batch <> 3) AS n_other, round(avg(strip_agreement), 6) AS strip_consistency
FROM rows JOIN pt USING (sample_id)""",
    }
