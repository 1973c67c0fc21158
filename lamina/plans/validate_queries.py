"""Queries of validation and regression, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import facts as X
from lamina.operators import validate as V
from lamina.plans.assign_queries import _WEIGHT
from lamina.plans.baseline_queries import _FLOOR, FACTS, STATS, rounded

BATCHES = [1, 2, 3]
SPLIT = "1996-01-01"
RANGES = {"qty_mean": (24.0, 27.0), "discount_mean": (0.045, 0.055), "returned_frac": (0.2, 0.3)}


def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.effect_sizes(X.facts(spark, sf_dir)), "median_a", "median_b", "effect")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.facts(spark, sf_dir).groupBy("sample_id", "batch").pivot("kpi", ["qty_mean", "price_mean"]).agg(F.first("value"))
    return rounded(V.spearman(wide, ["batch"], "qty_mean", "price_mean"), "rho")


def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.kruskal(X.facts(spark, sf_dir).where(F.col("batch").isin(BATCHES))), "h", "p")


def confound_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = X.facts(spark, sf_dir, X.GATES).where("kpi = 'tax_mean'")
    return rounded(V.kruskal(V.shared_range(X.facts(spark, sf_dir), gate, BATCHES)), "h", "p")


def nested_loio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.nested_loio(X.facts(spark, sf_dir)), "p")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confusion(V.nested_loio(X.facts(spark, sf_dir)))


def nll_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.likelihood(V.nested_loio(X.facts(spark, sf_dir))), "nll", "brier", "accuracy", "majority")


def shadow_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out chances from acquisition gates alone: what covariates would explain."""
    gates = X.facts(spark, sf_dir, X.GATES).withColumn("se", F.lit(None).cast("double"))
    return V.confusion(V.nested_loio(gates))


def _order_facts(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """Facts of customers from their orders, as a snapshot."""
    orders = X.table(spark, sf_dir, "orders").where(where)
    means = orders.groupBy(F.col("o_custkey").alias("sample_id")).agg(F.avg("o_totalprice").alias("price_mean"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("filled_frac"))
    return means.unpivot(["sample_id"], ["price_mean", "filled_frac"], "kpi", "value")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _order_facts(spark, sf_dir, f"o_orderdate < TIMESTAMP '{SPLIT}'")
    new = _order_facts(spark, sf_dir, "true")
    from lamina.functions.robust import robust_stats

    stats = robust_stats(new, ["kpi"], se=None)
    out = V.snapshot_diff(old, new, stats, F.col("kpi") == "filled_frac")
    return rounded(out, "old", "new", "delta_scale", "rel")


def snapshot_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.membership(_order_facts(spark, sf_dir, f"o_orderdate < TIMESTAMP '{SPLIT}'"), _order_facts(spark, sf_dir, f"o_orderdate >= TIMESTAMP '{SPLIT}'"))


def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.plausibility(X.facts(spark, sf_dir), RANGES), "value", "lo", "hi")


def score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chances = V.nested_loio(X.facts(spark, sf_dir)).select("sample_id", F.col("candidate").cast("string").alias("c"), "p")
    top = F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("c").cast("long")).alias("c")))
    predicted = chances.groupBy("sample_id").agg(top.alias("top"), F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("chances"))
    predictions = predicted.select("sample_id", (-F.col("top.c")).cast("string").alias("assigned"), (F.col("top.p") < 0.25).alias("novel"), "chances")
    truth = X.samples(spark, sf_dir).select("sample_id", F.when(F.col("batch") == 4, "none").otherwise(F.col("batch").cast("string")).alias("truth"))
    return rounded(V.score_predictions(predictions, truth), "p_truth")


def queries() -> dict:
    return {f.__name__: f for f in (effect_size, spearman, kruskal_h, confound_separation, nested_loio, confusion, nll_brier, shadow_classifier, snapshot_diff, snapshot_membership, plausibility, score_predictions)}


def _kruskal(rows: str) -> str:
    return f"""
r AS (SELECT kpi, batch, value, rank() OVER (PARTITION BY kpi ORDER BY value) + (count(*) OVER (PARTITION BY kpi, value) - 1) / 2.0::DOUBLE AS k FROM {rows} WHERE value IS NOT NULL),
g AS (SELECT kpi, sum(k) AS s, count(*) AS m FROM r GROUP BY kpi, batch),
t AS (SELECT kpi, sum(c ** 3 - c) AS t FROM (SELECT kpi, count(*)::DOUBLE AS c FROM r GROUP BY kpi, value) GROUP BY kpi),
h AS (SELECT kpi, sum(m)::BIGINT AS n, (12 / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1)) AS raw FROM g GROUP BY kpi)
SELECT kpi, n, round(raw / (1 - t / (n::DOUBLE ** 3 - n)), 8) AS h, round(exp(-raw / (1 - t / (n::DOUBLE ** 3 - n)) / 2), 8) AS p FROM h JOIN t USING (kpi)"""


def _nested(facts: str, floor: str, weight: str) -> str:
    return (
        facts
        + f""",
fold AS (SELECT DISTINCT sample_id AS out_id, batch AS own FROM facts),
train AS (SELECT out_id, own, f.* FROM fold JOIN facts f ON sample_id <> out_id),
c AS (SELECT out_id, kpi, median(value) AS med, coalesce(median(se), 0) AS wse FROM train WHERE batch = 3 GROUP BY ALL),
s AS (SELECT out_id, kpi, any_value(c.med) AS med, greatest(1.4826::DOUBLE * median(abs(value - c.med)), any_value(wse), 0.05::DOUBLE * abs(any_value(c.med)), {floor}) AS scale
      FROM train JOIN c USING (out_id, kpi) WHERE batch = 3 GROUP BY out_id, kpi),
x AS (SELECT out_id, batch, kpi, median((value - med) / scale * {weight}) AS m FROM train JOIN s USING (out_id, kpi) GROUP BY ALL),
d AS (SELECT f.sample_id, f.batch, x.batch AS candidate, sqrt(sum(((f.value - med) / scale * {weight} - m) ** 2)) AS d
      FROM facts f JOIN (SELECT out_id, kpi AS k2, med, scale FROM s) q ON q.out_id = f.sample_id AND q.k2 = f.kpi
           JOIN (SELECT out_id, kpi AS k3, batch, m FROM x) x ON x.out_id = f.sample_id AND x.k3 = f.kpi GROUP BY ALL),
soft AS (SELECT *, exp(-d * d / 4) / sum(exp(-d * d / 4)) OVER (PARTITION BY sample_id) AS p FROM d),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(p, 9) DESC, candidate) AS r FROM soft) WHERE r = 1)"""
    )


def _snap(where: str) -> str:
    return f"SELECT o_custkey AS sample_id, avg(o_totalprice) AS price_mean, avg((o_orderstatus = 'F')::INT) AS filled_frac FROM orders WHERE {where} GROUP BY o_custkey"


def oracle_sql() -> dict[str, str]:
    nested = _nested(FACTS, _FLOOR, _WEIGHT)
    gates = STATS[: STATS.index("WITH")] + "WITH " + _lines() + ",\n" + _gate_facts()
    kinds = "unnest(['price_mean', 'filled_frac']) AS kpi, unnest([price_mean, filled_frac]) AS value"
    return {
        "effect_size": FACTS
        + """,
c AS (SELECT batch, kpi, median(value) AS med, coalesce(median(se), 0) AS wse FROM facts GROUP BY ALL),
s AS (SELECT batch, kpi, any_value(med) AS med, greatest(1.4826::DOUBLE * median(abs(value - med)), any_value(wse), 0.05::DOUBLE * abs(any_value(med))) AS scale
      FROM facts JOIN c USING (batch, kpi) GROUP BY ALL)
SELECT a.batch AS a, b.batch AS b, kpi, round(a.med, 8) AS median_a, round(b.med, 8) AS median_b, round(abs(a.med - b.med) / sqrt((a.scale ** 2 + b.scale ** 2) / 2), 8) AS effect
FROM s a JOIN s b USING (kpi) WHERE a.batch < b.batch""",
        "spearman": FACTS
        + """,
w AS (SELECT sample_id, batch, max(value) FILTER (kpi = 'qty_mean') AS x, max(value) FILTER (kpi = 'price_mean') AS y FROM facts GROUP BY ALL),
r AS (SELECT batch, rank() OVER (PARTITION BY batch ORDER BY x) + (count(*) OVER (PARTITION BY batch, x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY batch ORDER BY y) + (count(*) OVER (PARTITION BY batch, y) - 1) / 2.0::DOUBLE AS ry FROM w)
SELECT batch, count(*) AS n, round(CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END, 8) AS rho FROM r GROUP BY batch""",
        "kruskal_h": FACTS + ", few AS (SELECT * FROM facts WHERE batch IN (1, 2, 3))," + _kruskal("few"),
        "confound_separation": FACTS
        + """,
gate AS (SELECT sample_id, batch, avg(l_tax) AS g FROM lines WHERE batch IN (1, 2, 3) GROUP BY ALL),
ends AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(g) AS lo, max(g) AS hi FROM gate GROUP BY batch)),
few AS (SELECT f.* FROM facts f JOIN gate USING (sample_id), ends WHERE g BETWEEN lo AND hi),"""
        + _kruskal("few"),
        "nested_loio": nested + " SELECT sample_id, batch, candidate, round(p, 8) AS p FROM soft",
        "confusion": nested + " SELECT batch, candidate, count(*) AS n FROM top GROUP BY ALL",
        "nll_brier": nested
        + """,
e AS (SELECT sample_id, batch, sum(p) FILTER (candidate = batch) AS pt, sum((p - (candidate = batch)::INT) ** 2) AS b FROM soft GROUP BY ALL)
SELECT count(*) AS n, round(avg(-ln(greatest(pt, 0.001::DOUBLE))), 8) AS nll, round(avg(b), 8) AS brier,
       round((SELECT avg((candidate = batch)::INT) FROM top), 8) AS accuracy,
       round((SELECT max(c) / sum(c)::DOUBLE FROM (SELECT count(*) AS c FROM e GROUP BY batch)), 8) AS majority FROM e""",
        "shadow_classifier": _nested(gates, _FLOOR, _GATE_WEIGHT) + " SELECT batch, candidate, count(*) AS n FROM top GROUP BY ALL",
        "snapshot_diff": f"""
WITH o AS ({_snap(f"o_orderdate < TIMESTAMP '{SPLIT}'")}), n AS ({_snap("true")}),
ol AS (SELECT sample_id, {kinds} FROM o), nl AS (SELECT sample_id, {kinds} FROM n),
c AS (SELECT kpi, median(value) AS med FROM nl GROUP BY kpi),
s AS (SELECT kpi, greatest(1.4826::DOUBLE * median(abs(value - med)), 0.05::DOUBLE * abs(any_value(med))) AS scale FROM nl JOIN c USING (kpi) GROUP BY kpi),
d AS (SELECT ol.sample_id, kpi, ol.value AS old, nl.value AS new, abs(nl.value - ol.value) AS size, scale FROM ol JOIN nl USING (sample_id, kpi) JOIN s USING (kpi))
SELECT sample_id, kpi, round(old, 8) AS old, round(new, 8) AS new, round(size / nullif(scale, 0), 8) AS delta_scale,
       round(CASE WHEN size = 0 THEN 0 ELSE size / nullif(abs(old), 0) END, 8) AS rel,
       coalesce(size / nullif(scale, 0) >= 0.1, false) OR (kpi = 'filled_frac' AND size > 0 AND (old = 0 OR size / nullif(abs(old), 0) >= 0.01)) AS changed FROM d""",
        "snapshot_membership": f"""
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}'), n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}')
SELECT o_custkey AS sample_id, 'new' AS status FROM n WHERE o_custkey NOT IN (FROM o)
UNION ALL SELECT o_custkey, 'missing' FROM o WHERE o_custkey NOT IN (FROM n)""",
        "plausibility": FACTS
        + """, r(kpi, lo, hi) AS (VALUES ('qty_mean', 24::DOUBLE, 27::DOUBLE), ('discount_mean', 0.045, 0.055), ('returned_frac', 0.2, 0.3))
SELECT sample_id, batch, kpi, round(value, 8) AS value, lo, hi, coalesce(value BETWEEN lo AND hi, false) AS ok FROM facts JOIN r USING (kpi)""",
        "score_predictions": nested
        + """,
tr AS (SELECT DISTINCT sample_id, CASE WHEN batch = 4 THEN 'none' ELSE batch::VARCHAR END AS truth FROM facts)
SELECT sample_id, truth, candidate::VARCHAR AS assigned, round((SELECT p FROM soft s WHERE s.sample_id = tr.sample_id AND s.candidate::VARCHAR = truth), 8) AS p_truth,
       CASE WHEN truth = 'none' THEN top.p < 0.25 ELSE candidate::VARCHAR = truth END AS correct
FROM tr JOIN top USING (sample_id)""",
    }


def _lines() -> str:
    from lamina.plans.baseline_queries import _LINES

    return _LINES


def _gate_facts() -> str:
    return """facts AS (SELECT sample_id, batch, 'tax_mean' AS kpi, avg(l_tax) AS value, NULL::DOUBLE AS se FROM lines GROUP BY ALL
UNION ALL SELECT sample_id, batch, 'line_number_mean', avg(l_linenumber::DOUBLE), NULL FROM lines GROUP BY ALL)"""


_GATE_WEIGHT = "0.7::DOUBLE"
