"""Queries of batch assignment, with DuckDB counterparts. Samples are embeddings (label as batch, dimensions as
indicators) or suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.bootstrap import literal
from lamina.operators import assign as A
from lamina.operators import baseline as B
from lamina.operators import facts as X
from lamina.plans.baseline_queries import _FLOOR, STATS, rounded

DELTA, TEMPERATURE = 0.02, 2.0


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sample_id, batch, kpi, x` of the embeddings."""
    rows = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("batch"), F.posexplode("embedding").alias("kpi", "x"))
    return rows.withColumns({"kpi": F.col("kpi").cast("long"), "x": F.col("x").cast("double")})


def shrunken_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.centroids(vectors(spark, sf_dir), DELTA), "c")


def softmax_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    chances = A.softmax(A.distances(rows, A.centroids(rows, DELTA)), F.lit(TEMPERATURE), ["sample_id"])
    return rounded(A.best(chances, ["sample_id"]).select("sample_id", "batch", F.col("candidate").alias("assigned"), "d", "p"), "d", "p")


def grid_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.tuning(vectors(spark, sf_dir)), "delta", "temperature", "nll", "accuracy")


def within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.within_distances(vectors(spark, sf_dir), DELTA), "d")


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    nearest = A.distances(rows, A.centroids(rows, DELTA)).groupBy("sample_id").agg(F.min("d").alias("dmin"))
    return rounded(A.novelty(nearest, A.within_distances(rows, DELTA)), "dmin", "id_score")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts(spark, sf_dir)
    return rounded(A.signatures(facts, B.baseline(facts)), "effect", "stability")


def signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts(spark, sf_dir)
    stats = B.baseline(facts)
    loose = A.signatures(facts, stats).withColumn("in_signature", F.abs("effect") >= 0.1)  # regions hardly differ
    return rounded(A.signature_match(B.zscores(facts, stats), loose), "match")


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.facts(spark, sf_dir)
    loose = A.signatures(facts, B.baseline(facts)).withColumn("in_signature", F.abs("effect") >= 0.1)
    return rounded(A.jaccard(loose), "overlap")


def strip_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a sample's strips that are assigned to the batch of the whole sample."""
    facts = X.facts(spark, sf_dir)
    stats = B.baseline(facts)
    rows = A.features(B.zscores(facts, stats))
    strips = B.zscores(X.strip_facts(spark, sf_dir), stats).select("sample_id", "strip", "kpi", F.coalesce(F.col("z") * X.weight(F.col("kpi")), F.lit(0.0)).alias("x"))
    centres = A.centroids(rows, 0.0)
    whole = A.best(A.softmax(A.distances(rows, centres), F.lit(TEMPERATURE), ["sample_id"]), ["sample_id"]).select("sample_id", F.col("candidate").alias("assigned"), F.col("p").alias("p_top"))
    moved = A.strip_vectors(rows, strips).withColumn("batch", F.col("strip"))
    each = A.best(A.softmax(A.distances(moved, centres), F.lit(TEMPERATURE), ["sample_id", "batch"]), ["sample_id", "batch"])
    share = each.join(whole, "sample_id").groupBy("sample_id", "assigned", "p_top").agg(F.avg((F.col("candidate") == F.col("assigned")).cast("double")).alias("strip_agreement"))
    return rounded(share.withColumn("confidence", A.confidence(F.col("p_top"), F.col("strip_agreement"))), "p_top", "strip_agreement")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's batch with its label by the stability of bootstrap means, and its novelty with the signatures' rules.
    `bootstrap_stability` and `novelty` are the parts that have SQL."""
    facts = X.facts(spark, sf_dir)
    stats = B.baseline(facts)
    scored = B.zscores(facts, stats)
    rows = A.features(scored)
    strips = B.zscores(X.strip_facts(spark, sf_dir), stats).select("sample_id", "strip", "kpi", F.coalesce(F.col("z") * X.weight(F.col("kpi")), F.lit(0.0)).alias("x"))
    centres = A.centroids(rows, 0.0)
    measured = A.distances(rows, centres)
    whole = A.best(A.softmax(measured, F.lit(TEMPERATURE), ["sample_id"]), ["sample_id"]).select("sample_id", F.col("candidate").alias("assigned"), F.col("p").alias("p_top"))
    steady = A.stability(A.strip_vectors(rows, strips), centres, whole)
    signs = A.signatures(facts, stats)
    matches = A.signature_match(scored, signs)
    found = A.novelty(measured.groupBy("sample_id").agg(F.min("d").alias("dmin")), A.within_distances(rows, 0.0))
    novel = A.novelty_by_signature(found, whole, matches, A.new_way(scored, signs, matches))
    out = whole.join(steady, "sample_id", "left").join(novel, "sample_id")
    return rounded(out.withColumn("confidence", A.confidence(F.col("p_top"), F.col("stability"))), "p_top", "stability", "dmin", "id_score")


def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's batch with the share of bootstrap means of its strips that keep it, and the label that follows."""
    facts = X.facts(spark, sf_dir)
    stats = B.baseline(facts)
    rows = A.features(B.zscores(facts, stats))
    strips = B.zscores(X.strip_facts(spark, sf_dir), stats).select("sample_id", "strip", "kpi", F.coalesce(F.col("z") * X.weight(F.col("kpi")), F.lit(0.0)).alias("x"))
    centres = A.centroids(rows, 0.0)
    whole = A.best(A.softmax(A.distances(rows, centres), F.lit(TEMPERATURE), ["sample_id"]), ["sample_id"]).select("sample_id", F.col("candidate").alias("assigned"), F.col("p").alias("p_top"))
    out = whole.join(A.stability(A.strip_vectors(rows, strips), centres, whole), "sample_id")
    return rounded(out.withColumn("confidence", A.confidence(F.col("p_top"), F.col("stability"))), "p_top", "stability")


def queries() -> dict:
    return {f.__name__: f for f in (bootstrap_stability, shrunken_centroids, softmax_assign, grid_tune, within_distance, novelty, signatures, signature_match, jaccard, strip_agreement, assignment)}


_VECTORS = """
WITH rows AS (SELECT vec_id AS sample_id, label::BIGINT AS batch, generate_subscripts(embedding, 1) - 1 AS kpi, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
_CENTRES = (
    _VECTORS
    + f""",
raw AS (SELECT batch, kpi, median(x) AS m FROM rows GROUP BY ALL),
mid AS (SELECT kpi, median(m) AS g FROM raw GROUP BY kpi),
centres AS (SELECT batch, kpi, g + sign(m - g) * greatest(abs(m - g) - {DELTA}::DOUBLE, 0) AS c FROM raw JOIN mid USING (kpi)),
dist AS (SELECT sample_id, r.batch, c.batch AS candidate, sqrt(sum((x - c) ** 2)) AS d FROM rows r JOIN centres c USING (kpi) GROUP BY ALL),
soft AS (SELECT *, exp(-d * d / (2 * {TEMPERATURE})) / sum(exp(-d * d / (2 * {TEMPERATURE}))) OVER (PARTITION BY sample_id) AS p FROM dist)"""
)


def _refit(deltas: str) -> str:
    return (
        _VECTORS
        + f""",
ids AS (SELECT DISTINCT sample_id AS out_id, batch AS own FROM rows),
plain AS (SELECT batch, kpi, median(x) AS m FROM rows GROUP BY ALL),
gone AS (SELECT out_id, kpi, median(x) AS m FROM ids JOIN rows ON batch = own AND sample_id <> out_id GROUP BY ALL),
raw AS (SELECT out_id, own, p.batch AS candidate, p.kpi, CASE WHEN p.batch = own THEN g.m ELSE p.m END AS m
        FROM ids CROSS JOIN plain p LEFT JOIN gone g USING (out_id, kpi)),
live AS (SELECT *, median(m) OVER (PARTITION BY out_id, kpi) AS g FROM raw WHERE m IS NOT NULL),
dist AS (SELECT out_id AS sample_id, own AS batch, delta, candidate,
                sqrt(sum((x - (g + sign(m - g) * greatest(abs(m - g) - delta, 0))) ** 2)) AS d
         FROM live JOIN rows r ON r.sample_id = out_id AND r.kpi = live.kpi, (SELECT unnest({deltas}::DOUBLE[]) AS delta) GROUP BY ALL)"""
    )


_SIGNS = (
    STATS
    + f""",
eff AS (SELECT batch, kpi, (median(value) - any_value(med)) / any_value(scale) AS effect FROM facts JOIN stats USING (kpi) WHERE batch <> 3 GROUP BY batch, kpi),
ids AS (SELECT DISTINCT sample_id AS out_id FROM facts),
lc AS (SELECT out_id, kpi, median(value) AS med, coalesce(median(se), 0) AS wse FROM ids JOIN facts ON sample_id <> out_id AND batch = 3 GROUP BY ALL),
ls AS (SELECT out_id, kpi, any_value(c.med) AS med, greatest(1.4826::DOUBLE * median(abs(value - c.med)), any_value(wse), 0.05::DOUBLE * abs(any_value(c.med)), {_FLOOR}) AS scale
       FROM facts JOIN lc c USING (kpi) WHERE sample_id <> out_id AND batch = 3 GROUP BY out_id, kpi),
lb AS (SELECT out_id, batch, kpi, median(value) AS mid FROM ids JOIN facts ON sample_id <> out_id AND batch <> 3 GROUP BY ALL),
st AS (SELECT e.batch, e.kpi, any_value(effect) AS effect,
              count(*) FILTER (sign((mid - med) / scale) = sign(effect) AND abs((mid - med) / scale) > 1) / (SELECT count(*) FROM ids)::DOUBLE AS stability
       FROM eff e JOIN lb ON lb.batch = e.batch AND lb.kpi = e.kpi JOIN ls ON ls.out_id = lb.out_id AND ls.kpi = e.kpi GROUP BY e.batch, e.kpi)"""
)
_WEIGHT = "CASE WHEN kpi IN ('qty_mean', 'price_mean', 'unit_price_mean') THEN 1.0 WHEN kpi = 'open_frac' THEN 0.4 ELSE 0.7 END::DOUBLE"


def oracle_sql() -> dict[str, str]:
    out = _definitions()
    parts = out["strip_agreement"].split("\nsd AS (")[0].rstrip(",")
    out["bootstrap_stability"] = (
        parts
        + f""",
pv AS (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY strip) - 1 AS pos FROM sv),
pn AS (SELECT sample_id, max(pos) + 1 AS n FROM pv GROUP BY sample_id),
mean AS (SELECT sample_id, kpi, b, sum(times * x) / n AS m FROM pv JOIN pn USING (sample_id) JOIN {literal(X.STRIPS)} d USING (n, pos) GROUP BY sample_id, kpi, b, n),
far AS (SELECT sample_id, b, candidate, round(sum((m - c) ** 2), 9) AS e FROM mean JOIN raw USING (kpi) GROUP BY ALL),
call AS (SELECT sample_id, b, (list(candidate ORDER BY e, candidate))[1] AS call FROM far GROUP BY ALL),
st AS (SELECT sample_id, assigned, p_top, avg((call = assigned)::INT) AS s FROM call JOIN top USING (sample_id) GROUP BY ALL)
SELECT sample_id, assigned, round(p_top, 8) AS p_top, round(s, 8) AS stability,
       CASE WHEN p_top >= 0.75 AND s >= 0.8 THEN 'confident' WHEN p_top >= 0.5 THEN 'moderately confident' ELSE 'low confidence' END AS confidence FROM st"""
    )
    return out


def _definitions() -> dict[str, str]:
    best = "row_number() OVER (PARTITION BY sample_id ORDER BY round(p, 9) DESC, candidate)"
    return {
        "shrunken_centroids": _CENTRES + " SELECT batch, kpi, round(c, 8) AS c FROM centres",
        "softmax_assign": _CENTRES + f" SELECT sample_id, batch, candidate AS assigned, round(d, 8) AS d, round(p, 8) AS p FROM (SELECT *, {best} AS r FROM soft) WHERE r = 1",
        "grid_tune": _refit("[0, 0.25, 0.5, 1]")
        + """,
soft AS (SELECT *, exp(-d * d / (2 * t)) / sum(exp(-d * d / (2 * t))) OVER (PARTITION BY sample_id, delta, t) AS p
         FROM dist, (SELECT unnest([0.5, 1, 2, 4, 8]::DOUBLE[]) AS t)),
each AS (SELECT sample_id, batch, delta, t, coalesce(max(p) FILTER (candidate = batch), 0) AS pt, (list(candidate ORDER BY round(p, 9) DESC, candidate))[1] AS top FROM soft GROUP BY ALL)
SELECT round(delta, 8) AS delta, round(t, 8) AS temperature, round(avg(-ln(greatest(pt, 0.001::DOUBLE))), 8) AS nll, round(avg((top = batch)::INT), 8) AS accuracy FROM each GROUP BY delta, t""",
        "within_distance": _refit(f"[{DELTA}]") + " SELECT sample_id, batch, round(d, 8) AS d FROM dist WHERE candidate = batch",
        "novelty": _refit(f"[{DELTA}]").replace("dist AS", "ref AS")
        + f""",
mid AS (SELECT kpi, median(m) AS g FROM plain GROUP BY kpi),
near AS (SELECT sample_id, min(d) AS dmin FROM (SELECT sample_id, p.batch, sqrt(sum((x - (g + sign(m - g) * greatest(abs(m - g) - {DELTA}::DOUBLE, 0))) ** 2)) AS d
         FROM rows r JOIN plain p USING (kpi) JOIN mid USING (kpi) GROUP BY ALL) GROUP BY sample_id),
w AS (SELECT d FROM ref WHERE candidate = batch)
SELECT sample_id, round(dmin, 8) AS dmin, round(1 - (SELECT count(*) FROM w WHERE d <= dmin) / ((SELECT count(*) FROM w) + 1)::DOUBLE, 8) AS id_score,
       CASE WHEN (SELECT count(*) FROM w) >= 40 THEN dmin > (SELECT quantile_cont(d, 0.975) FROM w) ELSE dmin > 1.25 * (SELECT max(d) FROM w) END AS novel
FROM near""",
        "signatures": _SIGNS + " SELECT batch, kpi, round(effect, 8) AS effect, round(stability, 8) AS stability, abs(effect) >= 1.5 AND stability >= 0.8 AS in_signature FROM st",
        "signature_match": _SIGNS
        + f""" SELECT s.sample_id, e.batch AS signature, round(sum(w * sign(effect) * z) / sum(w), 8) AS match, count(*) FILTER (sign(effect) * z > 1) AS n_matched
FROM (SELECT *, {_WEIGHT} AS w FROM scored WHERE z IS NOT NULL) s JOIN eff e USING (kpi) WHERE abs(effect) >= 0.1 GROUP BY s.sample_id, e.batch""",
        "jaccard": _SIGNS
        + """, sets AS (SELECT batch, coalesce(list(kpi || ':' || sign(effect)::INT) FILTER (abs(effect) >= 0.1), []) AS s FROM eff GROUP BY batch)
SELECT a.batch AS a, b.batch AS b, round(CASE WHEN len(list_distinct(a.s || b.s)) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s))::DOUBLE END, 8) AS overlap
FROM sets a JOIN sets b ON a.batch < b.batch""",
        "strip_agreement": STATS
        + f""",
feat AS (SELECT sample_id, batch, kpi, coalesce(z * {_WEIGHT}, 0) AS x FROM scored),
raw AS (SELECT batch AS candidate, kpi, median(x) AS c FROM feat GROUP BY ALL),
sl AS (SELECT sample_id, strip, unnest(['qty_mean', 'price_mean', 'unit_price_mean', 'discount_mean', 'returned_frac', 'open_frac']) AS kpi,
              unnest([avg(l_quantity), avg(l_extendedprice), avg(l_extendedprice / l_quantity), avg(l_discount), avg((l_returnflag = 'R')::INT), avg((l_linestatus = 'O')::INT)]) AS v
       FROM lines GROUP BY sample_id, strip),
sx AS (SELECT sample_id, strip, kpi, (v - med) / scale * {_WEIGHT} AS s FROM sl JOIN stats USING (kpi)),
sv AS (SELECT sample_id, strip, kpi, x + s - avg(s) OVER (PARTITION BY sample_id, kpi) AS x FROM sx JOIN feat USING (sample_id, kpi)),
wd AS (SELECT sample_id, candidate, sum((x - c) ** 2) AS e FROM feat JOIN raw USING (kpi) GROUP BY ALL),
wp AS (SELECT *, exp(-e / 4) / sum(exp(-e / 4)) OVER (PARTITION BY sample_id) AS p FROM wd),
top AS (SELECT sample_id, candidate AS assigned, p AS p_top FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(p, 9) DESC, candidate) AS r FROM wp) WHERE r = 1),
sd AS (SELECT sample_id, strip, candidate, sum((x - c) ** 2) AS e FROM sv JOIN raw USING (kpi) GROUP BY ALL),
sc AS (SELECT sample_id, strip, candidate FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, strip ORDER BY e, candidate) AS r FROM sd) WHERE r = 1),
sh AS (SELECT sample_id, assigned, p_top, avg((candidate = assigned)::INT) AS a FROM sc JOIN top USING (sample_id) GROUP BY ALL)
SELECT sample_id, assigned, round(p_top, 8) AS p_top, round(a, 8) AS strip_agreement,
       CASE WHEN p_top >= 0.75 AND a >= 0.8 THEN 'confident' WHEN p_top >= 0.5 THEN 'moderately confident' ELSE 'low confidence' END AS confidence FROM sh""",
    }
