"""Queries of raster and particle operators, with DuckDB counterparts. The raster has a row for each embedding and a
column for each dimension; positive values are set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import facts as X
from lamina.operators import grid as G
from lamina.plans.baseline_queries import rounded


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    return rows.select("row", F.col("col").cast("long").alias("col"), (F.col("x") > 0).alias("on"))


def chords_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chords(pixels(spark, sf_dir), "row", "col")


def chords_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chords(pixels(spark, sf_dir), "col", "row")


def phase_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.fractions(pixels(spark, sf_dir), ["col"]), "fraction")


def quadrat_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.quadrat_cv(pixels(spark, sf_dir), 16, 16), "mean", "cv")


def vertical_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.band_slope(pixels(spark, sf_dir)), "slope", "intercept", digits=10)


def block_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.block_majority(pixels(spark, sf_dir))


def euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.euler_number(pixels(spark, sf_dir))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.component_sizes(G.components(pixels(spark, sf_dir)))


def percolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pixels(spark, sf_dir)
    ends = own.agg(F.max("row"), F.max("col")).first()
    return rounded(G.percolation(components(spark, sf_dir), (ends[0] or 0) + 1, (ends[1] or 0) + 1), "across", "down")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two dimensions of each embedding, in thousandths, so that distances are exact."""
    at = [F.round(F.col("embedding")[k].cast("double") * 1000).alias(n) for k, n in ((0, "x"), (1, "y"))]
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *at)


def clark_evans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.clark_evans(_points(spark, sf_dir), 1e6, 4e3, 20.0), "mean_d", "r")


def binned_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.binned_median(X.table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_brand"], "p_size"), "value")


def weighted_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.weighted_histogram(X.table(spark, sf_dir, "lineitem"), "l_quantity", "l_quantity", 1.0, 50.0, 20), "total")


def queries() -> dict:
    return {f.__name__: f for f in (chords_h, chords_v, phase_fraction, quadrat_cv, vertical_slope, block_majority, euler, components, percolation, clark_evans, binned_median, weighted_hist)}


_PIXELS = "WITH RECURSIVE px AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding) > 0 AS p FROM embeddings)"


def _chords(line: str, at: str, name: str) -> str:
    return (
        _PIXELS
        + f""", g AS (SELECT {line} AS l, {at} AS a, {at} - row_number() OVER (PARTITION BY {line} ORDER BY {at}) AS k FROM px WHERE p)
SELECT l AS "{name}", min(a) AS first, count(*) AS length FROM g GROUP BY l, k
HAVING min(a) > 0 AND max(a) < (SELECT max({at}) FROM px)"""
    )


_COMPONENTS = (
    _PIXELS
    + """,
g AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS k FROM px WHERE p),
runs AS (SELECT r, min(c) AS a, max(c) AS b, r * 4294967296 + min(c) AS node FROM g GROUP BY r, k),
e AS (SELECT x.node AS u, y.node AS v FROM runs x JOIN runs y ON abs(x.r - y.r) = 1 AND x.a <= y.b AND y.a <= x.b),
reach(node, label) AS (SELECT node, node FROM runs UNION SELECT e.v, reach.label FROM reach JOIN e ON e.u = reach.node WHERE reach.label < e.v),
lab AS (SELECT node, min(label) AS component FROM reach GROUP BY node),
sizes AS (SELECT component, count(*) AS n_runs, sum(b - a + 1)::BIGINT AS n_pixels, min(r) AS top, max(r) AS bottom, min(a) AS "left", max(b) AS "right"
          FROM lab JOIN runs USING (node) GROUP BY component)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "chords_h": _chords("r", "c", "row"),
        "chords_v": _chords("c", "r", "col"),
        "phase_fraction": _PIXELS + " SELECT c AS col, count(*) AS n, round(avg(p::INT), 8) AS fraction FROM px GROUP BY c",
        "quadrat_cv": _PIXELS + ", q AS (SELECT avg(p::INT) AS f FROM px GROUP BY r // 16, c // 16 HAVING count(*) = 256) SELECT count(*) AS n, round(avg(f), 8) AS mean, round(stddev_pop(f) / nullif(avg(f), 0), 8) AS cv FROM q",
        "vertical_slope": _PIXELS
        + """, h AS (SELECT max(r) + 1 AS h FROM px),
b AS (SELECT k, avg(p::INT) AS f FROM px, h, (SELECT unnest(range(5)) AS k) WHERE r >= k * h // 5 AND r < (k + 1) * h // 5 GROUP BY k)
SELECT round(regr_slope(f, k::DOUBLE), 10) AS slope, round(regr_intercept(f, k::DOUBLE), 10) AS intercept FROM b""",
        "block_majority": _PIXELS + " SELECT r // 4 AS br, c // 4 AS bc, (CASE WHEN 2 * sum(p::INT) > count(*) THEN 1 WHEN 2 * sum(p::INT) = count(*) THEN 3 ELSE 0 END)::BIGINT AS label FROM px GROUP BY ALL",
        "euler": _PIXELS
        + """, o AS (SELECT r, c FROM px WHERE p)
SELECT (SELECT count(*) FROM o) - (SELECT count(*) FROM o a JOIN o b ON a.r = b.r AND b.c = a.c + 1) - (SELECT count(*) FROM o a JOIN o b ON a.c = b.c AND b.r = a.r + 1)
     + (SELECT count(*) FROM o a JOIN o b ON a.r = b.r AND b.c = a.c + 1 JOIN o d ON d.r = a.r + 1 AND d.c = a.c JOIN o f ON f.r = a.r + 1 AND f.c = a.c + 1) AS euler""",
        "components": _COMPONENTS + " SELECT * FROM sizes",
        "percolation": _COMPONENTS
        + """ SELECT sum(n_pixels)::BIGINT AS n_pixels,
round(coalesce(sum(n_pixels) FILTER ("left" = 0 AND "right" = (SELECT max(c) FROM px)), 0) / sum(n_pixels)::DOUBLE, 8) AS across,
round(coalesce(sum(n_pixels) FILTER (top = 0 AND bottom = (SELECT max(r) FROM px)), 0) / sum(n_pixels)::DOUBLE, 8) AS down FROM sizes""",
        "clark_evans": """
WITH p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y FROM embeddings),
d AS (SELECT a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id),
s AS (SELECT count(*) AS n, avg(d) AS m FROM d)
SELECT n, round(m, 8) AS mean_d, round(CASE WHEN n >= 5 THEN m / (0.5::DOUBLE * sqrt(1e6 / n) + (0.0514::DOUBLE + 0.041::DOUBLE / sqrt(n)) * 4e3 / n) END, 8) AS r FROM s""",
        "binned_median": """
WITH l AS (SELECT p_brand, p_size::DOUBLE AS v, count(*) AS c FROM part GROUP BY ALL),
w AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b, sum(c) OVER o / sum(c) OVER (PARTITION BY p_brand)::DOUBLE AS s FROM l WINDOW o AS (PARTITION BY p_brand ORDER BY v)),
z AS (SELECT p_brand, coalesce((a + v) / 2, v - (b - v) / 2, v) AS lo, coalesce((v + b) / 2, v + (v - a) / 2, v) AS hi,
             coalesce(lag(s) OVER (PARTITION BY p_brand ORDER BY v), 0) AS s0, s FROM w)
SELECT p_brand, round(lo + (0.5 - s0) / (s - s0) * (hi - lo), 8) AS value FROM z WHERE s >= 0.5 AND s0 < 0.5""",
        "weighted_hist": "SELECT least(floor((l_quantity - 1) / (49 / 20.0::DOUBLE)), 19)::BIGINT AS bin, round(sum(l_quantity), 8) AS total FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1",
    }
