"""Queries of thickness, particle shapes and perturbed images, with DuckDB counterparts written from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.tables import stored
from lamina.operators import grey as Y
from lamina.operators import grid as G
from lamina.operators import particles as P
from lamina.operators import perturb as M
from lamina.operators import segment as S
from lamina.operators import thickness as T
from lamina.plans.baseline_queries import rounded
from lamina.plans.raster_queries import _PX, _STRIP, HEIGHT, HIGH, LOW, PIXEL_UM, STEP, WIDTH, _components, _erode, _labelled, _mask, pixels

#: The table's images are small, so thickness looks at each pixel, and particles of few pixels are measured.
FACTOR, LEAST = 1, 4


def local_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned median, mean and largest local thickness of pores and of the solid in micrometres; null where nothing bounds a
    phase, as in an image that lacks the other, or where there is none of it."""
    px = pixels(spark, sf_dir)
    each = T.both_sides(px.select(*Y.PLACE, Y.phases(LOW, HIGH)["pore"].alias("on")), FACTOR)
    each = stored(each.select("image", F.when(F.col("on"), "pore").otherwise("solid").alias("phase"), (F.col("t") * PIXEL_UM).alias("t")), "thickness")
    keys = ["image", "phase"]
    middle = G.binned_median(each.where("t IS NOT NULL"), keys, "t").withColumnRenamed("value", "d50")
    own = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean"), F.max("t").alias("most"))
    groups = px.select("image").distinct().withColumn("phase", F.explode(F.array(F.lit("pore"), F.lit("solid"))))
    return rounded(groups.join(own, keys, "left").join(middle, keys, "left").fillna({"n": 0}), "d50", "mean", "most", digits=6)


def _shapes(px: DataFrame) -> DataFrame:
    """The silicon particles of `px` with the deviation of the smoothed levels in their inside."""
    mask = stored(_mask(px, "si"), "silicon")
    runs = stored(_labelled(mask), "particles")
    own = P.shapes(runs, LEAST).withColumn("image", F.floor(F.col("component") / 2**32 / STEP))
    placed = runs.select("component", F.floor(F.col("row") / STEP).alias("image"), F.pmod("row", F.lit(STEP)).alias("r"), F.explode(F.sequence("first", "last")).alias("c"))
    smooth = Y.smoothed(px, HEIGHT, WIDTH).withColumn("s", F.round("s", S.DIGITS))
    texture = P.interior_spread(smooth, placed, Y.eroded(mask), Y.PLACE)
    return stored(own.join(texture.hint("merge"), "component", "left").withColumn("row", F.col("row") - F.col("image") * STEP), "shapes")


SHAPES = ["row", "col", "ecd", "aspect", "direction", "solidity", "circularity", "texture"]


def particle_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shapes(stored(pixels(spark, sf_dir), "pixels")), *SHAPES, digits=6).drop("component").withColumn("n", F.col("n").cast("long"))


def shape_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sized particles of each image and the medians of their shapes; texture in deviations of the noise."""
    px = stored(pixels(spark, sf_dir), "pixels")
    middle = [F.percentile(k, F.lit(0.5)).alias(k) for k in ("solidity", "aspect", "circularity", "texture")]
    own = _shapes(px).groupBy("image").agg(F.count(F.lit(1)).alias("n_sized"), *middle)
    noise = Y.noise(px, HEIGHT, WIDTH, LOW, HIGH)
    out = px.select("image").distinct().join(own, "image", "left").join(noise, "image", "left").fillna({"n_sized": 0})
    return rounded(out.withColumn("texture", F.col("texture") / F.greatest("noise_sd", F.lit(1e-6))).drop("noise_sd"), "solidity", "aspect", "circularity", "texture", digits=6)


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(M.histograms(pixels(spark, sf_dir), Y.strip_of(F.col("c"), WIDTH, 5)), "counts")
    return stored(M.perturbed(counts, LOW, HIGH), "perturbed")


def perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators and z-scores of each image under brightness, contrast and gamma, with their shift in baseline scales."""
    return rounded(_perturbed(spark, sf_dir), "value", "moved", "z", "z_moved", "shift", digits=6)


def perturbation_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst indicator of each image and change, and whether the verdict stays."""
    return rounded(M.robustness(_perturbed(spark, sf_dir)), "worst_shift", digits=6)


QUERIES = (local_thickness, particle_shapes, shape_kpis, perturbation, perturbation_robustness)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _thickness() -> str:
    radii = ", ".join(map(str, T.RADII))
    return (
        _PX
        + f""", ph AS (SELECT image, CASE WHEN g < {LOW} THEN 'pore' ELSE 'solid' END AS phase, r, c FROM px),
d AS (SELECT a.image, a.phase, a.r, a.c, min((a.r - b.r) ** 2 + (a.c - b.c) ** 2) AS d2 FROM ph a JOIN ph b ON b.image = a.image AND b.phase <> a.phase GROUP BY ALL),
q AS (SELECT *, (SELECT max(k) FROM (SELECT unnest([{radii}]) AS k) WHERE k * k <= d2) AS k FROM d),
y AS (SELECT image, phase, r, c, k, unnest(range(-k, k + 1)) AS dr FROM q WHERE k IS NOT NULL),
z AS (SELECT image, phase, r + dr AS r, c + dc AS c, max(k) AS k FROM (SELECT *, unnest(range(-k, k + 1)) AS dc FROM y) WHERE dr * dr + dc * dc <= k * k GROUP BY ALL),
t AS (SELECT ph.*, CASE WHEN d.r IS NOT NULL THEN coalesce(2 * z.k, 1) * {PIXEL_UM}::DOUBLE END AS t FROM ph LEFT JOIN d USING (image, phase, r, c) LEFT JOIN z USING (image, phase, r, c)),
lv AS (SELECT image, phase, t AS v, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL),
w AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b, sum(n) OVER o / sum(n) OVER (PARTITION BY image, phase)::DOUBLE AS s FROM lv WINDOW o AS (PARTITION BY image, phase ORDER BY v)),
bn AS (SELECT image, phase, coalesce((a + v) / 2, v - (b - v) / 2, v) AS lo, coalesce((v + b) / 2, v + (v - a) / 2, v) AS hi, coalesce(lag(s) OVER (PARTITION BY image, phase ORDER BY v), 0) AS s0, s FROM w),
m AS (SELECT image, phase, lo + (0.5::DOUBLE - s0) / (s - s0) * (hi - lo) AS d50 FROM bn WHERE s >= 0.5 AND s0 < 0.5)
SELECT image, phase, count(t.r) AS n, round(avg(t), 6) AS mean, round(max(t), 6) AS most, round(any_value(d50), 6) AS d50
FROM (SELECT DISTINCT image FROM px) CROSS JOIN (SELECT unnest(['pore', 'solid']) AS phase) LEFT JOIN t USING (image, phase) LEFT JOIN m USING (image, phase) GROUP BY image, phase"""
    )


def _shape() -> str:
    """Particles `sh` with all pairs of pixels as neighbours and all triples of the rows' outer corners for the hull."""
    return (
        _PX
        + f""", w AS (SELECT k, exp(-0.5::DOUBLE * (k / {Y.SIGMA}::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / {Y.SIGMA}::DOUBLE) ** 2)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS k)),
{_components(f"g >= {HIGH}")},
pp AS (SELECT image, component, r - image * {STEP} AS r, unnest(range(a, b + 1)) AS c FROM lab JOIN runs USING (node)),
big AS (SELECT * FROM pp WHERE component IN (SELECT component FROM pp GROUP BY component HAVING count(*) >= {LEAST})),
mo AS (SELECT image, component, count(*) AS n, avg(r) AS mr, avg(c) AS mc, var_pop(r) + 1 / 12.0::DOUBLE AS vr, var_pop(c) + 1 / 12.0::DOUBLE AS vc, covar_pop(r, c) AS cv FROM big GROUP BY ALL),
nb AS (SELECT a.component, count(*) FILTER (a.r = b.r OR a.c = b.c) AS st, count(*) FILTER (a.r <> b.r AND a.c <> b.c) AS sl FROM big a JOIN big b ON b.component = a.component AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY ALL),
kk AS (SELECT component, r + dr AS y, min(c) AS lo, max(c) + 1 AS hi FROM big, (VALUES (0), (1)) t(dr) GROUP BY ALL),
k AS (SELECT component, y, lo AS x FROM kk UNION ALL SELECT component, y, hi FROM kk),
ed AS (SELECT component, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) AS side, (q.x - p.x) * (o.x - p.x) + (q.y - p.y) * (o.y - p.y) AS along
       FROM k p JOIN k q USING (component) JOIN k o USING (component) WHERE p.x <> q.x OR p.y <> q.y),
hu AS (SELECT component, sum(px * qy - qx * py) / 2.0 AS hull FROM (
  SELECT component, px, py, qx, qy FROM ed GROUP BY ALL HAVING min(side) >= 0 AND count(*) FILTER (side = 0 AND along NOT BETWEEN 0 AND (qx - px) ** 2 + (qy - py) ** 2) = 0) GROUP BY component),
sg AS (SELECT image, r, c FROM px WHERE g >= {HIGH}), d5 AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dr, dc)), {_erode("inn", "sg")},
hz AS (SELECT p.image, p.r, p.c, sum(q.g * w) AS s FROM px p, w JOIN px q ON q.image = p.image AND q.r = p.r AND q.c = least(greatest(p.c + k, 0), {WIDTH - 1}) GROUP BY ALL),
sm AS (SELECT p.image, p.r, p.c, round(sum(q.s * w), {S.DIGITS}) AS s FROM hz p, w JOIN hz q ON q.image = p.image AND q.c = p.c AND q.r = least(greatest(p.r + k, 0), {HEIGHT - 1}) GROUP BY ALL),
tx AS (SELECT component, stddev_pop(s) AS texture FROM inn JOIN big USING (image, r, c) JOIN sm USING (image, r, c) GROUP BY component),
ax AS (SELECT *, (vr + vc) / 2 AS mid, sqrt(((vr - vc) / 2) ** 2 + cv ** 2) AS off FROM mo),
sh AS (SELECT image, component, n, mr AS row, mc AS col, 2 * sqrt(n / pi()) AS ecd, sqrt((mid + off) / (mid - off)) AS aspect, CASE WHEN round(off, 9) > 0 THEN degrees(0.5::DOUBLE * atan2(0.0::DOUBLE - 2 * round(cv, 9), vc - vr)) END AS direction,
        n / hull AS solidity, least(4 * pi() * n / (pi() / 8 * (4 * n - coalesce(st, 0) + (4 * n - coalesce(sl, 0)) / sqrt(2))) ** 2, 1.5) AS circularity, texture FROM ax JOIN hu USING (component) LEFT JOIN nb USING (component) LEFT JOIN tx USING (component))"""
    )


def _moved() -> str:
    """Indicators and their shift as `pe`, each change applied to each pixel."""
    levels = "SELECT image, r, c, 'own' AS change, g FROM px UNION ALL " + " UNION ALL ".join(
        f"SELECT image, r, c, '{name}', round_even(round(255 * pow(least(greatest(((g - m) * {k}::DOUBLE + m) * {b}::DOUBLE, 0), 255) / 255, {p}::DOUBLE), {M.DIGITS}), 0)::BIGINT FROM px JOIN me USING (image)" for name, (b, k, p) in M.CHANGES.items()
    )
    kpis = f"""count(*) FILTER (g >= {HIGH}) / greatest(count(*) FILTER (g >= {LOW}), 1)::DOUBLE AS si_frac_solid, avg((g >= {HIGH})::INT) AS si_frac_total,
avg((g < {LOW})::INT) AS pore_frac_deep, avg((abs(g - {LOW}) <= 4 OR abs(g - {HIGH}) <= 4)::INT) AS ambiguous_frac"""
    names = ", ".join(M.KPIS)
    return (
        _PX
        + f""", me AS (SELECT image, avg(g) AS m FROM px GROUP BY image), lv AS MATERIALIZED ({levels}),
wh AS (UNPIVOT (SELECT image, change, {kpis} FROM lv GROUP BY image, change) ON {names} INTO NAME kpi VALUE v),
st AS (UNPIVOT (SELECT image, {_STRIP} AS strip, {kpis} FROM px GROUP BY ALL) ON {names} INTO NAME kpi VALUE v),
se AS (SELECT image, kpi, CASE WHEN count(*) >= 2 THEN stddev_samp(v) / sqrt(count(*)) END AS se FROM st GROUP BY ALL),
ce AS (SELECT kpi, median(v) AS med, coalesce(median(se), 0) AS within FROM wh LEFT JOIN se USING (image, kpi) WHERE change = 'own' GROUP BY kpi),
sr AS (SELECT kpi, any_value(med) AS med, greatest(1.4826::DOUBLE * median(abs(v - med)), any_value(within), 0.05::DOUBLE * abs(any_value(med))) AS scale FROM wh JOIN ce USING (kpi) WHERE change = 'own' GROUP BY kpi),
sc AS (SELECT kpi, med, CASE WHEN scale > 0 THEN scale ELSE 1e-9::DOUBLE END AS scale FROM sr),
pe AS (SELECT a.image, a.change, kpi, o.v AS value, a.v AS moved, (o.v - med) / nullif(scale, 0) AS z, (a.v - med) / nullif(scale, 0) AS z_moved, abs(a.v - o.v) / nullif(scale, 0) AS shift
       FROM wh a JOIN wh o USING (image, kpi) JOIN sc USING (kpi) WHERE a.change <> 'own' AND o.change = 'own')"""
    )


def oracle_sql() -> dict[str, str]:
    shapes = ", ".join(f"round({k}, 6) AS {k}" for k in SHAPES)

    def verdict(z: str) -> str:
        return f"CASE WHEN count(*) FILTER (abs({z}) > 12.8) > 0 OR count(*) FILTER (abs({z}) > 8) >= 3 THEN 'REJECT' WHEN count(*) FILTER (abs({z}) > 8) > 0 OR count(*) FILTER (abs({z}) > 6.4) >= 2 THEN 'INVESTIGATE' ELSE 'ACCEPT' END"

    noise = f"""k5 AS (SELECT unnest(range(-2, 3)) AS k),
f AS (SELECT *, CASE WHEN t < 0 THEN -t - 1 WHEN t >= size THEN 2 * size - 1 - t ELSE t END AS at FROM (SELECT size, p, p + k AS t FROM (SELECT {HEIGHT} AS size, unnest(range({HEIGHT})) AS p UNION ALL SELECT {WIDTH}, unnest(range({WIDTH}))), k5)),
h1 AS (SELECT image, r, f.p AS c, avg(g) AS m FROM px JOIN f ON f.size = {WIDTH} AND f.at = px.c GROUP BY ALL),
h2 AS (SELECT image, f.p AS r, c, avg(m) AS m FROM h1 JOIN f ON f.size = {HEIGHT} AND f.at = h1.r GROUP BY ALL),
ns AS (SELECT image, stddev_pop(g - m) AS sd FROM px JOIN h2 USING (image, r, c) WHERE g >= {LOW} AND g < {HIGH} GROUP BY image)"""
    return {
        "local_thickness": _thickness(),
        "particle_shapes": _shape() + f" SELECT image, n, {shapes} FROM sh",
        "shape_kpis": _shape()
        + f""", {noise}, u AS (SELECT image, count(*) AS n, median(solidity) AS so, median(aspect) AS asp, median(circularity) AS ci, median(texture) AS tx FROM sh GROUP BY image)
SELECT image, coalesce(n, 0) AS n_sized, round(so, 6) AS solidity, round(asp, 6) AS aspect, round(ci, 6) AS circularity, round(tx / greatest(sd, 1e-6::DOUBLE), 6) AS texture
FROM (SELECT DISTINCT image FROM px) LEFT JOIN u USING (image) LEFT JOIN ns USING (image)""",
        "perturbation": _moved() + " SELECT image, change, kpi, " + ", ".join(f"round({k}, 6) AS {k}" for k in ("value", "moved", "z", "z_moved", "shift")) + " FROM pe",
        "perturbation_robustness": _moved()
        + f""", ro AS (SELECT * REPLACE (round(shift, {M.DIGITS}) AS shift) FROM pe)
SELECT image, change, arg_min(kpi, struct_pack(s := -shift, k := kpi)) FILTER (shift IS NOT NULL) AS worst_kpi, round(max(shift), 6) AS worst_shift, count(*) FILTER (shift >= {M.ROBUST}) AS n_over,
       count(*) FILTER (shift >= {M.ROBUST}) = 0 AS ok, {verdict("z")} AS decision, {verdict("z_moved")} AS decision_moved, {verdict("z")} = {verdict("z_moved")} AS same FROM ro GROUP BY image, change""",
    }
