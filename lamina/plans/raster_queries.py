"""Queries of grey images, with DuckDB counterparts. An image has 50 rows, an embedding each, and a column for each
dimension; grey levels are the scaled values. The SQL is written from the definitions, as plain joins of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.robust import weighted_quantiles
from lamina.functions.tables import stored
from lamina.operators import correlation as C
from lamina.operators import facts as X
from lamina.operators import grey as Y
from lamina.operators import grid as G
from lamina.operators import segment as S
from lamina.plans.baseline_queries import rounded

HEIGHT, WIDTH, LOW, HIGH = 50, 64, 108, 150
PIXEL_UM = 0.025
#: Hysteresis, least pore and margin of the segmentation here.
SEGMENT = (2, 6, 1)
#: Rows between the images where they lie below one another.
STEP = HEIGHT + 1
MASKS = [(0, "rows", 0, 4), (0, "cols", 60, 63), (1, "rows", 45, 49), (3, "cols", 0, 9), (3, "cols", 5, 12)]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "x"))
    level = F.least(F.greatest(F.floor(F.col("x").cast("double") * 250 + 128), F.lit(0)), F.lit(255)).cast("long")
    return rows.select(F.floor(F.col("vec_id") / HEIGHT).alias("image"), F.pmod("vec_id", F.lit(HEIGHT)).cast("long").alias("r"), F.col("c").cast("long").alias("c"), level.alias("g"))


def _mask(px: DataFrame, name: str) -> DataFrame:
    return px.where(Y.phases(LOW, HIGH)[name]).select(*Y.PLACE)


#: Columns that are 0, not null, for an image without any pixel of what is measured.
NOTHING = {
    "chord_statistics": {},
    "noise_level": {},
    "otsu_thresholds": {},
    "shading_flag": {"flagged": False},
    "particle_sizes": {"num_density_mm2": 0},
    "pore_connectivity": {"n": 0, "largest_ecd": 0},
    "hysteresis": {"weak": 0, "kept": 0, "large": 0},
    "distance_transform": {"n": 0},
    "contacts": {"n": 0},
    "exposed_interface": {"si": 0, "carbon": 0, "index": 0},
    "inclusions": {"n": 0, "n_large": 0, "largest": 0},
    "image_euler": {"euler": 0, "density_mm2": 0},
    "edge_crop": {"first": 0, "last": 0, "inner": 0},
    "edge_band": {"first": 0, "last": 0, "inner": 0},
}


def _every(px: DataFrame, out: DataFrame, name: str) -> DataFrame:
    """`out` with a row for each image of `px`, whatever it lacks."""
    whole = px.select("image").distinct().join(out, "image", "left")
    return whole.fillna(NOTHING[name]) if NOTHING[name] else whole


def image_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.fractions(pixels(spark, sf_dir), ["image"], LOW, HIGH), "si_frac_solid", "si_frac_total", "pore_frac_deep", "ambiguous_frac")


def strip_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("strip", Y.strip_of(F.col("c"), WIDTH, 5))
    return rounded(Y.fractions(px, ["image", "strip"], LOW, HIGH), "si_frac_solid", "si_frac_total", "pore_frac_deep", "ambiguous_frac")


def strip_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of the strips of an image, in terms of their mean."""
    each = Y.fractions(pixels(spark, sf_dir).withColumn("strip", Y.strip_of(F.col("c"), WIDTH, 5)), ["image", "strip"], LOW, HIGH)
    cv = [F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.stddev_samp(k), F.avg(k))).alias(f"{k}_cv") for k in ("pore_frac_deep", "si_frac_total")]
    return rounded(each.groupBy("image").agg(*cv), "pore_frac_deep_cv", "si_frac_total_cv")


def depth_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.depth_slopes(pixels(spark, sf_dir), HEIGHT, PIXEL_UM, LOW, HIGH), "pore_slope", "si_slope", digits=6)


def chord_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and ninth decile of the chords of each image, and how much longer those along rows are."""
    px = pixels(spark, sf_dir)
    out = None
    for name in ("pore", "carbon"):
        on = px.withColumn("on", Y.phases(LOW, HIGH)[name])
        h = G.chords(on.select((F.col("image") * HEIGHT + F.col("r")).alias("row"), F.col("c").alias("col"), "on"), "row", "col", WIDTH)
        v = G.chords(on.select((F.col("image") * WIDTH + F.col("c")).alias("row"), F.col("r").alias("col"), "on"), "row", "col", HEIGHT)
        um = F.col("length") * PIXEL_UM
        along = h.groupBy(F.floor(F.col("row") / HEIGHT).alias("image")).agg(F.avg(um).alias(f"{name}_h_mean"), F.percentile(um, F.lit(0.9)).alias(f"{name}_h_p90"))
        down = v.groupBy(F.floor(F.col("row") / WIDTH).alias("image")).agg(F.avg(um).alias(f"{name}_v_mean"))
        both = along.join(down, "image", "full").withColumn(f"{name}_ratio", F.col(f"{name}_h_mean") / F.col(f"{name}_v_mean"))
        out = both if out is None else out.join(both, "image", "full")
    out = _every(px, out, "chord_statistics")
    return rounded(out, *[c for c in out.columns if c != "image"])


def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.smoothed(pixels(spark, sf_dir), HEIGHT, WIDTH), "s", digits=6)


def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return rounded(_every(px, Y.noise(px, HEIGHT, WIDTH, LOW, HIGH), "noise_level"), "noise_sd", digits=6)


def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the pore mask, and of the mask dilated, eroded, closed and opened."""
    px = pixels(spark, sf_dir)
    on = _mask(px, "pore")
    wide, thin = Y.dilated(on, HEIGHT, WIDTH), Y.eroded(on)
    forms = {"own": on, "dilated": wide, "eroded": thin, "closed": Y.eroded(wide), "opened": Y.dilated(thin, HEIGHT, WIDTH)}
    all_ = None
    for name, mask in forms.items():
        part = mask.select("image", F.lit(name).alias("form"))
        all_ = part if all_ is None else all_.unionByName(part)
    counted = all_.groupBy("image", "form").agg(F.count(F.lit(1)).alias("n"))
    each = px.select("image").distinct().withColumn("form", F.explode(F.array(*[F.lit(k) for k in forms])))
    return each.join(counted, ["image", "form"], "left").fillna({"n": 0})


def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return _every(px, Y.otsu(px, ["image"]), "otsu_thresholds")


def shading_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return _every(px, Y.shading(px, HEIGHT), "shading_flag")


def image_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.gates(pixels(spark, sf_dir), HEIGHT, LOW, HIGH), "sat0", "sat255", "c_med", "si_med", "row_gradient_pct", "comb_step")


def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Y.phases(LOW, HIGH)
    return Y.majority(pixels(spark, sf_dir), 4, F.when(p["pore"], 0).when(p["carbon"], 1).otherwise(2), 3, HEIGHT, WIDTH)


def block_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain blocks of an image, and how far the pore share of the others lies from that of the pixels."""
    blocks = block_labels(spark, sf_dir).groupBy("image").agg(F.avg((F.col("label") == 3).cast("double")).alias("uncertain"), F.avg(F.when(F.col("label") < 3, (F.col("label") == 0).cast("double"))).alias("pore"))
    own = Y.fractions(pixels(spark, sf_dir), ["image"], LOW, HIGH).select("image", "pore_frac_deep")
    return rounded(blocks.join(own, "image").select("image", "uncertain", (F.col("pore") - F.col("pore_frac_deep")).alias("moved")), "uncertain", "moved")


def local_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.downsampled(pixels(spark, sf_dir), 4), "g")


def manual_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = spark.createDataFrame(MASKS, "image long, kind string, lo long, hi long")
    return Y.masked(pixels(spark, sf_dir), masks).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("total"))


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest relative change of an indicator over the images, for thresholds moved by 5 levels and half the size."""
    px = pixels(spark, sf_dir)
    kpis = ["si_frac_solid", "pore_frac_deep"]

    def long(pixels: DataFrame, low: int, high: int) -> DataFrame:
        return Y.fractions(pixels, ["image"], low, high).unpivot(["image"], kpis, "kpi", "value")

    base = stored(long(px, LOW, HIGH), "fractions").withColumnRenamed("value", "base")
    moved = None
    for name, rows in (("minus", long(px, LOW - 5, HIGH - 5)), ("plus", long(px, LOW + 5, HIGH + 5)), ("half", long(Y.downsampled(px, 2), LOW, HIGH))):
        part = rows.withColumn("variation", F.lit(name))
        moved = part if moved is None else moved.unionByName(part)
    change = moved.join(base, ["image", "kpi"]).withColumn("change", F.try_divide(F.col("value") - F.col("base"), F.abs("base")))
    out = change.groupBy("kpi").pivot("variation", ["minus", "plus", "half"]).agg(F.max(F.abs("change")))
    return rounded(out, "minus", "plus", "half")


def _labelled(on: DataFrame) -> DataFrame:
    """Runs with their component, 4-connected, of masks `image, r, c` that lie below one another with a row between."""
    return G.components(on.select((F.col("image") * STEP + F.col("r")).alias("row"), F.col("c").alias("col"), F.lit(True).alias("on")))


def _sizes(on: DataFrame) -> DataFrame:
    return G.component_sizes(_labelled(on)).withColumn("image", F.floor(F.col("top") / STEP))


def particle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of particles of 4 pixels or more, and area-weighted quantiles of their equivalent diameters."""
    px = pixels(spark, sf_dir)
    found = _sizes(_mask(px, "si")).where("n_pixels >= 4").select("image", (2 * F.sqrt(F.col("n_pixels") / F.pi()) * PIXEL_UM).alias("ecd"))
    count = found.groupBy("image").agg((F.count(F.lit(1)) / (HEIGHT * WIDTH * PIXEL_UM**2 * 1e-6)).alias("num_density_mm2"))
    q = weighted_quantiles(found.withColumn("w", F.col("ecd") ** 2), ["image"], "ecd", "w", [0.1, 0.5, 0.9], by_item=True)
    wide = q.groupBy("image").pivot("q", [0.1, 0.5, 0.9]).agg(F.first("value")).toDF("image", "d10", "d50", "d90")
    out = _every(px, wide.join(count, "image").withColumn("span", (F.col("d90") - F.col("d10")) / F.col("d50")), "particle_sizes")
    return rounded(out, "d10", "d50", "d90", "span", digits=6).withColumn("num_density_mm2", F.round("num_density_mm2", 2))


def pore_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of pores that cross an image, and the equivalent diameter of the largest."""
    px = pixels(spark, sf_dir)
    s = _sizes(_mask(px, "pore"))
    top, bottom = F.col("top") - F.col("image") * STEP, F.col("bottom") - F.col("image") * STEP
    down, across = (top == 0) & (bottom == HEIGHT - 1), (F.col("left") == 0) & (F.col("right") == WIDTH - 1)
    share = [F.coalesce(F.sum(F.when(c, F.col("n_pixels"))), F.lit(0)) / F.sum("n_pixels") for c in (down, across)]
    out = s.groupBy("image").agg(F.count(F.lit(1)).alias("n"), share[0].alias("down"), share[1].alias("across"), (2 * F.sqrt(F.max("n_pixels") / F.pi()) * PIXEL_UM).alias("largest_ecd"))
    return rounded(_every(px, out, "pore_connectivity"), "down", "across", "largest_ecd")


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels below the upper limit in components with a pixel below the lower one, and those in components of 4 or more."""
    all_ = pixels(spark, sf_dir)
    px = all_.where(F.col("g") < LOW + 5)
    runs = _labelled(px.select(*Y.PLACE))
    spread = runs.select("component", F.floor(F.col("row") / STEP).alias("image"), F.pmod("row", F.lit(STEP)).alias("r"), F.explode(F.sequence("first", "last")).alias("c"))
    whole = spread.join(px, Y.PLACE).groupBy("image", "component").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("least"))
    out = whole.groupBy("image").agg(F.sum("n").alias("weak"), F.coalesce(F.sum(F.when(F.col("least") < LOW - 20, F.col("n"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(F.col("n") >= 4, F.col("n"))), F.lit(0)).alias("large"))
    return _every(all_, out, "hysteresis")


def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    solid = px.where(~Y.phases(LOW, HIGH)["pore"]).select(*Y.PLACE)
    d = F.sqrt(F.col("d2").cast("double"))
    out = Y.squared_distances(solid, _mask(px, "pore")).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("most"), F.avg(d).alias("mean"))
    return rounded(_every(px, out, "distance_transform"), "mean")


def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused phases of an image with its mirror image as the second channel."""
    px = pixels(spark, sf_dir)
    other = px.select("image", "r", (WIDTH - 1 - F.col("c")).alias("c"), F.col("g").alias("e"))
    out = Y.fused(px.join(other, Y.PLACE), LOW, HIGH)
    counts = [F.count(F.when(F.col("middle") == k, 1)).alias(n) for k, n in enumerate(("pore", "carbon", "si"))]
    bounds = [F.count(F.when(F.when(F.col("unsure"), k == 0).otherwise(F.col("middle") == 0), 1)).alias(n) for k, n in ((1, "pore_least"), (0, "pore_most"))]
    return rounded(out.groupBy("image").agg(*counts, *bounds, F.avg("conflict").alias("conflict")), "conflict", digits=6)


def material_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    parts = [Y.core_median(px, _mask(px, name), times, name, least=20) for name, times in (("si", 1), ("carbon", 1), ("pore", 1))]
    both = parts[0].join(parts[1], "image", "full").join(parts[2], "image", "full")
    value = F.when(F.col("carbon") > F.col("pore"), (F.col("si") - F.col("carbon")) / (F.col("carbon") - F.col("pore")))
    return rounded(both.select("image", "si", "carbon", "pore", value.alias("contrast")), "si", "carbon", "pore", "contrast")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies two to four pixels from silicon."""
    px = pixels(spark, sf_dir)
    si = px.where("g > 190").select(*Y.PLACE)  # the brightest only: almost all pixels are near some silicon
    near = Y.dilated(si, HEIGHT, WIDTH)
    ring = Y.dilated_times(near, HEIGHT, WIDTH, 3).join(near, Y.PLACE, "left_anti").join(px, Y.PLACE)
    p = Y.phases(LOW, HIGH)
    out = ring.groupBy("image").agg(F.count(F.lit(1)).alias("n"), *[F.avg(p[k].cast("double")).alias(k) for k in ("pore", "carbon")])
    return rounded(_every(px, out, "contacts"), "pore", "carbon")


def exposed_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silicon, weighted three times, and carbon next to pores, by area: a proxy of the first cycle's loss."""
    px = pixels(spark, sf_dir)
    pore = _mask(px, "pore")
    ring = Y.dilated(pore, HEIGHT, WIDTH).join(pore, Y.PLACE, "left_anti").join(px, Y.PLACE)
    si = F.count(F.when(F.col("g") >= HIGH, 1))
    out = ring.groupBy("image").agg(si.alias("si"), (F.count(F.lit(1)) - si).alias("carbon")).withColumn("index", (3 * F.col("si") + F.col("carbon")) / (HEIGHT * WIDTH) / PIXEL_UM)
    return rounded(_every(px, out, "exposed_interface"), "index")


def inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright components, connected along eight directions, of 2 pixels or more."""
    px = pixels(spark, sf_dir)
    on = px.where("g > 190").select(*Y.PLACE)
    runs = G.components(on.select((F.col("image") * STEP + F.col("r")).alias("row"), F.col("c").alias("col"), F.lit(True).alias("on")), diagonal=True)
    found = G.component_sizes(runs).withColumn("image", F.floor(F.col("top") / STEP)).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_pixels") >= 2, 1)).alias("n_large"), F.max("n_pixels").alias("largest"))
    return _every(px, found, "inclusions")


def threshold_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the pore share by a level of the threshold."""
    low, high = ((F.col("g") < LOW + d).cast("double") for d in (-3, 3))
    return rounded(pixels(spark, sf_dir).groupBy("image").agg(((F.avg(high) - F.avg(low)) / 6).alias("slope")), "slope")


def image_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler number of the pores by square millimetre: pixels less pairs plus full squares."""
    px = pixels(spark, sf_dir)
    on = _mask(px, "pore")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, a, b in G._PARTS])
    each = on.select("image", "r", "c", F.explode(parts).alias("p")).groupBy("image", (F.col("r") - F.col("p.dr")).alias("r"), (F.col("c") - F.col("p.dc")).alias("c"), F.col("p.k").alias("k")).count()
    full = each.where(F.col("count") == F.element_at(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(4)), F.col("k")))
    sign = F.sum(F.when(F.col("k").isin(2, 3), -1).otherwise(1)).cast("long")
    out = full.groupBy("image").agg(sign.alias("euler")).withColumn("density_mm2", F.round(F.col("euler") / (HEIGHT * WIDTH * PIXEL_UM**2 * 1e-6), 2))
    return _every(px, out, "image_euler")


def two_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation lengths and integral ranges of pores and silicon in pixels, and the errors of their shares."""
    px = stored(pixels(spark, sf_dir), "pixels")
    p = Y.phases(LOW, HIGH)
    on = stored(px.where(p["pore"] | p["si"]).select("image", F.when(p["pore"], "pore").otherwise("si").alias("phase"), "r", "c"), "masks")
    groups = px.select("image").distinct().withColumn("phase", F.explode(F.array(F.lit("pore"), F.lit("si"))))
    return rounded(C.two_point(on, groups, ["image", "phase"], HEIGHT, WIDTH), "length_h", "length_v", "integral_range", "se", digits=6)


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's images with thresholds of their own; the row below stands for the second channel. As smoothed noise has a
    narrow range, the levels and the least size are smaller than for micrographs."""
    px = stored(pixels(spark, sf_dir), "pixels")
    below = px.select("image", (F.col("r") - 1).alias("r"), "c", F.col("g").alias("e"))
    both = px.join(below.hint("merge"), Y.PLACE, "left").withColumn("e", F.coalesce("e", "g"))
    return S.segmented(both, HEIGHT, WIDTH, *SEGMENT)


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and areas of each image."""
    n = [F.count(F.when(F.col("phase") == k, 1)).alias(k) for k in ("pore", "doubtful", "si", "carbon")]
    return _segmented(spark, sf_dir).groupBy("image").agg(F.max("t1").alias("t1"), F.max("t2").alias("t2"), *n)


def segmentation_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the phases with their errors over strips."""
    return rounded(S.with_errors(_segmented(spark, sf_dir), WIDTH), "value", "se")


def edge_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns at the frame whose colours differ, to be cropped, and those inside, which are only flagged. Colours are
    made from the grey level, with differences in a few columns."""
    c, r, image = F.col("c"), F.col("r"), F.col("image")
    off = ((c < F.pmod(image, F.lit(4))) | (c >= WIDTH - 2) | (c == 20 + image)) & (F.pmod(r, F.lit(10)) < 6)
    px = pixels(spark, sf_dir).withColumns({"red": F.col("g") + off.cast("int"), "blue": F.col("g")})
    return _every(px, Y.edge_runs(Y.bad_columns(px), WIDTH), "edge_crop")


def edge_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of dark and rough rows at the frame. The first channel is made darker, the second rougher, near the top."""
    dark = F.col("r") < F.pmod("image", F.lit(7))
    px = pixels(spark, sf_dir).withColumns({"e": F.when(dark, 3 * (F.col("g") - 128) + 128).otherwise(F.col("g")), "g": F.when(dark, F.floor(F.col("g") / 3)).otherwise(F.col("g"))})
    return _every(px, Y.edge_runs(Y.edge_bands(px, HEIGHT, WIDTH, 0.6, 2.0), HEIGHT, HEIGHT // 10), "edge_band")


def grey_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of 16 bins with their share, the table behind a figure of distributions."""
    px = pixels(spark, sf_dir)
    each = px.groupBy("image", F.least(F.floor(F.col("g") / 16), F.lit(15)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("share", F.round(F.col("n") / (HEIGHT * WIDTH), 8))


def island_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps with pores and carbon of fewer than 4 connected pixels given to what surrounds them."""
    p = Y.phases(LOW, HIGH)
    labels = stored(pixels(spark, sf_dir).select(*Y.PLACE, F.when(p["pore"], 0).when(p["si"], 2).otherwise(1).cast("long").alias("label")), "labels")
    small = None
    for k in (0, 1):
        runs = _labelled(labels.where(F.col("label") == k).select(*Y.PLACE))
        few = G.component_sizes(runs).where("n_pixels < 4").select("component")
        part = runs.join(few, "component").select(F.floor(F.col("row") / STEP).alias("image"), F.pmod("row", F.lit(STEP)).alias("r"), F.explode(F.sequence("first", "last")).alias("c"))
        small = part if small is None else small.unionByName(part)
    out = Y.without_islands(labels, small, HEIGHT, WIDTH)
    return out.groupBy("image", "own", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = (
    image_fractions, strip_fractions, strip_cv, depth_slopes, chord_statistics, smoothing, noise_level, morphology, otsu_thresholds, shading_flag, image_gates, block_labels, block_audit,
    local_means, manual_masks, sensitivity, particle_sizes, pore_connectivity, hysteresis, distance_transform, evidence_fusion,
    material_contrast, contacts, exposed_interface, inclusions, threshold_slope, image_euler, edge_crop, edge_band, grey_histograms,
    island_removal, two_point, segmentation, segmentation_kpis,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_PX = f"""WITH RECURSIVE px AS (
  SELECT vec_id // {HEIGHT} AS image, vec_id % {HEIGHT} AS r, c, least(255, greatest(0, floor(x * 250 + 128)))::BIGINT AS g
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS x FROM embeddings))"""
_FRACTIONS = f"""count(*) AS area, round(count(*) FILTER (g >= {HIGH}) / greatest(count(*) FILTER (g >= {LOW}), 1)::DOUBLE, 8) AS si_frac_solid,
round(avg((g >= {HIGH})::INT), 8) AS si_frac_total, round(avg((g < {LOW})::INT), 8) AS pore_frac_deep, round(avg((abs(g - {LOW}) <= 4 OR abs(g - {HIGH}) <= 4)::INT), 8) AS ambiguous_frac"""
_STRIP = "CASE WHEN c < 12 THEN 0 WHEN c < 25 THEN 1 WHEN c < 38 THEN 2 WHEN c < 51 THEN 3 ELSE 4 END::BIGINT"


def _chord(name: str, mask: str) -> str:
    return f"""
{name}h AS (SELECT image, round(avg(n), 8) AS m, round(quantile_cont(n, 0.9), 8) AS p90, avg(n) AS raw FROM (
  SELECT image, count(*) * {PIXEL_UM}::DOUBLE AS n FROM (SELECT image, r, c, c - row_number() OVER (PARTITION BY image, r ORDER BY c) AS k FROM px WHERE {mask})
  GROUP BY image, r, k HAVING min(c) > 0 AND max(c) < {WIDTH - 1}) GROUP BY image),
{name}v AS (SELECT image, round(avg(n), 8) AS m, avg(n) AS raw FROM (
  SELECT image, count(*) * {PIXEL_UM}::DOUBLE AS n FROM (SELECT image, r, c, r - row_number() OVER (PARTITION BY image, c ORDER BY r) AS k FROM px WHERE {mask})
  GROUP BY image, c, k HAVING min(r) > 0 AND max(r) < {HEIGHT - 1}) GROUP BY image)"""


def _otsu(keys: str) -> str:
    return f"""
lv AS (SELECT DISTINCT {keys}, g FROM src),
cut AS (SELECT {keys}, a.g AS t1, b.g AS t2 FROM lv a JOIN lv b USING ({keys}) WHERE a.g < b.g AND b.g < 255),
cls AS (SELECT {keys}, t1, t2, CASE WHEN h.g <= t1 THEN 1 WHEN h.g <= t2 THEN 2 ELSE 3 END AS k, sum(n)::DOUBLE AS n, sum(n * h.g)::DOUBLE AS s
        FROM cut JOIN (SELECT {keys}, g, count(*) AS n FROM src GROUP BY ALL) h USING ({keys}) GROUP BY ALL),
gain AS (SELECT {keys}, t1, t2, round(sum(s * s / n), 4) AS v FROM cls GROUP BY {keys}, t1, t2 HAVING count(*) = 3),
best AS (SELECT {keys}, t1, t2 FROM gain QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, t1, t2) = 1)"""


def _components(mask: str) -> str:
    return f"""
o AS (SELECT image, image * {STEP} + r AS r, c, g FROM px WHERE {mask}),
m AS (SELECT *, c - row_number() OVER (PARTITION BY r ORDER BY c) AS k FROM o),
runs AS (SELECT image, r, min(c) AS a, max(c) AS b, min(g) AS least, r * 4294967296 + min(c) AS node FROM m GROUP BY image, r, k),
e AS (SELECT x.node AS u, y.node AS v FROM runs x JOIN runs y ON abs(x.r - y.r) = 1 AND x.a <= y.b AND y.a <= x.b),
reach(node, label) AS (SELECT node, node FROM runs UNION SELECT e.v, reach.label FROM reach JOIN e ON e.u = reach.node WHERE reach.label < e.v),
lab AS (SELECT node, min(label) AS component FROM reach GROUP BY node),
sizes AS (SELECT image, component, sum(b - a + 1)::BIGINT AS n, min(r) - image * {STEP} AS top, max(r) - image * {STEP} AS bottom, min(a) AS lft, max(b) AS rgt, min(least) AS least
          FROM lab JOIN runs USING (node) GROUP BY image, component)"""


def _parts(name: str, of: str) -> str:
    """Components of pixels `image, r, c, v` as `name`_l (image, r, c, v, label), by recursion over neighbours."""
    return f"""{name}_o AS (SELECT image, image * 10000 + r * 100 + c AS id, r, c, v FROM {of}),
{name}_e AS (SELECT a.id AS u, b.id AS w FROM {name}_o a JOIN {name}_o b ON b.image = a.image AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
{name}_reach(id, label) AS (SELECT id, id FROM {name}_o UNION SELECT e.w, {name}_reach.label FROM {name}_reach JOIN {name}_e e ON e.u = {name}_reach.id WHERE {name}_reach.label < e.w),
{name}_l AS (SELECT image, r, c, v, label FROM (SELECT id, min(label) AS label FROM {name}_reach GROUP BY id) JOIN {name}_o USING (id))"""


def _segmentation(gauss: str) -> str:
    """The label maps `seg` (image, r, c, t1, t2, phase) from the definition."""
    hysteresis, least, margin = SEGMENT

    def smooth(name: str, of: str) -> str:
        return f"""{name}h AS (SELECT p.image, p.r, p.c, sum(q.g * w) AS s FROM {of} p, w JOIN {of} q ON q.image = p.image AND q.r = p.r AND q.c = least(greatest(p.c + k, 0), {WIDTH - 1}) GROUP BY ALL),
{name} AS (SELECT p.image, p.r, p.c, round(sum(q.s * w), {S.DIGITS}) AS s FROM {name}h p, w JOIN {name}h q ON q.image = p.image AND q.c = p.c AND q.r = least(greatest(p.r + k, 0), {HEIGHT - 1}) GROUP BY ALL)"""

    return (
        _PX
        + f""", {gauss}, py AS (SELECT p.image, p.r, p.c, coalesce(q.g, p.g) AS g FROM px p LEFT JOIN px q ON q.image = p.image AND q.r = p.r + 1 AND q.c = p.c),
{smooth("sa", "px")}, {smooth("sb", "py")}, src AS (SELECT image, floor(s + 0.5)::BIGINT AS g FROM sa), {_otsu("image")},
ct AS (SELECT sa.image, sa.r, sa.c, sa.s, sb.s AS e, t1, t2 FROM sa JOIN sb USING (image, r, c) LEFT JOIN best USING (image)),
lm AS (SELECT image, quantile_cont(e, {S.DARK_SHARE}) FILTER (s >= t1 AND s < t2) AS lim FROM ct GROUP BY image),
wk AS (SELECT image, r, c, (s <= t1)::INT AS v FROM ct WHERE s <= t1 + {hysteresis}), {_parts("a", "wk")},
po AS (SELECT ct.image, ct.r, ct.c, coalesce(e < lim, true) AS dark FROM a_l JOIN ct USING (image, r, c) JOIN lm USING (image) WHERE label IN (SELECT label FROM a_l GROUP BY label HAVING max(v) = 1)),
dk AS (SELECT image, r, c, 0 AS v FROM po WHERE dark), {_parts("b", "dk")},
dp AS (SELECT image, r, c FROM b_l WHERE label IN (SELECT label FROM b_l GROUP BY label HAVING count(*) >= {least})),
d5 AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dr, dc)),
hi AS (SELECT image, r, c FROM ct WHERE s >= t2), {_erode("he", "hi")}, {_dilate("br", "he")}, {_erode("be", "br")},
bv AS (SELECT br.image, br.r, br.c, CASE WHEN be.r IS NOT NULL THEN s - t2 END AS v FROM br JOIN ct USING (image, r, c) LEFT JOIN be ON be.image = br.image AND be.r = br.r AND be.c = br.c), {_parts("d", "bv")},
si AS (SELECT image, r, c FROM d_l WHERE label IN (SELECT label FROM d_l GROUP BY label HAVING median(v) >= {margin})),
seg AS (SELECT ct.image, ct.r, ct.c, t1, t2, CASE WHEN dp.r IS NOT NULL THEN 'pore' WHEN si.r IS NOT NULL THEN 'si' WHEN po.dark = false THEN 'doubtful' ELSE 'carbon' END AS phase
        FROM ct LEFT JOIN dp ON dp.image = ct.image AND dp.r = ct.r AND dp.c = ct.c LEFT JOIN si ON si.image = ct.image AND si.r = ct.r AND si.c = ct.c LEFT JOIN po ON po.image = ct.image AND po.r = ct.r AND po.c = ct.c)"""
    )


_ON = f"on1 AS (SELECT image, r, c FROM px WHERE g < {LOW}), d5 AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dr, dc))"


def _dilate(name: str, of: str) -> str:
    return f"{name} AS (SELECT DISTINCT image, r + dr AS r, c + dc AS c FROM {of}, d5 WHERE r + dr BETWEEN 0 AND {HEIGHT - 1} AND c + dc BETWEEN 0 AND {WIDTH - 1})"


def _erode(name: str, of: str) -> str:
    return f"{name} AS (SELECT s.image, s.r, s.c FROM {of} s, d5 JOIN {of} t ON t.image = s.image AND t.r = s.r + dr AND t.c = s.c + dc GROUP BY ALL HAVING count(*) = 5)"


def oracle_sql() -> dict[str, str]:
    """The definitions' SQL, with a row for each image."""
    out = _definitions()
    for name, zeros in NOTHING.items():
        replaced = ", ".join(f'coalesce("{c}", {str(v).lower()}) AS "{c}"' for c, v in zeros.items())
        out[name] = f"SELECT *{f' REPLACE ({replaced})' if zeros else ''} FROM (SELECT DISTINCT vec_id // {HEIGHT} AS image FROM embeddings) LEFT JOIN ({out[name]}) USING (image)"
    return out


def _definitions() -> dict[str, str]:
    gauss = f"""w AS (SELECT k, exp(-0.5::DOUBLE * (k / {Y.SIGMA}::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / {Y.SIGMA}::DOUBLE) ** 2)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS k))"""
    phase = f"CASE WHEN g < {LOW} THEN 0 WHEN g < {HIGH} THEN 1 ELSE 2 END"
    votes = f"""v AS (SELECT image, r // 4 AS br, c // 4 AS bc, {phase} AS p, count(*) AS n FROM px WHERE r < 48 GROUP BY ALL),
bl AS (SELECT image, br, bc, (CASE WHEN count(*) > 1 THEN 3 ELSE min(p) END)::BIGINT AS label FROM (SELECT *, max(n) OVER (PARTITION BY image, br, bc) AS top FROM v) WHERE n = top GROUP BY image, br, bc)"""

    def varied(name: str, low: int, high: int, src: str = "px") -> str:
        return f"SELECT '{name}' AS variation, image, count(*) FILTER (g >= {high}) / greatest(count(*) FILTER (g >= {low}), 1)::DOUBLE AS s, avg((g < {low})::INT) AS p FROM {src} GROUP BY image"

    core = (
        _PX
        + f""", d5 AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dr, dc)), ph AS (SELECT *, CASE WHEN g < {LOW} THEN 'pore' WHEN g >= {HIGH} THEN 'si' ELSE 'carbon' END AS p FROM px),
er AS (SELECT s.image, s.r, s.c, s.p FROM ph s, d5 JOIN ph t ON t.image = s.image AND t.r = s.r + dr AND t.c = s.c + dc AND t.p = s.p GROUP BY ALL HAVING count(*) = 5),
md AS (SELECT ph.image, ph.p, CASE WHEN count(er.r) >= 20 THEN median(g) FILTER (er.r IS NOT NULL) ELSE median(g) END AS m FROM ph LEFT JOIN er ON er.image = ph.image AND er.r = ph.r AND er.c = ph.c GROUP BY ALL),
mc AS (SELECT image, max(m) FILTER (p = 'si') AS si, max(m) FILTER (p = 'carbon') AS carbon, max(m) FILTER (p = 'pore') AS pore FROM md GROUP BY image)"""
    )
    change = "round(max(abs((m.{0} - b.{0}) / nullif(abs(b.{0}), 0))) FILTER (m.variation = '{1}'), 8) AS {1}"
    shares = "count(*) FILTER (phase = 'pore') / count(*)::DOUBLE AS pore, count(*) FILTER (phase = 'doubtful') / count(*)::DOUBLE AS doubtful, count(*) FILTER (phase = 'si') / count(*)::DOUBLE AS si, count(*) FILTER (phase = 'si') / nullif(count(*) FILTER (phase <> 'pore'), 0)::DOUBLE AS si_solid"
    return {
        "segmentation": _segmentation(gauss)
        + " SELECT image, max(t1) AS t1, max(t2) AS t2, count(*) FILTER (phase = 'pore') AS pore, count(*) FILTER (phase = 'doubtful') AS doubtful, count(*) FILTER (phase = 'si') AS si, count(*) FILTER (phase = 'carbon') AS carbon FROM seg GROUP BY image",
        "segmentation_kpis": _segmentation(gauss)
        + f""", sw AS (SELECT image, {shares} FROM seg GROUP BY image), ss AS (SELECT image, {_STRIP} AS strip, {shares} FROM seg GROUP BY ALL),
ls AS (SELECT image, unnest(['pore', 'doubtful', 'si', 'si_solid']) AS kpi, unnest([pore, doubtful, si, si_solid]) AS x FROM ss)
SELECT image, k.kpi, round(CASE k.kpi WHEN 'pore' THEN pore WHEN 'doubtful' THEN doubtful WHEN 'si' THEN si ELSE si_solid END, 8) AS value,
       (SELECT round(CASE WHEN count(x) >= 2 THEN stddev_samp(x) / sqrt(count(x)) END, 8) FROM ls WHERE ls.image = sw.image AND ls.kpi = k.kpi) AS se
FROM sw, (SELECT unnest(['pore', 'doubtful', 'si', 'si_solid']) AS kpi) k""",
        "image_fractions": _PX + f" SELECT image, {_FRACTIONS} FROM px GROUP BY image",
        "strip_fractions": _PX + f" SELECT image, {_STRIP} AS strip, {_FRACTIONS} FROM px GROUP BY ALL",
        "strip_cv": _PX
        + f""", s AS (SELECT image, {_STRIP} AS strip, avg((g < {LOW})::INT) AS p, avg((g >= {HIGH})::INT) AS s FROM px GROUP BY ALL)
SELECT image, round(stddev_samp(p) / nullif(avg(p), 0), 8) AS pore_frac_deep_cv, round(stddev_samp(s) / nullif(avg(s), 0), 8) AS si_frac_total_cv FROM s GROUP BY image""",
        "depth_slopes": _PX
        + f""", b AS (SELECT image, k, avg((g < {LOW})::INT) * 100 AS p, avg((g >= {HIGH})::INT) * 100 AS s, (2 * k + 1) * 5 * {PIXEL_UM}::DOUBLE AS x FROM (SELECT *, r // 10 AS k FROM px) GROUP BY image, k)
SELECT image, round(regr_slope(p, x) * 10, 6) AS pore_slope, round(regr_slope(s, x) * 10, 6) AS si_slope FROM b GROUP BY image""",
        "chord_statistics": _PX
        + f""",{_chord("pore", f"g < {LOW}")},{_chord("carbon", f"g >= {LOW} AND g < {HIGH}")}
SELECT image, a.m AS pore_h_mean, a.p90 AS pore_h_p90, b.m AS pore_v_mean, round(a.raw / b.raw, 8) AS pore_ratio,
       d.m AS carbon_h_mean, d.p90 AS carbon_h_p90, e.m AS carbon_v_mean, round(d.raw / e.raw, 8) AS carbon_ratio
FROM (SELECT DISTINCT image FROM px) LEFT JOIN poreh a USING (image) LEFT JOIN porev b USING (image) LEFT JOIN carbonh d USING (image) LEFT JOIN carbonv e USING (image)""",
        "smoothing": _PX
        + f""", {gauss},
h AS (SELECT p.image, p.r, p.c, sum(q.g * w) AS s FROM px p, w JOIN px q ON q.image = p.image AND q.r = p.r AND q.c = least(greatest(p.c + k, 0), {WIDTH - 1}) GROUP BY ALL)
SELECT p.image, p.r, p.c, round(sum(q.s * w), 6) AS s FROM h p, w JOIN h q ON q.image = p.image AND q.c = p.c AND q.r = least(greatest(p.r + k, 0), {HEIGHT - 1}) GROUP BY ALL""",
        "noise_level": _PX
        + f""", k AS (SELECT unnest(range(-2, 3)) AS k),
f AS (SELECT *, CASE WHEN t < 0 THEN -t - 1 WHEN t >= size THEN 2 * size - 1 - t ELSE t END AS at FROM (SELECT size, p, p + k AS t FROM (SELECT {HEIGHT} AS size, unnest(range({HEIGHT})) AS p UNION ALL SELECT {WIDTH}, unnest(range({WIDTH}))), k)),
h AS (SELECT image, r, f.p AS c, avg(g) AS m FROM px JOIN f ON f.size = {WIDTH} AND f.at = px.c GROUP BY ALL),
b AS (SELECT image, f.p AS r, c, avg(m) AS m FROM h JOIN f ON f.size = {HEIGHT} AND f.at = h.r GROUP BY ALL)
SELECT image, round(stddev_pop(g - m), 6) AS noise_sd FROM px JOIN b USING (image, r, c) WHERE g >= {LOW} AND g < {HIGH} GROUP BY image""",
        "morphology": _PX
        + f""", {_ON}, {_dilate("wide", "on1")}, {_erode("thin", "on1")}, {_erode("shut", "wide")}, {_dilate("open", "thin")}
SELECT image, form, count(f) AS n FROM (SELECT DISTINCT image FROM px) CROSS JOIN (SELECT unnest(['own', 'dilated', 'eroded', 'closed', 'opened']) AS form)
LEFT JOIN (SELECT image, 1 AS f, form FROM (SELECT image, 'own' AS form FROM on1 UNION ALL SELECT image, 'dilated' FROM wide UNION ALL SELECT image, 'eroded' FROM thin
  UNION ALL SELECT image, 'closed' FROM shut UNION ALL SELECT image, 'opened' FROM open)) USING (image, form) GROUP BY ALL""",
        "otsu_thresholds": _PX + ", src AS (SELECT image, g FROM px)," + _otsu("image") + " SELECT * FROM best",
        "shading_flag": _PX
        + ", src AS (SELECT image, r // 10 AS band, g FROM px),"
        + _otsu("image, band").replace("USING (image, band)", "USING (image, band)")
        + f" SELECT image, greatest(max(t1) - min(t1), max(t2) - min(t2))::DOUBLE AS drift, greatest(max(t1) - min(t1), max(t2) - min(t2)) > {Y.SHADING_LEVELS} AS flagged FROM best GROUP BY image",
        "image_gates": _PX
        + f""", u AS (SELECT image, g - lag(g) OVER (PARTITION BY image ORDER BY g) AS d FROM (SELECT DISTINCT image, g FROM px WHERE g BETWEEN 20 AND 200)),
cs AS (SELECT image, CASE WHEN count(*) > 2 THEN median(d) END AS comb FROM u GROUP BY image)
SELECT image, count(DISTINCT g) AS n_levels, round(avg((g = 0)::INT), 8) AS sat0, round(avg((g = 255)::INT), 8) AS sat255,
       round(median(g) FILTER (g >= {LOW} AND g < {HIGH}), 8) AS c_med, round(median(g) FILTER (g >= {HIGH}), 8) AS si_med,
       round((avg(g) FILTER (r < 6) - avg(g) FILTER (r >= {HEIGHT - 6})) / greatest(avg(g), 1e-6::DOUBLE) * 100, 8) AS row_gradient_pct, round(any_value(comb)::DOUBLE, 8) AS comb_step
FROM px LEFT JOIN cs USING (image) GROUP BY image""",
        "block_labels": _PX + f", {votes} SELECT * FROM bl",
        "block_audit": _PX
        + f""", {votes}, z AS (SELECT image, avg((g < {LOW})::INT) AS own FROM px GROUP BY image)
SELECT image, round(avg((label = 3)::INT), 8) AS uncertain, round(avg((label = 0)::INT) FILTER (label < 3) - any_value(own), 8) AS moved FROM bl JOIN z USING (image) GROUP BY image""",
        "local_means": _PX + " SELECT image, r // 4 AS r, c // 4 AS c, round(avg(g), 8) AS g FROM px GROUP BY ALL",
        "manual_masks": _PX
        + f""" SELECT image, count(*) AS n, sum(g)::BIGINT AS total FROM px WHERE NOT EXISTS (
  SELECT 1 FROM (VALUES {", ".join(map(str, MASKS))}) m(i, kind, lo, hi) WHERE i = image AND (kind = 'rows' AND r BETWEEN lo AND hi OR kind = 'cols' AND c BETWEEN lo AND hi)) GROUP BY image""",
        "sensitivity": _PX
        + f""", half AS (SELECT image, avg(g) AS g FROM px GROUP BY image, r // 2, c // 2),
b AS ({varied("base", LOW, HIGH)}), m AS ({varied("minus", LOW - 5, HIGH - 5)} UNION ALL {varied("plus", LOW + 5, HIGH + 5)} UNION ALL {varied("half", LOW, HIGH, "half")})
SELECT 'si_frac_solid' AS kpi, {", ".join(change.format("s", v) for v in ("minus", "plus", "half"))} FROM m JOIN b USING (image)
UNION ALL SELECT 'pore_frac_deep', {", ".join(change.format("p", v) for v in ("minus", "plus", "half"))} FROM m JOIN b USING (image)""",
        "particle_sizes": _PX
        + f""",{_components(f"g >= {HIGH}")},
q AS (SELECT image, 2 * sqrt(n / pi()) * {PIXEL_UM}::DOUBLE AS d FROM sizes WHERE n >= 4),
s AS (SELECT image, d, sum(d * d) OVER (PARTITION BY image ORDER BY d, rn) / sum(d * d) OVER (PARTITION BY image) AS share, rn FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY d) AS rn FROM q)),
i AS (SELECT image, x, (SELECT min(struct_pack(share := t.share, d := t.d)) FROM s t WHERE t.image = a.image AND t.share >= x) AS hi, (SELECT max(struct_pack(share := t.share, d := t.d)) FROM s t WHERE t.image = a.image AND t.share < x) AS lo
      FROM (SELECT DISTINCT image FROM q) a, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS x)),
v AS (SELECT image, x, CASE WHEN lo IS NULL THEN hi.d ELSE lo.d + (x - lo.share) / (hi.share - lo.share) * (hi.d - lo.d) END AS v FROM i),
p AS (SELECT image, max(v) FILTER (x = 0.1) AS d10, max(v) FILTER (x = 0.5) AS d50, max(v) FILTER (x = 0.9) AS d90 FROM v GROUP BY image)
SELECT image, round(d10, 6) AS d10, round(d50, 6) AS d50, round(d90, 6) AS d90, round((d90 - d10) / d50, 6) AS span,
       round((SELECT count(*) FROM q WHERE q.image = p.image) / ({HEIGHT} * {WIDTH} * {PIXEL_UM}::DOUBLE ** 2 * 1e-6::DOUBLE), 2) AS num_density_mm2 FROM p""",
        "pore_connectivity": _PX
        + f""",{_components(f"g < {LOW}")}
SELECT image, count(*) AS n, round(coalesce(sum(n) FILTER (top = 0 AND bottom = {HEIGHT - 1}), 0) / sum(n)::DOUBLE, 8) AS down,
       round(coalesce(sum(n) FILTER (lft = 0 AND rgt = {WIDTH - 1}), 0) / sum(n)::DOUBLE, 8) AS across, round(2 * sqrt(max(n) / pi()) * {PIXEL_UM}::DOUBLE, 8) AS largest_ecd FROM sizes GROUP BY image""",
        "hysteresis": _PX
        + f""",{_components(f"g < {LOW + 5}")}
SELECT image, sum(n)::BIGINT AS weak, coalesce(sum(n) FILTER (least < {LOW - 20}), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (n >= 4), 0)::BIGINT AS large FROM sizes GROUP BY image""",
        "distance_transform": _PX
        + f""", d AS (SELECT a.image, a.r, a.c, min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)::BIGINT AS d2 FROM px a JOIN px b ON b.image = a.image AND b.g < {LOW} WHERE a.g >= {LOW} GROUP BY ALL)
SELECT image, count(*) AS n, max(d2) AS most, round(avg(sqrt(d2)), 8) AS mean FROM d GROUP BY image""",
        "evidence_fusion": _PX
        + f""", ch AS (SELECT a.image, a.g, b.g AS e FROM px a JOIN px b ON b.image = a.image AND b.r = a.r AND b.c = {WIDTH - 1} - a.c),
gr AS (SELECT image, quantile_cont(e, 0.02) AS f, median(e) FILTER (g >= {LOW} AND g < {HIGH}) AS m FROM ch GROUP BY image),
x AS (SELECT image, g, 1 / (1 + exp((g - {LOW}) / 3.0::DOUBLE)) AS pp, 0.9::DOUBLE / (1 + exp(((e - f) / greatest(m - f, 1e-6::DOUBLE) - 0.5::DOUBLE) / 0.1::DOUBLE)) AS ep FROM ch JOIN gr USING (image)),
y AS (SELECT *, 0.7::DOUBLE * (1 - pp) AS pc, 0.3::DOUBLE * (1 - pp) AS pb, 0.9::DOUBLE - ep AS ec FROM x),
k AS (SELECT *, pp * ec + pc * ep AS conflict FROM y),
n AS (SELECT *, (pp * (ep + 0.1::DOUBLE) + pb * ep + pb * 0.1::DOUBLE / 2) / greatest(1 - conflict, 1e-6::DOUBLE) AS bp, (pc * (ec + 0.1::DOUBLE) + pb * ec + pb * 0.1::DOUBLE / 2) / greatest(1 - conflict, 1e-6::DOUBLE) AS bc FROM k),
l AS (SELECT *, CASE WHEN g >= {HIGH} THEN 2 WHEN bp >= bc THEN 0 ELSE 1 END AS mid, g < {HIGH} AND (conflict > 0.3 OR (greatest(bp, bc) < 0.6 AND abs(bp - bc) < 0.2)) AS unsure FROM n)
SELECT image, count(*) FILTER (mid = 0) AS pore, count(*) FILTER (mid = 1) AS carbon, count(*) FILTER (mid = 2) AS si, count(*) FILTER (mid = 0 AND NOT unsure) AS pore_least,
       count(*) FILTER (mid = 0 OR unsure) AS pore_most, round(avg(conflict), 6) AS conflict FROM l GROUP BY image""",
        "material_contrast": core + " SELECT image, round(si, 8) AS si, round(carbon, 8) AS carbon, round(pore, 8) AS pore, round(CASE WHEN carbon > pore THEN (si - carbon) / (carbon - pore) END, 8) AS contrast FROM mc",
        "contacts": _PX
        + f""", s AS (SELECT image, r, c FROM px WHERE g > 190),
d AS (SELECT p.image, p.r, p.c, p.g, min(abs(p.r - s.r) + abs(p.c - s.c)) AS d FROM px p JOIN s ON s.image = p.image AND abs(p.r - s.r) + abs(p.c - s.c) <= 4 GROUP BY ALL)
SELECT image, count(*) AS n, round(avg((g < {LOW})::INT), 8) AS pore, round(avg((g >= {LOW} AND g < {HIGH})::INT), 8) AS carbon FROM d WHERE d >= 2 GROUP BY image""",
        "exposed_interface": _PX
        + f""", d AS (SELECT DISTINCT p.image, p.r, p.c, p.g FROM px p JOIN px q ON q.image = p.image AND abs(p.r - q.r) + abs(p.c - q.c) = 1 AND q.g < {LOW} WHERE p.g >= {LOW})
SELECT image, count(*) FILTER (g >= {HIGH}) AS si, count(*) FILTER (g < {HIGH}) AS carbon,
       round((3 * count(*) FILTER (g >= {HIGH}) + count(*) FILTER (g < {HIGH})) / {HEIGHT * WIDTH}::DOUBLE / {PIXEL_UM}::DOUBLE, 8) AS index FROM d GROUP BY image""",
        "inclusions": _PX
        + f""", o AS (SELECT image, image * 10000 + r * 100 + c AS id, r, c FROM px WHERE g > 190),
e AS (SELECT a.id AS u, b.id AS v FROM o a JOIN o b ON b.image = a.image AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id),
reach(id, label) AS (SELECT id, id FROM o UNION SELECT e.v, reach.label FROM reach JOIN e ON e.u = reach.id WHERE reach.label < e.v),
l AS (SELECT id, min(label) AS label FROM reach GROUP BY id), s AS (SELECT image, label, count(*) AS n FROM l JOIN o USING (id) GROUP BY ALL)
SELECT image, count(*) AS n, count(*) FILTER (n >= 2) AS n_large, max(n) AS largest FROM s GROUP BY image""",
        "threshold_slope": _PX + f" SELECT image, round((avg((g < {LOW + 3})::INT) - avg((g < {LOW - 3})::INT)) / 6, 8) AS slope FROM px GROUP BY image",
        "image_euler": _PX
        + f""", o AS (SELECT image, r, c FROM px WHERE g < {LOW}),
t AS (SELECT a.image, 1 AS s FROM o a UNION ALL SELECT a.image, -1 FROM o a JOIN o b ON b.image = a.image AND (b.r = a.r AND b.c = a.c + 1 OR b.c = a.c AND b.r = a.r + 1)
  UNION ALL SELECT a.image, 1 FROM o a JOIN o b ON b.image = a.image AND b.r = a.r AND b.c = a.c + 1 JOIN o d ON d.image = a.image AND d.r = a.r + 1 AND d.c = a.c JOIN o f ON f.image = a.image AND f.r = a.r + 1 AND f.c = a.c + 1)
SELECT image, sum(s)::BIGINT AS euler, round(sum(s) / ({HEIGHT} * {WIDTH} * {PIXEL_UM}::DOUBLE ** 2 * 1e-6::DOUBLE), 2) AS density_mm2 FROM t GROUP BY image""",
        "two_point": _PX
        + f""", o AS (SELECT image, CASE WHEN g < {LOW} THEN 'pore' ELSE 'si' END AS phase, r, c FROM px WHERE g < {LOW} OR g >= {HIGH}),
sh AS (SELECT a.dr, b.d FROM (SELECT unnest(range(-12, 13)) AS dr) a, (SELECT unnest(range(-12, 13)) AS d) b UNION SELECT 0, unnest(range(0, {WIDTH // 2})) UNION SELECT unnest(range(0, {HEIGHT // 2})), 0),
n AS (SELECT a.image, a.phase, dr, d, count(b.r) AS n FROM o a, sh LEFT JOIN o b ON b.image = a.image AND b.phase = a.phase AND b.r = (a.r + dr + {HEIGHT}) % {HEIGHT} AND b.c = (a.c + d + {WIDTH}) % {WIDTH} GROUP BY ALL),
f AS (SELECT image, phase, count(*) / {HEIGHT * WIDTH}::DOUBLE AS f FROM o GROUP BY ALL HAVING count(*) < {HEIGHT * WIDTH}),
c AS (SELECT image, phase, dr, d, (n / {HEIGHT * WIDTH}::DOUBLE - f * f) / (f * (1 - f)) AS c FROM n JOIN f USING (image, phase)),
l AS (SELECT image, phase, 'h' AS way, d AS k, c, {WIDTH // 2} AS size FROM c WHERE dr = 0 AND d BETWEEN 0 AND {WIDTH // 2 - 1} UNION ALL SELECT image, phase, 'v', dr, c, {HEIGHT // 2} FROM c WHERE d = 0 AND dr BETWEEN 0 AND {HEIGHT // 2 - 1}),
b AS (SELECT image, phase, way, size, k, c, lag(c) OVER (PARTITION BY image, phase, way ORDER BY k) AS before FROM l),
w AS (SELECT image, phase, way, coalesce(arg_min(k - 1 + (before - exp(-1::DOUBLE)) / (before - c), k) FILTER (c < exp(-1::DOUBLE)), any_value(size))::DOUBLE AS len FROM b GROUP BY ALL),
rg AS (SELECT image, phase, floor(sqrt(dr * dr + d * d)) AS ring, sum(c) AS s, round(avg(c), {C.DIGITS}) AS m FROM c WHERE abs(dr) <= 12 AND abs(d) <= 12 GROUP BY ALL),
en AS (SELECT image, phase, coalesce(min(ring) FILTER (ring <= 12 AND m <= 0), 12) AS ending FROM rg GROUP BY ALL),
ir AS (SELECT image, phase, greatest(sum(s) FILTER (ring < ending), 1) AS a FROM rg JOIN en USING (image, phase) GROUP BY ALL)
SELECT image, phase, coalesce(round((SELECT len FROM w WHERE w.image = q.image AND w.phase = q.phase AND way = 'h'), 6), 0) AS length_h, coalesce(round((SELECT len FROM w WHERE w.image = q.image AND w.phase = q.phase AND way = 'v'), 6), 0) AS length_v,
       coalesce(round(a, 6), 1) AS integral_range, coalesce(round(sqrt(f * (1 - f) * a / {HEIGHT * WIDTH}), 6), 0) AS se
FROM (SELECT image, phase FROM (SELECT DISTINCT image FROM px), (SELECT unnest(['pore', 'si']) AS phase)) q LEFT JOIN f USING (image, phase) LEFT JOIN ir USING (image, phase)""",
        "edge_crop": _PX
        + f""", bad AS (SELECT image, c FROM px GROUP BY image, c HAVING avg(((c < image % 4 OR c >= {WIDTH - 2} OR c = 20 + image) AND r % 10 < 6)::INT) > 0.5),
good AS (SELECT image, min(c) AS a, max(c) AS b FROM (SELECT DISTINCT image, c FROM px) WHERE (image, c) NOT IN (SELECT (image, c) FROM bad) GROUP BY image)
SELECT image, count(*) FILTER (c < a) AS first, count(*) FILTER (c > b) AS last, count(*) FILTER (c > a AND c < b) AS inner FROM bad JOIN good USING (image) GROUP BY image""",
        "edge_band": _PX
        + f""", z AS (SELECT image, r, c, CASE WHEN r < image % 7 THEN g // 3 ELSE g END AS g, CASE WHEN r < image % 7 THEN 3 * (g - 128) + 128 ELSE g END AS e FROM px),
f AS (SELECT size, reach, p, CASE WHEN t < 0 THEN -t - 1 WHEN t >= size THEN 2 * size - 1 - t ELSE t END AS at
      FROM (SELECT size, reach, p, p + k AS t FROM (SELECT {HEIGHT} AS size, unnest(range({HEIGHT})) AS p UNION ALL SELECT {WIDTH}, unnest(range({WIDTH}))), (VALUES (2), (4)) v(reach), (SELECT unnest(range(-4, 5)) AS k) WHERE abs(k) <= reach)),
h AS (SELECT image, r, f.p AS c, avg(e) AS m, avg(e * e) AS q FROM z JOIN f ON f.size = {WIDTH} AND f.reach = 2 AND f.at = z.c GROUP BY ALL),
b AS (SELECT image, f.p AS r, c, round(avg(q) - avg(m) ** 2, 6) AS v FROM h JOIN f ON f.size = {HEIGHT} AND f.reach = 2 AND f.at = h.r GROUP BY ALL),
w AS (SELECT image, median(g) AS gm, median(v) AS vm FROM z JOIN b USING (image, r, c) GROUP BY image),
fl AS (SELECT image, r, (median(g) < 0.6::DOUBLE * any_value(gm) AND median(v) > 2 * any_value(vm))::INT AS flag FROM z JOIN b USING (image, r, c) JOIN w USING (image) GROUP BY image, r),
sm AS (SELECT image, f.p AS r, round(avg(flag), 9) > 0.5 AS bad FROM fl JOIN f ON f.size = {HEIGHT} AND f.reach = 4 AND f.at = fl.r GROUP BY ALL),
g AS (SELECT image, min(r) FILTER (NOT bad) AS a, max(r) FILTER (NOT bad) AS b FROM sm GROUP BY image),
n AS (SELECT image, count(*) FILTER (a IS NULL OR r < a) AS x, count(*) FILTER (r > b) AS y, count(*) AS n FROM sm JOIN g USING (image) WHERE bad GROUP BY image)
SELECT image, CASE WHEN x <= 5 THEN x ELSE 0 END AS first, CASE WHEN y <= 5 THEN y ELSE 0 END AS last, n - x - y AS inner FROM n""",
        "grey_histograms": _PX + f" SELECT image, least(g // 16, 15) AS bin, count(*) AS n, round(count(*) / {HEIGHT * WIDTH}::DOUBLE, 8) AS share FROM px GROUP BY ALL",
        "island_removal": _PX
        + f""", k AS (SELECT unnest(range(-2, 3)) AS k),
lb AS (SELECT image, image * 10000 + r * 100 + c AS id, r, c, CASE WHEN g < {LOW} THEN 0 WHEN g >= {HIGH} THEN 2 ELSE 1 END AS l FROM px),
e AS (SELECT a.id AS u, b.id AS v FROM lb a JOIN lb b ON b.image = a.image AND b.l = a.l AND (b.r = a.r AND b.c = a.c + 1 OR b.c = a.c AND b.r = a.r + 1) WHERE a.l < 2),
e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
near AS (SELECT id AS a, id AS b FROM lb WHERE l < 2 UNION SELECT u, v FROM e2 UNION SELECT x.u, y.v FROM e2 x JOIN e2 y ON x.v = y.u UNION SELECT x.u, z.v FROM e2 x JOIN e2 y ON x.v = y.u JOIN e2 z ON y.v = z.u),
sm AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) < 4),
big AS (SELECT lb.*, sm.id IS NOT NULL AS small FROM lb LEFT JOIN sm USING (id)),
ar AS (SELECT s.id, a.k AS dr, b.k AS dc, CASE WHEN r + a.k < 0 THEN -(r + a.k) - 1 WHEN r + a.k >= {HEIGHT} THEN {2 * HEIGHT - 1} - r - a.k ELSE r + a.k END AS r2,
              CASE WHEN c + b.k < 0 THEN -(c + b.k) - 1 WHEN c + b.k >= {WIDTH} THEN {2 * WIDTH - 1} - c - b.k ELSE c + b.k END AS c2, s.image FROM big s, k a, k b WHERE small),
vt AS (SELECT ar.id, count(*) FILTER (t.l = 0) AS v0, count(*) FILTER (t.l = 1) AS v1, count(*) FILTER (t.l = 2) AS v2 FROM ar LEFT JOIN big t ON t.image = ar.image AND t.r = r2 AND t.c = c2 AND NOT t.small GROUP BY ar.id)
SELECT image, l::BIGINT AS own, (CASE WHEN NOT small THEN l WHEN v0 >= v1 AND v0 >= v2 THEN 0 ELSE 1 END)::BIGINT AS label, count(*) AS n FROM big LEFT JOIN vt USING (id) GROUP BY ALL""",
    }
