"""Assignment of samples to batches by nearest shrunken centroid, its tuning, novelty and batch signatures.

Features are long rows `sample_id, batch, kpi, x`. Leave-one-out centroids need no join of all samples: only the
own batch's median changes, and `loo_median` gives it from one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.bootstrap import stability  # noqa: F401
from lamina.functions.ranks import count_beside
from lamina.functions.robust import loo_median, median
from lamina.functions.tables import spread, stored
from lamina.operators.baseline import REJECT_Z, loo_stats
from lamina.operators.facts import BASELINE, weight

#: Grids of the tuning, the clip of the likelihood, limits of labels, novelty and signatures.
SHRINKAGES = [0.0, 0.25, 0.5, 1.0]
TEMPERATURES = [0.5, 1.0, 2.0, 4.0, 8.0]
LEAST_P = 1e-3
TIE = 1e-12
#: Chances that agree to so many digits are equal: sums of squares depend on the order of their terms.
P_DIGITS = 9
CONFIDENT_P, CONFIDENT_STABILITY, MODERATE_P = 0.75, 0.8, 0.5
NOVEL_N, NOVEL_QUANTILE, NOVEL_FACTOR = 40, 0.975, 1.25
SIGNATURE_EFFECT, SIGNATURE_STABILITY, SIGNATURE_Z = 1.5, 0.8, 1.0


def features(scored: DataFrame) -> DataFrame:
    """z-scores times weights; a missing one is no evidence, so zero."""
    return scored.select("sample_id", "batch", "kpi", F.coalesce(F.col("z") * weight(F.col("kpi")), F.lit(0.0)).alias("x"))


def _middle(values: Column) -> Column:
    """Median of a small array."""
    ordered, n = F.sort_array(values), F.size(values)
    return (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2


def _shrink(value: Column, centre: Column, delta: Column) -> Column:
    off = value - centre
    return centre + F.signum(off) * F.greatest(F.abs(off) - delta, F.lit(0.0))


def centroids(rows: DataFrame, delta: float) -> DataFrame:
    """`batch, kpi, c`: batch medians drawn by delta towards the median of all batches' medians."""
    raw = rows.groupBy("batch", "kpi").agg(median(F.col("x")).alias("raw"))
    centre = F.percentile("raw", F.lit(0.5)).over(Window.partitionBy("kpi"))
    return raw.select("batch", "kpi", _shrink(F.col("raw"), centre, F.lit(float(delta))).alias("c"))


def distances(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """`sample_id, batch, candidate, d` of every sample and centroid; centroids are batches times indicators."""
    both = rows.join(F.broadcast(centres.withColumnRenamed("batch", "candidate")), "kpi")
    return both.groupBy("sample_id", "batch", "candidate").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d"))


def softmax(measured: DataFrame, temperature: Column, keys: list[str]) -> DataFrame:
    """Adds `p`, proportional to exp(-d^2 / 2T) within `keys`, shifted so that it can't underflow as a whole."""
    w = Window.partitionBy(*keys)
    energy = -(F.col("d") ** 2) / (2 * temperature)
    shifted = measured.withColumn("__e", energy).withColumn("__e", F.exp(F.col("__e") - F.max("__e").over(w)))
    return shifted.withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the largest p of each key; the smaller candidate wins a tie, up to rounding."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("p", P_DIGITS)), "candidate")
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def loo_distances(rows: DataFrame, deltas: list[float]) -> DataFrame:
    """`sample_id, batch, delta, candidate, d`, with centroids refitted without the sample."""
    own = loo_median(rows, ["batch", "kpi"], "x", "own", "sample_id")
    raw = rows.groupBy("batch", "kpi").agg(median(F.col("x")).alias("raw"))
    table = raw.groupBy("kpi").agg(F.collect_list(F.struct(F.col("batch").alias("candidate"), "raw")).alias("table"))  # batches
    # Whole samples are dealt to tasks before they grow by batches and deltas, so that a task adds up its own samples alone.
    both = spread(own.select("sample_id", "batch", "kpi", "x", "own"), ["sample_id"]).join(F.broadcast(table), "kpi")
    refitted = F.filter(F.transform("table", lambda t: F.struct(t["candidate"].alias("candidate"), F.when(t["candidate"] == F.col("batch"), F.col("own")).otherwise(t["raw"]).alias("c"))), lambda t: t["c"].isNotNull())
    refit = both.select("sample_id", "batch", "kpi", "x", refitted.alias("table")).withColumn("centre", _middle(F.col("table")["c"]))
    wide = refit.select("sample_id", "batch", "kpi", "x", "centre", F.explode("table").alias("t"))
    # A delta is a column, not a row.
    off = [F.col("x") - _shrink(F.col("t.c"), F.col("centre"), F.lit(float(d))) for d in deltas]
    sums = wide.groupBy("sample_id", "batch", F.col("t.candidate").alias("candidate")).agg(*[F.sqrt(F.sum(o**2)).alias(f"__d{k}") for k, o in enumerate(off)])
    each = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("delta"), F.col(f"__d{k}").alias("d")) for k, d in enumerate(deltas)]))
    return sums.select("sample_id", "batch", "candidate", each.alias("e")).select("sample_id", "batch", "e.delta", "candidate", "e.d")


def tuning(rows: DataFrame, deltas: list[float] = SHRINKAGES, temperatures: list[float] = TEMPERATURES) -> DataFrame:
    """`delta, temperature, nll, accuracy` over the grid. The chances of a sample at a delta come from the small array of its
    distances, so nothing is sorted."""
    keys = ["sample_id", "batch", "delta"]
    held = loo_distances(rows, deltas).groupBy(*keys).agg(F.collect_list(F.struct("candidate", "d")).alias("far"), F.min("d").alias("least"))
    every = held.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))

    def mass(t: Column) -> Column:
        return F.exp((F.col("least") ** 2 - t["d"] ** 2) / (2 * F.col("temperature")))

    chances = every.withColumn("mass", F.transform("far", lambda t: F.struct(t["candidate"].alias("candidate"), mass(t).alias("e"))))
    total = F.aggregate("mass", F.lit(0.0), lambda a, t: a + F.coalesce(t["e"], F.lit(0.0)))
    placed = chances.withColumn("total", total).withColumn("p", F.transform("mass", lambda t: F.struct((t["e"] / F.col("total")).alias("p"), t["candidate"].alias("candidate"))))
    true = F.array_max(F.filter("p", lambda t: t["candidate"] == F.col("batch")))["p"]
    top = F.array_max(F.transform("p", lambda t: F.struct(F.round(t["p"], P_DIGITS).alias("p"), (-t["candidate"]).alias("c"))))
    each = placed.select(*keys, "temperature", F.coalesce(true, F.lit(0.0)).alias("p_true"), top.alias("top"))
    loss = -F.log(F.greatest(F.col("p_true"), F.lit(LEAST_P)))
    return each.groupBy("delta", "temperature").agg(F.avg(loss).alias("nll"), F.avg((-F.col("top.c") == F.col("batch")).cast("double")).alias("accuracy"))


def choose(grid: DataFrame) -> tuple[float, float]:
    """The first pair, by delta then temperature, that no earlier one beats by more than TIE; the grid is small."""
    chosen = None
    for row in grid.orderBy("delta", "temperature").collect():
        if chosen is None or row["nll"] < chosen["nll"] - TIE:
            chosen = row
    return (chosen["delta"], chosen["temperature"]) if chosen else (SHRINKAGES[0], TEMPERATURES[len(TEMPERATURES) // 2])


def within_distances(rows: DataFrame, delta: float) -> DataFrame:
    """`sample_id, batch, d`: distance to the own batch's centroid fitted without the sample."""
    return loo_distances(rows, [delta]).where("candidate = batch").select("sample_id", "batch", "d")


def novelty(nearest: DataFrame, within: DataFrame) -> DataFrame:
    """`sample_id, dmin, id_score, novel` of samples `sample_id, dmin`: where the distance lies among the labelled
    samples' own distances."""
    within = stored(within.select("d"), "within")
    limits = within.agg(F.count("d").alias("n"), F.max("d").alias("most"), F.percentile("d", F.lit(NOVEL_QUANTILE)).alias("high"))
    counted = count_beside(nearest.select("sample_id", F.col("dmin").alias("d")), within, "d", above=False).crossJoin(F.broadcast(limits))  # one row
    novel = F.when(F.col("n") == 0, False).when(F.col("n") >= NOVEL_N, F.col("d") > F.col("high")).otherwise(F.col("d") > NOVEL_FACTOR * F.col("most"))
    return counted.select("sample_id", F.col("d").alias("dmin"), F.when(F.col("n") > 0, 1 - F.col("n_beside") / (F.col("n") + 1)).alias("id_score"), novel.alias("novel"))


def confidence(p: Column, stability: Column) -> Column:
    sure = (p >= CONFIDENT_P) & (F.coalesce(stability, F.lit(0.0)) >= CONFIDENT_STABILITY)
    return F.when(sure, "confident").when(p >= MODERATE_P, "moderately confident").otherwise("low confidence")


def strip_vectors(rows: DataFrame, strips: DataFrame) -> DataFrame:
    """`sample_id, strip, kpi, x`: strip features moved so that their mean is the image's feature; only their spread
    counts for stability."""
    centre = F.avg("s").over(Window.partitionBy("sample_id", "kpi"))
    moved = strips.select("sample_id", "strip", "kpi", F.col("x").alias("s")).withColumn("off", F.col("s") - centre)
    return moved.join(rows.select("sample_id", "kpi", "x"), ["sample_id", "kpi"]).select("sample_id", "strip", "kpi", (F.col("x") + F.col("off")).alias("x"))


def new_way(scored: DataFrame, signs: DataFrame, matches: DataFrame, limit: float = REJECT_Z) -> DataFrame:
    """`sample_id, new_way`: far off in an indicator of no signature, while no signature matches."""
    known = signs.where("in_signature").select("kpi").distinct()
    off = scored.select("sample_id", "kpi", "z").join(F.broadcast(known.withColumn("known", F.lit(True))), "kpi", "left")
    far = off.groupBy("sample_id").agg(F.max(F.coalesce(F.col("known").isNull() & (F.abs("z") > limit), F.lit(False))).alias("far"))
    top = matches.groupBy("sample_id").agg(F.max("match").alias("top"))
    return far.join(top, "sample_id", "left").select("sample_id", (F.col("far") & ~F.coalesce(F.col("top") > SIGNATURE_EFFECT, F.lit(False))).alias("new_way"))


def novelty_by_signature(found: DataFrame, assigned: DataFrame, matches: DataFrame, ways: DataFrame) -> DataFrame:
    """`novelty` with the rules of the signatures: a sample that goes along with its assigned batch's own signature is
    a more extreme member and not novel; one that is off in a new way is novel."""
    own = matches.select("sample_id", F.col("signature").alias("assigned"), "match")
    rows = found.join(assigned.select("sample_id", "assigned"), "sample_id").join(own, ["sample_id", "assigned"], "left").join(ways, "sample_id", "left")
    member = F.coalesce(F.col("match") >= SIGNATURE_EFFECT, F.lit(False))
    way = F.coalesce("new_way", F.lit(False))
    return rows.select("sample_id", "dmin", "id_score", F.col("novel").alias("beyond_range"), way.alias("new_way"), ((F.col("novel") & ~member) | way).alias("novel"))


def signatures(facts: DataFrame, stats: DataFrame, batch: int = BASELINE) -> DataFrame:
    """`batch, kpi, effect, stability, in_signature` of the other batches: how far their median lies from the
    baseline's, and the share of samples without which sign and size stay."""
    others = facts.where((F.col("batch") != batch) & F.col("value").isNotNull())
    mid = others.groupBy("batch", "kpi").agg(median(F.col("value")).alias("mid"))
    whole = mid.join(F.broadcast(stats.select("kpi", "med", "scale")), "kpi").withColumn("effect", (F.col("mid") - F.col("med")) / F.col("scale"))
    total = facts.select("sample_id").distinct().count()

    def stays(effect: Column) -> Column:
        return F.coalesce((F.signum(effect) == F.signum("effect")) & (F.abs(effect) > 1), F.lit(False)).cast("int")

    # a baseline sample left out changes the statistics, one of the batch its median, any other nothing
    base = loo_stats(facts, batch).select("kpi", F.col("med").alias("m"), F.col("scale").alias("s"))
    by_base = whole.join(base, "kpi").groupBy("batch", "kpi").agg(F.sum(stays((F.col("mid") - F.col("m")) / F.col("s"))).alias("a"), F.count(F.lit(1)).alias("na"))
    own = loo_median(others, ["batch", "kpi"], "value", "m", "sample_id").select("batch", "kpi", "m")
    by_own = own.join(whole, ["batch", "kpi"]).groupBy("batch", "kpi").agg(F.sum(stays((F.col("m") - F.col("med")) / F.col("scale"))).alias("b"), F.count(F.lit(1)).alias("nb"))
    rest = (F.lit(total) - F.col("na") - F.col("nb")) * (F.abs("effect") > 1).cast("int")
    out = whole.join(by_base, ["batch", "kpi"]).join(by_own, ["batch", "kpi"]).withColumn("stability", (F.col("a") + F.col("b") + rest) / F.lit(total))
    strong = (F.abs("effect") >= SIGNATURE_EFFECT) & (F.col("stability") >= SIGNATURE_STABILITY)
    return out.select("batch", "kpi", "effect", "stability", strong.alias("in_signature"))


def signature_match(scored: DataFrame, signs: DataFrame) -> DataFrame:
    """`sample_id, signature, match, n_matched`: weighted mean of the signed z-scores of a signature."""
    used = signs.where("in_signature").select(F.col("batch").alias("signature"), "kpi", F.signum("effect").alias("sign"))
    both = scored.where("z IS NOT NULL").join(F.broadcast(used), "kpi").withColumn("w", weight(F.col("kpi")))
    along = F.col("sign") * F.col("z")
    return both.groupBy("sample_id", "signature").agg((F.sum(F.col("w") * along) / F.sum("w")).alias("match"), F.count(F.when(along > SIGNATURE_Z, 1)).alias("n_matched"))


def jaccard(signs: DataFrame) -> DataFrame:
    """`a, b, overlap` of the signed signatures of each pair of batches; a signature is a small array."""
    sets = signs.groupBy("batch").agg(F.collect_set(F.when(F.col("in_signature"), F.concat_ws(":", "kpi", F.signum("effect").cast("int").cast("string")))).alias("s"))
    a, b = sets.select(F.col("batch").alias("a"), F.col("s").alias("sa")), sets.select(F.col("batch").alias("b"), F.col("s").alias("sb"))
    union = F.size(F.array_union("sa", "sb"))
    both = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return both.select("a", "b", F.when(union > 0, F.size(F.array_intersect("sa", "sb")) / union).otherwise(0.0).alias("overlap"))
