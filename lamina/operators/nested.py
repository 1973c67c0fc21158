"""Nested leave-one-out validation with tuning inside each fold.

A fold leaves one sample out, fits the baseline statistics anew and chooses shrinkage and temperature by a second
leave-one-out over the samples that are left. Done directly that is a median for each fold, inner sample, batch and
indicator. Two facts make it small:

- Features are linear in the values, so medians of values carry over. Without two of its values a sorted list has its
  median among four values beside the middle, which depend only on which of them are gone or whether the removed ones
  lie below or above. So a batch and indicator keeps these four, and a sample its rank cut to six places.
- Two folds of one batch with the same statistics and the same cut ranks in all indicators judge every inner sample alike.
  Folds are grouped by this state; inner samples meet states, not folds, and a fold's own loss, which it must not
  count, is subtracted. With k indicators there are about 2^k states and k times a few more, however many samples there are.

The losses of a state over the grid are summed in blocks while they are made (`fold_losses`); no pair of samples is stored or shuffled.

A sample that lacks an indicator has 0 for it and does not enter its centroids; a batch without any sample left is no
candidate; samples without a single baseline statistic to compare with have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.robust import finite, robust_stats
from lamina.functions.tables import stored, with_workers
from lamina.operators import assign as A
from lamina.operators import baseline as B
from lamina.operators import fold_losses as K
from lamina.operators.facts import BASELINE, abs_floor, weight

#: About so many samples of five equal batches share a hash; a block has those of one batch.
BLOCK = 2000
#: States of a block.
STATES = 128
#: Tasks that judge at most.
MOST_TASKS = 1024
#: Values beside the middle of a batch.
MIDDLE = 4
#: Losses that agree to so many digits are equal; the first pair of the grid wins.
LOSS_DIGITS = 9


def _places(clean: DataFrame) -> DataFrame:
    """`sample_id, batch, kpi, value, w, n, p0, place`: a value's rank in its batch, cut to what the middle can tell apart."""
    group = Window.partitionBy("batch", "kpi")
    rank = F.when(F.col("value").isNotNull(), F.row_number().over(group.orderBy(F.col("value").asc_nulls_last(), "sample_id")))
    ranked = clean.withColumns({"rank": rank.cast("int"), "n": F.count("value").over(group).cast("int"), "w": weight(F.col("kpi"))})
    ranked = ranked.withColumn("p0", F.floor((F.col("n") - 1) / 2).cast("int"))
    return ranked.withColumn("place", F.greatest(F.least("rank", F.col("p0") + MIDDLE), F.col("p0") - 1))


def _middles(placed: DataFrame, batches: list) -> Column:
    """The aggregate that gives an indicator's `[struct(batch, n, p0, mid)]`, one for each of `batches`, null where it has none."""
    mids = [[F.max(F.when((F.col("batch") == b) & (F.col("rank") == F.col("p0") + k), F.col("value"))) for k in range(MIDDLE)] for b in batches]
    own = [F.max(F.when(F.col("batch") == b, F.col(c))) for b in batches for c in ("n", "p0")]
    return F.array(*[F.struct(F.lit(b).alias("batch"), own[2 * k].alias("n"), own[2 * k + 1].alias("p0"), F.array(*m).alias("mid")) for k, (b, m) in enumerate(zip(batches, mids, strict=True))])


def median_without(t: Column, a: Column, b: Column) -> Column:
    """Median of the batch `t` (see `_middles`) without the values at the places `a` and `b`, either of which may be null."""
    first, second = F.least(a, b), F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
    gone = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    left = t["n"] - gone

    def at(p: Column) -> Column:
        q = p + F.coalesce((first <= p).cast("int"), F.lit(0))
        q = q + F.coalesce((second <= q).cast("int"), F.lit(0))
        return F.get(t["mid"], (q - t["p0"]).cast("int"))

    return F.when(left > 0, (at(F.floor((left + 1) / 2)) + at(F.floor(left / 2) + 1)) / 2)


def _feature(s: Column, value: Column) -> Column:
    return (value - s["med"]) / s["scale"] * s["w"]


def _with_centroids(state: Column, own: Column, order: Column) -> Column:
    """Adds to each indicator of a fold's state the candidates' centroids `c` without the fold's sample."""

    def one(s: Column) -> Column:
        places = [s[f].alias(f) for f in ("kpi", "med", "scale", "w", "place")]
        return F.struct(*places, F.transform(F.try_element_at(order, s["kpi"]), lambda t: _feature(s, median_without(t, F.when(t["batch"] == own, s["place"]), F.lit(None).cast("int")))).alias("c"))

    return F.transform(state, one)


def _terms(state: Column, values: Column, own: Column, inner: Column | None = None, index: Column | None = None, order: Column | None = None) -> Column:
    """For each indicator of a fold's state: feature `x` of the judged values, the candidates' centroids `c` and their median
    `m`. If the judged sample has a batch `inner`, which is the candidate `index`, that one is without it as well."""

    def one(s: Column) -> Column:
        v = F.try_element_at(values, s["kpi"])
        c = s["c"]
        if inner is not None:
            anew = _feature(s, median_without(F.get(F.try_element_at(order, s["kpi"]), index), F.when(inner == own, s["place"]), v["place"]))
            c = F.transform(c, lambda old, i: F.when(i == index, anew).otherwise(old))
        return F.struct(F.coalesce(_feature(s, v["value"]), F.lit(0.0)).alias("x"), c.alias("c"))

    return F.transform(F.transform(state, one), lambda k: F.struct(k["x"].alias("x"), k["c"].alias("c"), A._middle(F.filter(k["c"], lambda c: c.isNotNull())).alias("m")))


def _squares(terms: Column, candidates: int, delta: Column) -> Column:
    """Squared distances to the shrunken centroids, one for each candidate, null for one that no indicator has."""

    def square(b: Column) -> Column:
        def add(sum_: Column, k: Column) -> Column:
            c = F.get(k["c"], b)
            return F.when(c.isNull(), sum_).otherwise(F.coalesce(sum_, F.lit(0.0)) + (k["x"] - A._shrink(c, k["m"], delta)) ** 2)

        return F.aggregate(terms, F.lit(None).cast("double"), add)

    return F.transform(F.sequence(F.lit(0), F.lit(candidates - 1)), square)


def _chances(squares: Column, temperature: Column) -> Column:
    """Softmax over the candidates; 0 for one that is none."""
    raw = F.transform(squares, lambda d: F.coalesce(F.exp((F.array_min(squares) - d) / (2 * temperature)), F.lit(0.0)))
    return F.transform(raw, lambda e: F.try_divide(e, F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)))


def nested_tuning(facts: DataFrame, strips: DataFrame, batch: int = BASELINE, deltas: list[float] = A.SHRINKAGES, temperatures: list[float] = A.TEMPERATURES) -> DataFrame:
    """`sample_id, batch, delta, temperature, assigned, chances, strip_agreement, decision` of every sample of `facts`, from
    statistics, tuning and centroids without it; `strips` (sample_id, strip, kpi, value) are assigned as well.
    `chances` is a map from batch to chance."""
    clean = stored(facts.select("sample_id", "batch", "kpi", finite(F.col("value")).alias("value"), finite(F.col("se")).alias("se")), "nested-facts")
    batches = sorted(r[0] for r in clean.select("batch").distinct().collect())  # batches are few
    if not batches:
        batches = [batch]
    placed = stored(_places(clean), "nested-places")
    order = placed.groupBy("kpi").agg(_middles(placed, batches).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("kpi", "t"))).alias("order"))

    # baseline statistics without each sample; those of other batches share one table
    own = clean.where(F.col("batch") == batch).withColumn("floor", abs_floor(F.col("kpi")))
    base = robust_stats(own, ["kpi"], abs_floor="floor").where("n > 0").select("kpi", "med", "scale")
    stats = B.loo_stats(clean, batch).where("med IS NOT NULL").select("sample_id", "kpi", "med", "scale")
    others = placed.where(F.col("batch") != batch).join(base, "kpi").select("sample_id", "kpi", "med", "scale")
    fitted = placed.join(stats.unionByName(others), ["sample_id", "kpi"])
    scored = fitted.withColumn("z", F.try_divide(F.col("value") - F.col("med"), F.col("scale")))
    decided = B.verdicts(scored).select("sample_id", "decision")

    entry = F.struct("kpi", "med", "scale", "w", "place")
    values = F.map_from_entries(F.collect_list(F.struct("kpi", F.struct("value", "place"))))
    folds = fitted.groupBy("sample_id", "batch").agg(F.sort_array(F.collect_list(entry)).alias("state"))
    inner = placed.groupBy("sample_id", "batch").agg(values.alias("values"))
    folds = folds.withColumn("class", F.sha1(F.to_json(F.struct("batch", "state")))).crossJoin(F.broadcast(order))  # one row
    folds = folds.withColumn("state", _with_centroids(F.col("state"), F.col("batch"), F.col("order"))).drop("order")
    folds = stored(folds.join(inner, ["sample_id", "batch"]), "nested-folds")

    grid = [(d, t) for d in deltas for t in temperatures]
    nothing = {"": [{"n": None, "p0": None, "mid": []}] * len(batches)}
    middles = order.first()["order"] or nothing  # a few numbers for each batch and indicator
    kpis = sorted(middles)

    def index_of(name: Column) -> Column:
        return sum((F.when(name == b, k).otherwise(0) for k, b in enumerate(batches)), F.lit(0))

    def first_place(kpi: str) -> Column:
        return F.element_at(F.array(*[F.lit(t["p0"]).cast("int") for t in middles[kpi]]), index_of(F.col("batch")) + 1)

    def losses(rows: DataFrame, inner_batch: str) -> DataFrame:
        """`rows` with the loss of the judged sample for each pair of the grid."""
        true = index_of(F.col(inner_batch))
        terms = rows.crossJoin(F.broadcast(order)).withColumn("terms", _terms(F.col("state"), F.col("values"), F.col("batch"), F.col(inner_batch), true, F.col("order")))  # one row
        terms = stored(terms.drop("order", "state", "values"), "nested-terms")  # a plan in one piece makes them anew for each candidate and delta
        squares = terms.withColumn("squares", F.transform(F.array(*[F.lit(float(d)) for d in deltas]), lambda d: _squares(F.col("terms"), len(batches), d)))
        heats = F.array(*[F.lit(float(t)) for t in temperatures])

        def loss(squares_: Column, t: Column) -> Column:
            return -F.log(F.greatest(F.get(_chances(squares_, t), true), F.lit(A.LEAST_P)))

        return squares.withColumn("losses", F.flatten(F.transform("squares", lambda q: F.transform(heats, lambda t: loss(q, t)))))

    # States are about 2^k a batch and a few times more in the baseline, some hundred bytes each: blocks of them are broadcast to
    # blocks of samples, so that no pair of a state and a sample is a row.
    n_states, n_samples = folds.select("class").distinct().count(), inner.count()
    held = folds.groupBy("class", "batch").agg(F.first("state").alias("state")).withColumn("state", F.map_from_arrays(F.col("state")["kpi"], F.col("state")))
    nan, nowhere = F.lit(float("nan")), F.lit(K.NONE)
    each = [F.try_element_at("state", F.lit(k)) for k in kpis]
    ends = [first_place(k) for k in kpis]
    states = held.select(
        "class",
        index_of(F.col("batch")).alias("own"),
        *[F.array(*[F.coalesce(s[f], nan) for s in each]).alias(f) for f in ("med", "scale", "w")],
        F.array(*[F.coalesce(s["place"] - p + 1, nowhere) for s, p in zip(each, ends, strict=True)]).alias("place"),
        F.flatten(F.array(*[F.transform(F.coalesce(s["c"], F.array_repeat(nan, len(batches))), lambda c: F.coalesce(c, nan)) for s in each])).alias("c"),
    )

    def blocks(rows: DataFrame, names: list[str], flat: list[str], *keys: Column) -> DataFrame:
        """One row for each of `keys` with the rows' `names` as arrays, those in `flat` as one each."""
        whole = rows.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("l"))
        return whole.select(*[c for c in whole.columns if not c.startswith("__") and c != "l"], *[(F.flatten(F.col("l")[n]) if n in flat else F.col("l")[n]).alias("classes" if n == "class" else n) for n in names])

    def part(name: str, n: int, size: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(max(1, n // size))).alias("__part")

    flat = ["med", "scale", "w", "place", "c"]
    judges = blocks(states, ["class", "own", *flat], flat, part("class", n_states, STATES))
    v = [F.try_element_at("values", F.lit(k)) for k in kpis]
    asked = inner.select("sample_id", index_of(F.col("batch")).alias("inner"), F.array(*[F.coalesce(x["value"], nan) for x in v]).alias("values"), F.array(*[F.coalesce(x["place"] - p + 1, nowhere) for x, p in zip(v, ends, strict=True)]).alias("places"))
    samples = blocks(asked, ["values", "places"], ["values", "places"], F.col("inner"), part("sample_id", n_samples, BLOCK))
    # Few bytes and much work: the number of partitions is given, so that they aren't coalesced.
    met = samples.repartition(max(1, min(len(batches) * max(1, n_samples // BLOCK), MOST_TASKS))).crossJoin(F.broadcast(judges))
    tables = [[K.medians_without(middles[k][b]["n"], middles[k][b]["p0"], middles[k][b]["mid"]) for k in kpis] for b in range(len(batches))]
    with_workers(clean.sparkSession)
    sums = met.mapInArrow(K.judge(tables, deltas, temperatures, A.LEAST_P), "class string, n long, losses array<double>")
    totals = sums.groupBy("class").agg(F.sum("n").alias("n"), *[F.sum(F.get("losses", k)).alias(f"s{k}") for k in range(len(grid))])
    alone = losses(folds.withColumn("inner_batch", F.col("batch")), "inner_batch").select("sample_id", "class", "losses")
    both = alone.join(totals, "class")
    means = F.array(*[F.round((F.col(f"s{k}") - F.get("losses", k)) / (F.col("n") - 1), LOSS_DIGITS) for k in range(len(grid))])
    pairs = F.array(*[F.struct(F.lit(float(d)).alias("delta"), F.lit(float(t)).alias("temperature")) for d, t in grid])
    # Too few samples or batches to tune: the defaults.
    few = (F.col("n") - 1 < 3) | (F.size(F.array_distinct(F.col("others"))) < 2)
    default = F.struct(F.lit(float(deltas[0])).alias("delta"), F.lit(float(sorted(temperatures)[len(temperatures) // 2])).alias("temperature"))
    sizes = clean.select("sample_id", "batch").distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("m")).agg(F.collect_list(F.struct("batch", "m")).alias("sizes"))
    chosen = both.join(folds.select("sample_id", "batch"), "sample_id").crossJoin(F.broadcast(sizes))  # one row
    left = F.transform(F.filter("sizes", lambda s: s["m"] > F.when(s["batch"] == F.col("batch"), 1).otherwise(0)), lambda s: s["batch"])
    chosen = chosen.withColumn("others", left).withColumn("means", means)
    first = F.get(pairs, (F.array_position("means", F.array_min("means")) - 1).cast("int"))
    tuned = stored(chosen.withColumn("pair", F.when(few, default).otherwise(first)).select("sample_id", "pair.delta", "pair.temperature"), "nested-tuned")

    def assigned(rows: DataFrame) -> DataFrame:
        """`rows` (state, batch, values) with their chances as an array and the batch with the largest."""
        terms = rows.join(tuned, "sample_id").withColumn("terms", _terms(F.col("state"), F.col("values"), F.col("batch")))
        out = terms.withColumn("squares", _squares(F.col("terms"), len(batches), F.col("delta"))).withColumn("p", _chances(F.col("squares"), F.col("temperature")))
        even = F.transform("p", lambda p: F.round(p, A.P_DIGITS))
        return out.withColumn("assigned", F.get(F.array(*[F.lit(b) for b in batches]), (F.array_position(even, F.array_max(even)) - 1).cast("int")))

    whole = assigned(folds).select("sample_id", "batch", "delta", "temperature", "assigned", F.map_from_arrays(F.array(*[F.lit(b) for b in batches]), "p").alias("chances"))
    # strips moved so that their mean is the sample's value: only their spread counts
    line = Window.partitionBy("sample_id", "kpi")
    moved = strips.join(clean.select("sample_id", "kpi", F.col("value").alias("image")), ["sample_id", "kpi"]).withColumn("v", F.coalesce(F.col("image") + F.col("value") - F.avg("value").over(line), "image"))
    each = moved.groupBy("sample_id", "strip").agg(F.map_from_entries(F.collect_list(F.struct("kpi", F.struct(F.col("v").alias("value"), F.lit(None).cast("int").alias("place"))))).alias("values"))
    calls = assigned(folds.drop("values").join(each, "sample_id")).select("sample_id", F.col("assigned").alias("call"))
    agreed = calls.join(whole.select("sample_id", "assigned"), "sample_id").groupBy("sample_id").agg(F.avg((F.col("call") == F.col("assigned")).cast("double")).alias("strip_agreement"))
    return whole.join(agreed, "sample_id", "left").join(decided, "sample_id")


def summary(nested: DataFrame, batch: int = BASELINE) -> DataFrame:
    """One row: `n, accuracy, nll, brier, false_alarms, n_baseline, detections, n_other, strip_consistency`."""
    true = F.coalesce(F.try_element_at("chances", F.col("batch")), F.lit(0.0))
    squares = F.aggregate(F.map_values("chances"), F.lit(0.0), lambda a, p: a + p * p) - true**2 + (1 - true) ** 2
    base, alarm = F.col("batch") == batch, F.col("decision") != "ACCEPT"
    return nested.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("assigned") == F.col("batch")).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(true, F.lit(A.LEAST_P)))).alias("nll"),
        F.avg(squares).alias("brier"),
        F.count(F.when(base & alarm, 1)).alias("false_alarms"),
        F.count(F.when(base, 1)).alias("n_baseline"),
        F.count(F.when(~base & alarm, 1)).alias("detections"),
        F.count(F.when(~base, 1)).alias("n_other"),
        F.avg("strip_agreement").alias("strip_consistency"),
    )
