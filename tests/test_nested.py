"""Nested tuning against a plain triple loop over samples that do differ by batch."""

import random
from math import exp, log
from statistics import median

import pytest
from pyspark.sql import functions as F

from lamina.operators import assign as A
from lamina.operators import nested as N

KPIS = ["qty_mean", "price_mean", "discount_mean", "open_frac"]
WEIGHTS = dict(zip(KPIS, (1.0, 1.0, 0.7, 0.4), strict=True))
FLOORS = {"discount_mean": 0.005, "open_frac": 0.005}


def centroids(rows, delta):
    """Batch medians by indicator, shrunk towards the median of all."""
    out = {}
    for k in KPIS:
        raw = {b: median([r[2][k] for r in rows if r[1] == b]) for b in {r[1] for r in rows}}
        g = median(raw.values())
        for b, m in raw.items():
            out.setdefault(b, {})[k] = g + (1 if m > g else -1 if m < g else 0) * max(abs(m - g) - delta, 0)
    return out


def chances(x, centres, t):
    d = {b: sum((x[k] - c[k]) ** 2 for k in KPIS) for b, c in centres.items()}
    e = {b: exp((min(d.values()) - v) / (2 * t)) for b, v in d.items()}
    return {b: v / sum(e.values()) for b, v in e.items()}


def top(p):
    return min(p, key=lambda b: (-round(p[b], 9), b))


def brute(rows, strips):
    """`rows`: (sample, batch, {kpi: value}, {kpi: se}); `strips`: {sample: [{kpi: value}]}."""
    out = {}
    for f in rows:
        train = [r for r in rows if r is not f]
        base = [r for r in train if r[1] == 3]
        if not base:
            continue
        stats = {}
        for k in KPIS:
            med = median(r[2][k] for r in base)
            mad = 1.4826 * median(abs(r[2][k] - med) for r in base)
            stats[k] = med, max(mad, median(r[3][k] for r in base), 0.05 * abs(med), FLOORS.get(k, 0)) or 1e-9

        def features(v, stats=stats):
            return {k: (v[k] - stats[k][0]) / stats[k][1] * WEIGHTS[k] for k in KPIS}

        feats = [(r[0], r[1], features(r[2])) for r in train]
        if len(feats) < 3 or len({r[1] for r in feats}) < 2:
            best = (A.SHRINKAGES[0], A.TEMPERATURES[2])
        else:
            tried = []
            for d in A.SHRINKAGES:
                inner = [(i, centroids([r for r in feats if r is not i], d)) for i in feats]
                for t in A.TEMPERATURES:
                    loss = [-log(max(chances(i[2], c, t).get(i[1], 0), 1e-3)) for i, c in inner]
                    tried.append((round(sum(loss) / len(loss), 9), d, t))
            best = min(tried)[1:]
        centres = centroids(feats, best[0])
        p = chances(features(f[2]), centres, best[1])
        own = strips[f[0]]
        mean = {k: sum(s[k] for s in own) / len(own) for k in KPIS}
        calls = [top(chances(features({k: f[2][k] + s[k] - mean[k] for k in KPIS}), centres, best[1])) for s in own]
        z = [abs(f[2][k] - stats[k][0]) / stats[k][1] for k in KPIS]
        bad = max(z) > 12.8 or sum(x > 8 for x in z) >= 3
        decision = "REJECT" if bad else "INVESTIGATE" if max(z) > 8 or sum(x > 6.4 for x in z) >= 2 else "ACCEPT"
        out[f[0]] = (f[1], *best, top(p), {b: round(v, 7) for b, v in p.items()}, round(sum(c == top(p) for c in calls) / len(calls), 7), decision)
    return out


def frames(spark, rows, strips):
    facts = [(s, b, k, v[k], se[k]) for s, b, v, se in rows for k in KPIS]
    parts = [(s, n, k, x[k]) for s, own in strips.items() for n, x in enumerate(own) for k in KPIS]
    return spark.createDataFrame(facts, "sample_id long, batch long, kpi string, value double, se double"), spark.createDataFrame(parts, "sample_id long, strip int, kpi string, value double")


@pytest.mark.parametrize(("sizes", "shift", "grain"), [({1: 6, 2: 5, 3: 7}, 1.5, None), ({1: 1, 3: 4, 4: 2}, 3.0, 1), ({3: 2, 5: 1}, 1.0, None), ({2: 4, 3: 3}, 0.3, 0)])
def test_is_the_triple_loop(spark, sizes, shift, grain):
    rng = random.Random(f"{sizes}{shift}")
    rows, strips = [], {}
    for b, n in sizes.items():
        for _ in range(n):
            v = {k: 10 + j + (shift * (b - 3) if j < 3 else 0) + rng.gauss(0, 1) for j, k in enumerate(KPIS)}
            if grain is not None:  # ties
                v = {k: round(x, grain) for k, x in v.items()}
            rows.append((len(rows), b, v, {k: 0.1 * rng.random() for k in KPIS}))
            strips[len(rows) - 1] = [{k: x + rng.gauss(0, 2) for k, x in v.items()} for _ in range(5)]
    got = {r["sample_id"]: (r["batch"], r["delta"], r["temperature"], r["assigned"], {b: round(p, 7) for b, p in r["chances"].items()}, round(r["strip_agreement"], 7), r["decision"]) for r in N.nested_tuning(*frames(spark, rows, strips)).collect()}
    want = brute(rows, strips)
    assert set(got) == set(want)
    for s, (*most, p, share, decision) in want.items():
        *own, q, own_share, own_decision = got[s]
        assert (own, own_share, own_decision) == (most, share, decision)
        assert {b: x for b, x in q.items() if x or b in p} == pytest.approx(p, abs=1e-6)


def test_states_do_not_follow_the_samples(spark):
    """Many samples share few states, so inner samples meet far fewer states than folds."""
    rows = spark.range(4000).selectExpr("id AS sample_id", "id % 4 AS batch", "explode(array('qty_mean', 'price_mean')) AS kpi").withColumn("value", F.rand(7))
    placed = N._places(rows)
    states = placed.groupBy("sample_id", "batch").agg(F.sort_array(F.collect_list(F.struct("kpi", "place"))).alias("state"))
    assert states.select("batch", "state").distinct().count() < 4 * 40


def test_median_without(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 5, 8, 9):
        values = sorted(rng.choice([1.0, 2.0, 3.5, rng.random()]) for _ in range(n))
        rows = spark.createDataFrame([(k, 1, "x", v) for k, v in enumerate(values)], "sample_id long, batch long, kpi string, value double")
        placed = N._places(rows)
        t = placed.groupBy("kpi").agg(N._middles(placed, [1]).alias("t"))
        places = placed.select("sample_id", "rank", "place")
        a, b = places.toDF("ia", "ra", "a"), places.toDF("ib", "rb", "b")
        both = a.crossJoin(b).where("ia <> ib").crossJoin(t)
        got = both.select("ia", "ib", N.median_without(F.col("t")[0], F.col("a"), F.col("b")).alias("m"), N.median_without(F.col("t")[0], F.col("a"), F.lit(None).cast("int")).alias("one")).collect()
        for r in got:
            left = [v for k, v in enumerate(sorted(values)) if k not in (r["ia"], r["ib"])]
            assert r["m"] == (median(left) if left else None)
            assert r["one"] == median([v for k, v in enumerate(sorted(values)) if k != r["ia"]])


def test_nothing(spark):
    facts, strips = frames(spark, [], {})
    assert N.nested_tuning(facts, strips).count() == 0
    assert N.summary(N.nested_tuning(facts, strips)).first()["n"] == 0
