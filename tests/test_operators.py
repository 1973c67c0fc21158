import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lamina.functions.robust import loo_median, robust_stats, weighted_quantiles
from lamina.operators import assign as A
from lamina.operators import baseline as B
from lamina.operators import grid as G
from lamina.operators import validate as V
from lamina.sources import samples as S
from lamina.sources.stores import Snapshots, StageCache, stage_key


def test_constant_series_gets_the_relative_floor(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0)] * 3, "k int, value double, se double")
    got = robust_stats(rows, ["k"]).first()
    assert (got["n"], got["med"], got["scale"]) == (3, 1.0, 0.05)


def test_statistics_skip_missing_values(spark):
    rows = spark.createDataFrame([(1, v, None) for v in (1.0, float("nan"), None, 3.0, float("inf"))] + [(2, None, None)], "k int, value double, se double")
    got = {r["k"]: r for r in robust_stats(rows, ["k"]).collect()}
    assert (got[1]["n"], got[1]["med"]) == (2, 2.0)
    assert got[2]["n"] == 0 and got[2]["scale"] is None


@pytest.mark.parametrize("n", [1, 2, 3, 6, 9])
def test_leave_one_out_median(spark, n):
    values = np.random.default_rng(n).integers(0, 5, n).astype(float).tolist()
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, id int, v double")
    got = {r["id"]: r["m"] for r in loo_median(rows, ["k"], "v", "m", "id").collect()}
    for i in range(n):
        rest = values[:i] + values[i + 1 :]
        assert got[i] == (float(np.median(rest)) if rest else None)


def test_weighted_quantile_clamps_below_the_first_point(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 4.0, 2.0)], "k int, x double, w double")
    got = {r["q"]: r["value"] for r in weighted_quantiles(rows, ["k"], "x", "w", [0.1, 0.5, 0.75]).collect()}
    assert got == {0.1: 1.0, 0.5: 2.0, 0.75: 3.0}


def test_separable_batches_are_told_apart(spark):
    rng = np.random.default_rng(0)
    rows = []
    for b in (1, 2, 3):
        for i in range(5):
            for j, k in enumerate(("qty_mean", "price_mean", "unit_price_mean", "discount_mean")):
                rows.append((f"s{b}{i}", b, k, 10.0 + j + {1: 3, 2: -3, 3: 0}[b] * (j < 3) + float(rng.normal(0, 0.3)), 0.1))
    facts = spark.createDataFrame(rows, "sample_id string, batch long, kpi string, value double, se double")
    chances = V.nested_loio(facts)
    top = A.best(chances, ["sample_id"])
    assert top.where("candidate = batch").count() == 15
    for r in chances.groupBy("sample_id").agg(F.sum("p").alias("s")).collect():
        assert math.isclose(r["s"], 1.0)
    scores = B.top_score(B.zscores(facts, B.baseline(facts)))
    ranks = B.conformal(scores, B.loo_scores(facts)).collect()
    assert all(math.isclose(r["p_floor"], 1 / 6) and r["p_rank"] >= r["p_floor"] - 1e-12 for r in ranks)
    grid = A.tuning(A.features(B.zscores(facts, B.baseline(facts))))
    assert grid.count() == 20 and A.choose(grid)[0] in A.SHRINKAGES


def test_components_of_a_spiral(spark):
    art = ["#####", "....#", "###.#", "#...#", "#####"]
    pixels = spark.createDataFrame([Row(row=r, col=c, on=x == "#") for r, line in enumerate(art) for c, x in enumerate(line)])
    sizes = G.component_sizes(G.components(pixels)).collect()
    assert [s["n_pixels"] for s in sizes] == [sum(line.count("#") for line in art)]
    assert G.percolation(spark.createDataFrame(sizes), 5, 5).first()["across"] == 1.0
    assert G.euler_number(pixels).first()["euler"] == 1


def test_runs_touching_the_frame_are_dropped(spark):
    pixels = spark.createDataFrame([(0, c, x == "#") for c, x in enumerate("##.###.#")], "row int, col int, on boolean")
    assert [r["length"] for r in G.chords(pixels, "row", "col").collect()] == [3]


@pytest.mark.parametrize(
    ("name", "sample", "channel", "se"),
    [
        ("img_abc123_BSE.tif", "img_abc123", "BSE", False),
        ("Batch_3_img_0grcilhi_Inlens.tif", "img_0grcilhi", "Inlens", False),
        ("img_rxax5ozo_SE.tif", "img_rxax5ozo", "ETD", True),
        ("IMG_X1_etd.TIFF", "img_x1", "ETD", False),
        ("notes.txt", None, None, None),
    ],
)
def test_names(spark, name, sample, channel, se):
    got = spark.createDataFrame([(name,)], "n string").select(*[c.alias(k) for k, c in S.parse_name(F.col("n")).items()]).first()
    assert (got["sample_id"], got["channel"], got["etd_is_se"]) == (sample, channel, se)


def test_discovery_of_a_tree(spark, tmp_path):
    for place in ("Batch_1/img_a1_BSE.tif", "Batch_1/img_a1_SE.tif", "Batch_1/img_a1_Inlens.tif", "x/Batch 2/img_b2_BSE.tif", "test/Batch_3_img_c3_BSE.tif", "Batch_1/img_d4_ETD.tif"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(place.encode())
    got = {r["sample_id"]: r for r in S.discover(spark, str(tmp_path)).collect()}
    assert {k: (r["batch"], r["complete"], r["etd_is_se"]) for k, r in got.items()} == {"img_a1": ("1", True, True), "img_b2": ("2", False, False), "img_c3": ("unknown", False, False)}
    (tmp_path / "Batch_1/Batch_2_img_e5_BSE.tif").write_bytes(b"x")
    with pytest.raises(Exception, match="the folder's is 1"):
        S.discover(spark, str(tmp_path)).collect()


def test_stage_cache_and_snapshots(spark, tmp_path):
    inputs = spark.createDataFrame([("a",), ("b",)], "fingerprint string")
    key = stage_key("kpis", {"x": 1, "report": 2}, "1", skip=("report",))
    assert key == stage_key("kpis", {"x": 1, "report": 3}, "1", skip=("report",)) != stage_key("kpis", {"x": 2}, "1")
    cache = StageCache(spark, str(tmp_path / "cache"), key)
    assert cache.stale(inputs).count() == 2
    cache.add(spark.createDataFrame([("a", 1.0)], "fingerprint string, v double"))
    assert [r[0] for r in cache.stale(inputs).collect()] == ["b"]
    assert StageCache(spark, str(tmp_path / "cache"), "other").stale(inputs).count() == 2
    snaps = Snapshots(spark, str(tmp_path / "snaps"))
    facts = spark.createDataFrame([("s", "k", 1.0)], "sample_id string, kpi string, value double")
    assert snaps.last() is None and [snaps.accept(facts) for _ in range(11)][-1] == 11 and snaps.numbers()[-1] == 11


def test_snapshot_rules(spark):
    old = spark.createDataFrame([("a", "x", 1.0), ("b", "x", None), ("c", "x", 1.0), ("d", "f", 1.0)], "sample_id string, kpi string, value double")
    new = spark.createDataFrame([("a", "x", 1.05), ("b", "x", None), ("c", "x", None), ("d", "f", 1.011)], "sample_id string, kpi string, value double")
    stats = spark.createDataFrame([("x", 1.0), ("f", 10.0)], "kpi string, scale double")
    got = {r["sample_id"]: r["changed"] for r in V.snapshot_diff(old, new, stats, F.col("kpi") == "f").collect()}
    assert got == {"a": False, "c": True, "d": True}


def test_stability_is_that_of_bootstrap_means(spark):
    """Three of five strips agree, yet means of strips agree far more often."""
    strips = [(1, k, "u", x) for k, x in enumerate([0.0, 0.0, 0.0, 1.1, 1.1])]
    centres = spark.createDataFrame([(1, "u", 0.0), (2, "u", 2.0)], "batch long, kpi string, c double")
    moved = spark.createDataFrame(strips, "sample_id long, strip long, kpi string, x double")
    assigned = spark.createDataFrame([(1, 1)], "sample_id long, assigned long")
    picks = np.random.default_rng(0).integers(0, 5, size=(1000, 5))
    means = np.array([x for *_, x in strips])[picks].mean(axis=1)
    got = A.stability(moved, centres, assigned).collect()[0]["stability"]
    assert got == (abs(means) <= abs(means - 2)).mean() and got > 0.9


def test_signatures_withdraw_and_force_novelty(spark):
    found = spark.createDataFrame([(i, 9.0, 0.1, i < 3) for i in range(5)], "sample_id long, dmin double, id_score double, novel boolean")
    assigned = spark.createDataFrame([(i, 1) for i in range(5)], "sample_id long, assigned long")
    matches = spark.createDataFrame([(0, 1, 1.5), (1, 1, 1.4), (2, 2, 3.0), (4, 1, 1.6)], "sample_id long, signature long, match double")
    signs = spark.createDataFrame([(1, "u", True), (1, "v", False)], "batch long, kpi string, in_signature boolean")
    scored = spark.createDataFrame([(i, k, z) for i in range(5) for k, z in (("u", 50.0), ("v", -13.0 if i > 2 else 1.0))], "sample_id long, kpi string, z double")
    ways = A.new_way(scored, signs, matches)
    got = {r["sample_id"]: r["novel"] for r in A.novelty_by_signature(found, assigned, matches, ways).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: False}
