"""Local thickness by tiles with margins: the same as of whole masks, and pixels move about once."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lamina.operators import thickness as T
from tests.oracle import same
from tests.test_thickness import drawn, frames, thickness

RADII = [1, 3, 8, 9]


def moved(frame, by):
    return frame.selectExpr("image", f"r + {by} AS r", f"c + {by} AS c")


@pytest.mark.parametrize(("factor", "by"), [(1, 0), (1, -33), (2, 0), (2, 62)])
def test_tiles_and_margins(spark, monkeypatch, factor, by):
    monkeypatch.setattr(T, "TILE", 16)
    masks = drawn()
    on, off = (moved(f, by) for f in frames(spark, masks))
    want = {k: thickness(m, factor, RADII) for k, m in masks.items()}
    got = T.local_thickness(on, off, factor, RADII).collect()
    assert len(got) == sum(int(m.sum()) for m in masks.values())
    for x in got:
        w = want[x["image"]][x["r"] - by, x["c"] - by]
        assert x["t"] is None if np.isnan(w) else x["t"] == w


def test_both_sides(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 16)
    masks = drawn()
    on, off = frames(spark, masks)
    pixels = on.selectExpr("*", "true AS on").unionByName(off.selectExpr("*", "false AS on"))
    got = T.both_sides(pixels, 1, RADII).collect()
    assert len(got) == sum(m.size for m in masks.values())
    want = {(k, side): thickness(m == side, 1, RADII) for k, m in masks.items() for side in (True, False)}
    for x in got:
        w = want[x["image"], x["on"]][x["r"], x["c"]]
        assert x["t"] is None if np.isnan(w) else x["t"] == w


def shuffled(spark, df):
    """How many rows the exchanges of `df` write."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.range(1).collect()

    def stages():
        none = spark._jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    df.collect()
    return sum(n for k, n in stages().items() if k not in before)


def test_pixels_move_once(spark):
    """Once to their tile, and the measured ones to the join that tells whether anything bounds their image."""
    rng = np.random.default_rng(5)
    masks = {k: rng.random((50, 64)) < 0.9 for k in range(3)}
    n = sum(m.size for m in masks.values())
    assert n <= shuffled(spark, T.local_thickness(*frames(spark, masks), 1)) <= 2 * n + 100


def test_large_images_fill_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 16)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = T.local_thickness(*frames(spark, {0: np.arange(120 * 120).reshape(120, 120) % 7 > 0}), 1, [1, 2])
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(name, before)
    assert max(n for _, n in tasks) < 0.6 * sum(n for _, n in tasks)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Two whole images, 30 rows of a third, rows given twice, and rows without a number."""
    folder = tmp_path_factory.mktemp("odd")
    table = "read_parquet('/root/testdata/sf0.01/embeddings.parquet')"
    parts = [f"SELECT * FROM {table} WHERE vec_id < 130", f"SELECT 10 + vec_id % 3 AS vec_id, embedding, label FROM {table} WHERE vec_id BETWEEN 200 AND 204"]
    parts += [f"SELECT NULL AS vec_id, embedding, label FROM {table} WHERE vec_id < 2"]
    duckdb.sql(f"COPY ({' UNION ALL '.join(parts)}) TO '{folder}/embeddings.parquet'")
    return str(folder)


def test_odd_table(spark, odd):
    same(spark, entry.queries()["local_thickness"], entry.oracle_sql()["local_thickness"], odd)
