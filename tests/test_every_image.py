"""Images that lack a phase, or all but one level, keep their row in every query, with 0 or null as defined."""

import numpy as np
import pytest

from lamina.plans import raster_queries as R
from lamina.plans import shape_queries as Q
from tests.oracle import SF, same


@pytest.fixture(scope="module")
def lacking(spark, tmp_path_factory):
    """The table's first images, then: all carbon, all pore, all silicon, two levels, and one with a single bright pixel."""
    folder = str(tmp_path_factory.mktemp("lacking"))
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    own = table.where("vec_id < 100").collect()
    flat = {k: np.full((R.HEIGHT, R.WIDTH), (level - 127.5) / 250, np.float32) for k, level in ((2, 130), (3, 50), (4, 180), (5, 60), (6, 120))}
    flat[5][20:30, 20:40] = (230 - 127.5) / 250
    flat[6][7, 9] = (250 - 127.5) / 250
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in own]
    rows += [(k * R.HEIGHT + r, [float(x) for x in image[r]], 0) for k, image in flat.items() for r in range(R.HEIGHT)]
    spark.createDataFrame(rows, table.schema).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture()
def views(monkeypatch, lacking):
    import duckdb

    def connect(sf_dir):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet/*.parquet')")
        return con

    monkeypatch.setattr("tests.oracle.connect", connect)
    return lacking


NAMES = sorted({*R.NOTHING, "morphology", "image_fractions", "material_contrast", "image_gates", "evidence_fusion", "island_removal", "sensitivity", "two_point", "segmentation", "segmentation_kpis"})
NAMES += ["local_thickness", "shape_kpis", "perturbation", "perturbation_robustness"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_values(spark, views, name):
    query = (R.queries() | Q.queries())[name]
    same(spark, query, (R.oracle_sql() | Q.oracle_sql())[name], views)
    out = query(spark, views)
    if "image" in out.columns:
        assert {r["image"] for r in out.select("image").distinct().collect()} == set(range(7))
