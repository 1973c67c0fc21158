"""The last image of a table may lack rows; what is not there is no pixel."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import same


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """Two whole images and 30 rows of a third."""
    folder = tmp_path_factory.mktemp("cut")
    duckdb.sql(f"COPY (SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet') WHERE vec_id < 130) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["smoothing", "noise_level", "segmentation", "segmentation_kpis", "shape_kpis", "edge_band"])
def test_cut_image(spark, cut, name):
    same(spark, entry.queries()[name], entry.oracle_sql()[name], cut)
