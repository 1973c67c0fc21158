"""Queries of the image and simulation layers. Array kernels have no SQL; their closed-form parts do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.bootstrap import intervals, literal
from lamina.functions.tables import with_workers
from lamina.operators import facts as X
from lamina.operators import image as I
from lamina.operators import transport as T
from lamina.plans.baseline_queries import _LINES, rounded

TILE_ROWS = 50


def image_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array kernels over the grey images that embeddings make up."""
    from lamina.plans.raster_queries import pixels

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        image = np.zeros((int(part["r"].max()) + 1, int(part["c"].max()) + 1), np.uint8)
        image[part["r"].to_numpy(), part["c"].to_numpy()] = part["g"].to_numpy()
        return pd.DataFrame({"sample_id": [f"image{key[0]}"], "height": [image.shape[0]], "width": [image.shape[1]], "pixels": [image.tobytes()]})

    return rounded(I.measure(pixels(with_workers(spark), sf_dir).groupBy("image").applyInPandas(draw, I.IMAGE)), "value")


def raster_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulation on tiles of the embedding raster: negative values are pores, large ones silicon."""
    rows = X.table(with_workers(spark), sf_dir, "embeddings").select(F.floor(F.col("vec_id") / TILE_ROWS).alias("tile"), "vec_id", "embedding")

    def tile(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        values = np.stack(part.sort_values("vec_id")["embedding"].to_numpy())
        labels = np.where(values < -0.05, T.PORE, np.where(values > 0.15, T.SILICON, T.CARBON)).astype(np.uint8)
        return pd.DataFrame({"sample_id": [f"tile{key[0]}"], "height": [labels.shape[0]], "width": [labels.shape[1]], "pixels": [labels.tobytes()]})

    return rounded(T.simulate(rows.groupBy("tile").applyInPandas(tile, I.IMAGE)), "value")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals(X.strip_facts(spark, sf_dir), ["sample_id", "kpi"]), "lo", "hi")


def simulation_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form indices with a supplier's discount as relative diffusivity and its returned share as porosity."""
    facts = X.facts(spark, sf_dir)
    wide = facts.groupBy("sample_id", "batch").pivot("kpi", ["discount_mean", "returned_frac", "open_frac"]).agg(F.first("value"))
    d, deep, si = F.col("discount_mean"), F.col("returned_frac"), F.col("open_frac")
    base = wide.where(F.col("batch") == X.BASELINE).agg(F.percentile("discount_mean", F.lit(0.5)).alias("d0"), F.percentile("returned_frac", F.lit(0.5)).alias("e0"))
    both = wide.crossJoin(F.broadcast(base))  # one row
    eps = T.porosity(deep, F.col("e0"), True)
    out = both.select("sample_id", T.diffusion_time(d).alias("t_diffusion_s"), T.limiting_current(d).alias("i_lim"), eps.alias("porosity"), T.energy_density(eps, si).alias("energy"), T.plating_risk(d, F.col("d0")).alias("plating"))
    return rounded(out, "t_diffusion_s", "i_lim", "porosity", "energy", "plating")


def simulation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.summary(X.facts(spark, sf_dir), ["batch"]), "median", "p10", "p90", digits=6)


def queries() -> dict:
    return {f.__name__: f for f in (image_kpis, raster_transport, bootstrap_ci, simulation_indices, simulation_summary)}


def oracle_sql() -> dict[str, str]:
    from lamina.plans.baseline_queries import FACTS
    from lamina.plans.nested_queries import _STRIP_FACTS

    return {
        "bootstrap_ci": "WITH "
        + _LINES
        + f""",
s AS ({_STRIP_FACTS}),
p AS (SELECT *, row_number() OVER (PARTITION BY sample_id, kpi ORDER BY strip) - 1 AS pos, count(*) OVER (PARTITION BY sample_id, kpi) AS n FROM s),
m AS (SELECT sample_id, kpi, b, sum(times * value) / sum(times) AS m FROM p JOIN {literal(X.STRIPS)} d ON d.n = p.n AND d.pos = p.pos GROUP BY ALL)
SELECT sample_id, kpi, round(quantile_cont(m, 0.025), 8) AS lo, round(quantile_cont(m, 0.975), 8) AS hi FROM m GROUP BY ALL""",
        "simulation_indices": "WITH "
        + _LINES
        + """,
w AS (SELECT sample_id, batch, avg(l_discount) AS d, avg((l_returnflag = 'R')::INT) AS r, avg((l_linestatus = 'O')::INT) AS o FROM lines GROUP BY ALL),
b AS (SELECT median(d) AS d0, median(r) AS r0 FROM w WHERE batch = 3),
e AS (SELECT *, least(greatest(0.30::DOUBLE + r - coalesce(r0, r), 0.05::DOUBLE), 0.8::DOUBLE) AS eps FROM w, b)
SELECT sample_id, round(CASE WHEN d > 0 THEN 70e-6::DOUBLE ** 2 / (1.77e-10::DOUBLE * d) END, 8) AS t_diffusion_s,
       round(CASE WHEN d > 0 THEN 2 * 96485.33212::DOUBLE * 1000 * 1.77e-10::DOUBLE * d / ((1 - 0.2594::DOUBLE) * 70e-6::DOUBLE) END, 8) AS i_lim,
       round(eps, 8) AS porosity,
       round((1 - eps) * (o * 2.33::DOUBLE * 1700 + greatest(1 - o - 0.08::DOUBLE, 0) * 2.26::DOUBLE * 360), 8) AS energy,
       round(CASE WHEN d > 0 THEN d0 / d END, 8) AS plating FROM e""",
        "simulation_summary": FACTS + " SELECT batch, kpi, count(value) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM facts GROUP BY batch, kpi",
    }
