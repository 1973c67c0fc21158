"""Queries of report tables, manifests and scalar families, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import assign as A
from lamina.operators import baseline as B
from lamina.operators import facts as X
from lamina.operators import reports as R
from lamina.operators import transport as T
from lamina.operators import validate as V
from lamina.plans import assign_queries, baseline_queries, source_queries, validate_queries
from lamina.plans.baseline_queries import _LINES, _LOO, FACTS, STATS, rounded
from lamina.sources import samples as S
from lamina.sources import stores

ORDER = [i.name for i in X.INDICATORS]
#: Largest concentrations and the positive electrode of the cell.
GRAPHITE, SILICON, POSITIVE = 28700.0, 278000.0, (0.665, 63104.0)
NEGATIVE_UM, POSITIVE_UM = 70.0, 75.6


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.drivers(baseline_queries.scored(spark, sf_dir), ORDER, 4), "z")


def top_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = V.effect_sizes(X.facts(spark, sf_dir), X.abs_floor(F.col("kpi")))
    return rounded(R.largest(effects, ["a", "b"], "effect", "kpi", 2).select("a", "b", "place", "kpi", "effect"), "effect")


def kpi_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.changes(validate_queries.snapshot_diff(spark, sf_dir))


def describe_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.described(X.facts(spark, sf_dir), ["kpi"], "value"), "mean", "sd", "least", "q25", "q50", "q75", "most", digits=6)


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.samples(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


def median_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and means of the indicators, a column for each batch."""
    facts = X.facts(spark, sf_dir).where("batch IN (1, 2, 3)")
    wide = facts.groupBy("kpi").pivot("batch", [1, 2, 3]).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"))
    names = {f"{b}_{s}": f"{s}_{b}" for b in (1, 2, 3) for s in ("median", "mean")}
    return rounded(wide.withColumnsRenamed(names), *names.values(), digits=6)


def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), "c_acctbal", F.length("c_name").cast("double").alias("name_length"))
    return R.present(wide, ["sample_id"], ["c_acctbal", "not_there", "name_length"])


def path_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by the closest folder that names one; folders of unknown batch win over all."""
    n = F.col("page_id")
    folder = F.element_at(F.array(*[F.lit(f) for f in ("Batch 2", "batch_1/deep/Batch-3", "batch_2/Test", "plain", "x/UNKNOWN/y")]), (F.pmod(n, F.lit(5)) + 1).cast("int"))
    prefix = F.when(F.pmod(n, F.lit(5)) == 2, "Batch_7_").otherwise("")
    path = F.concat(folder, F.lit("/"), prefix, F.lit("IMG_"), n.cast("string"), F.lit("_bse.TIFF"))
    return S.parsed(X.table(spark, sf_dir, "pages").select(path.alias("path"))).select("path", "sample_id", "prefix_batch", "batch")


def pixel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = X.table(spark, sf_dir, "part")
    size = R.pixel_nm(F.col("p_retailprice"), F.pmod("p_size", F.lit(4)).cast("double"), F.pmod("p_partkey", F.lit(3)) + 1)
    return rounded(part.select("p_partkey", size.alias("px_nm")), "px_nm", digits=4)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manifest(S.group(S.parsed(source_queries._names(spark, sf_dir))))


def fetch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that the table says against those of the texts that are there."""
    docs = X.table(spark, sf_dir, "documents")
    title = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    said = docs.select(title.alias("title"), F.col("n_chars").alias("size_bytes"))
    there = docs.where(F.length("text") % 7 != 0).select(F.concat(F.lit("files/"), title).alias("path"), (F.length("text") - (F.length("text") % 5 == 0).cast("int")).cast("long").alias("length"))
    return S.manifest_sizes(said, there)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve digits over the contents of a sample's channels in order: lines are samples, their statuses channels."""
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("channel"), F.col("o_orderkey"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"))
    first = rows.groupBy("sample_id", "channel").agg(F.min_by("sha", "o_orderkey").alias("sha"))
    return S.fingerprint(first)


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = X.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long, absent string").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.count("p.absent").alias("n_absent"))


def created_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return X.table(spark, sf_dir, "events").select("event_id", own.alias("created"), F.substring(own, 1, 10).alias("day"))


def _zones(scored: DataFrame) -> DataFrame:
    return B.verdicts(scored).select("sample_id", "batch", "decision")


def holdout_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline samples against a baseline without them."""
    left = B.loo_stats(X.facts(spark, sf_dir)).withColumn("z", F.try_divide(F.col("value") - F.col("med"), F.col("scale")))
    return _zones(left)


def alarm_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms among baseline samples, each held out, and detections among the others."""
    others = _zones(baseline_queries.scored(spark, sf_dir)).where(F.col("batch") != X.BASELINE)
    both = holdout_verdicts(spark, sf_dir).unionByName(others)
    kind = F.when(F.col("batch") == X.BASELINE, "false_alarms").otherwise("detections")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("decision") == "REJECT", 1)).alias("rejected"), F.count(F.when(F.col("decision") != "ACCEPT", 1)).alias("not_accepted"))


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of shrinkage and temperature that leave-one-out likelihood prefers; the first of equals."""
    delta, temperature = A.choose(A.tuning(assign_queries.vectors(spark, sf_dir)))
    return spark.createDataFrame([(float(delta), float(temperature))], "delta double, temperature double")


def relative_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of a sample over the baseline's medians, and its cycle-life index."""
    names = ["discount_mean", "returned_frac", "open_frac", "qty_mean"]
    wide = X.facts(spark, sf_dir).groupBy("sample_id", "batch").pivot("kpi", names).agg(F.first("value"))
    base = wide.where(F.col("batch") == X.BASELINE).agg(*[F.percentile(n, F.lit(0.5)).alias(f"b_{n}") for n in names])
    both = wide.crossJoin(F.broadcast(base))  # one row
    life = T.cycle_life({"f_si": (F.col("open_frac"), F.col("b_open_frac")), "d50": (F.col("qty_mean"), F.col("b_qty_mean")), "buffer": (F.lit(None).cast("double"), F.col("b_qty_mean")), "contact": (F.col("returned_frac"), F.col("b_returned_frac"))})
    ratios = R.relative(wide, ["sample_id"], names, F.col("batch") == X.BASELINE)
    return rounded(ratios.join(both.select("sample_id", life.alias("cli")), "sample_id"), *names, "cli")


def cell_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.facts(spark, sf_dir).groupBy("sample_id").pivot("kpi", ["returned_frac", "discount_mean"]).agg(F.first("value"))
    eps = T.porosity(F.col("returned_frac"), F.lit(None).cast("double"), False)
    share = R.cell_fractions(eps, F.col("discount_mean"))
    ratio = R.capacity_ratio([(share["graphite"], GRAPHITE), (share["silicon"], SILICON)], NEGATIVE_UM, POSITIVE, POSITIVE_UM)
    return rounded(wide.select("sample_id", share["graphite"].alias("graphite"), share["silicon"].alias("silicon"), ratio.alias("np_ratio")), "graphite", "silicon", "np_ratio")


def size_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = X.table(spark, sf_dir, "lineitem").select(F.when(q < 10, "small").when(q < 25, "middle").otherwise("large").alias("size_class"), "l_discount", (q * q).alias("area"))
    return rounded(R.weighted_mean(rows, ["size_class"], "l_discount", "area"), "mean")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a Markdown table for each sample."""
    verdicts = baseline_queries.verdict_zones(spark, sf_dir)
    first = R.drivers(baseline_queries.scored(spark, sf_dir), ORDER, 1).select("sample_id", "kpi", "direction")
    cells = [F.col("sample_id").cast("string"), F.concat(F.lit("**"), F.col("decision"), F.lit("**")), F.format_string("%d/%d", "n_reject", "n_investigate"), F.coalesce(F.concat_ws(" ", "kpi", "direction"), F.lit("n/a"))]
    return verdicts.join(first, "sample_id", "left").select("sample_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def first_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 points of a scatter plot, which is all that it draws."""
    at = [F.round(F.col("embedding")[k].cast("double"), 6).alias(n) for k, n in ((0, "x"), (1, "y"))]
    return X.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(300).select("vec_id", *at)


def stale_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a cached result of a stage: results are there for two of three, under either of two keys."""
    pages = X.table(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("fingerprint"))
    key = F.when(F.pmod("page_id", F.lit(2)) == 0, stores.stage_key("segment", {"sigma": 1.5}, "1")).otherwise(stores.stage_key("segment", {"sigma": 2.0}, "1"))
    results = pages.where("page_id % 3 <> 1").select("fingerprint", key.alias("stage_key"))
    return stores.stale(pages, results, stores.stage_key("segment", {"sigma": 1.5}, "1")).select("page_id", "fingerprint")


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered snapshots in order of their numbers, each with the one before."""
    from pyspark.sql import Window

    name = F.concat(F.lit("kpis_"), F.col("n_nationkey") * 3, F.lit(".csv"))
    number = F.regexp_extract(name, r"^kpis_([0-9]+)\.csv$", 1).cast("long")
    files = X.table(spark, sf_dir, "nation").select(name.alias("name"), number.alias("number"))
    return files.withColumn("previous", F.lag("number").over(Window.orderBy("number")))  # as many rows as snapshots were taken


def verdict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each sample: its verdict and its first drivers."""
    verdicts = baseline_queries.verdict_zones(spark, sf_dir)
    first = R.drivers(baseline_queries.scored(spark, sf_dir), ORDER, 3).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kpi", "direction"))), lambda d: F.struct(d["kpi"].alias("kpi"), d["direction"].alias("direction"))).alias("drivers"))
    body = F.struct("sample_id", F.struct("batch", "decision", "n_reject").alias("verdict"), "drivers")
    return verdicts.join(first, "sample_id").select("sample_id", F.to_json(body).alias("document"))


QUERIES = (
    drivers, top_effects, kpi_changes, describe_kpis, batch_counts, median_pivot, present_columns, path_batches, pixel_sizes, manifest, fetch_check, fingerprints, event_properties,
    created_times, holdout_verdicts, alarm_rates, tuned, relative_indices, cell_mapping, size_class_means, report_lines, first_points,
    stale_stages, snapshot_files, verdict_documents,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_DRIVERS = f"""
ord AS (SELECT unnest({ORDER}) AS kpi, unnest(range(1, {len(ORDER) + 1})) AS pos),
drv AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY round(abs(z), 9) DESC, pos) AS place, kpi, z,
               CASE WHEN z > 0 THEN 'high' WHEN z < 0 THEN 'low' ELSE 'equal' END AS direction FROM scored JOIN ord USING (kpi) WHERE z IS NOT NULL)"""
_ZONES = "CASE WHEN count(*) FILTER (abs(z) > 12.8) > 0 OR count(*) FILTER (abs(z) > 8) >= 3 THEN 'REJECT' WHEN count(*) FILTER (abs(z) > 8) > 0 OR count(*) FILTER (abs(z) > 6.4) >= 2 THEN 'INVESTIGATE' ELSE 'ACCEPT' END"
_HELD = f"held AS (SELECT sample_id, 3::BIGINT AS batch, {_ZONES} AS decision FROM loo_z GROUP BY sample_id)"


def oracle_sql() -> dict[str, str]:
    verdict = baseline_queries.oracle_sql()["verdict_zones"]
    wide = "w AS (SELECT sample_id, batch, avg(l_discount) AS discount_mean, avg((l_returnflag = 'R')::INT) AS returned_frac, avg((l_linestatus = 'O')::INT) AS open_frac, avg(l_quantity) AS qty_mean FROM lines GROUP BY ALL)"
    names = ["discount_mean", "returned_frac", "open_frac", "qty_mean"]
    pivot = ", ".join(f"round(median(value) FILTER (batch = {b}), 6) AS median_{b}, round(avg(value) FILTER (batch = {b}), 6) AS mean_{b}" for b in (1, 2, 3))
    return {
        "drivers": STATS + "," + _DRIVERS + " SELECT sample_id, place, kpi, round(z, 8) AS z, direction FROM drv WHERE place <= 4",
        "top_effects": f"SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY effect DESC, kpi) AS place, kpi, effect FROM ({validate_queries.oracle_sql()['effect_size']}) QUALIFY place <= 2",
        "kpi_changes": f"SELECT kpi, count(*) AS n_changed, max(delta_scale) AS largest FROM ({validate_queries.oracle_sql()['snapshot_diff']}) WHERE changed GROUP BY kpi",
        "describe_kpis": FACTS
        + """ SELECT kpi, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q25,
round(median(value), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS most FROM facts GROUP BY kpi""",
        "batch_counts": "SELECT n_regionkey::BIGINT AS batch, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
        "median_pivot": FACTS + f" SELECT kpi, {pivot} FROM facts WHERE batch IN (1, 2, 3) GROUP BY kpi",
        "present_columns": "SELECT c_custkey AS sample_id, 'c_acctbal' AS kpi, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'name_length', length(c_name)::DOUBLE FROM customer",
        "path_batches": """
WITH p AS (SELECT page_id AS n, page_id % 5 AS m FROM pages)
SELECT ['Batch 2', 'batch_1/deep/Batch-3', 'batch_2/Test', 'plain', 'x/UNKNOWN/y'][m + 1] || '/' || CASE WHEN m = 2 THEN 'Batch_7_' ELSE '' END || 'IMG_' || n || '_bse.TIFF' AS path,
       'img_' || n AS sample_id, CASE WHEN m = 2 THEN '7' END AS prefix_batch, CASE m WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE 'unknown' END AS batch FROM p""",
        "pixel_sizes": """
SELECT p_partkey, round(CASE WHEN p_size % 4 = 0 OR p_partkey % 3 = 0 OR p_retailprice / (p_size % 4) <= 1 THEN NULL
  ELSE 1e9::DOUBLE * CASE WHEN p_partkey % 3 = 1 THEN 0.0254::DOUBLE ELSE 0.01::DOUBLE END / (p_retailprice / (p_size % 4)) END, 4) AS px_nm FROM part""",
        "manifest": source_queries._NAMES
        + """, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, channel ORDER BY path) AS i FROM p)
SELECT sample_id, (min_by(b, path))::VARCHAR AS batch, max(path) FILTER (channel = 'BSE' AND i = 1) AS path_bse, max(path) FILTER (channel = 'ETD' AND i = 1) AS path_etd,
       max(path) FILTER (channel = 'Inlens' AND i = 1) AS path_inlens, coalesce(bool_or(etd_is_se) FILTER (i = 1), false) AS etd_is_se, false AS has_batch_prefix, count(DISTINCT channel) = 3 AS complete
FROM r GROUP BY sample_id HAVING bool_or(channel = 'BSE')""",
        "fetch_check": """
WITH t AS (SELECT doc_id, n_chars, length(text) AS n FROM documents)
SELECT 'doc' || doc_id AS title, n_chars AS size_bytes, CASE WHEN n % 7 <> 0 THEN n - (n % 5 = 0)::BIGINT END AS length,
       coalesce(n % 7 <> 0 AND n_chars = n - (n % 5 = 0)::BIGINT, false) AS ok FROM t""",
        "fingerprints": """
WITH f AS (SELECT o_custkey AS sample_id, o_orderstatus AS channel, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT sample_id, substr(sha1(string_agg(channel || ':' || sha1(k::VARCHAR), ',' ORDER BY channel)), 1, 12) AS fingerprint FROM f GROUP BY sample_id""",
        "event_properties": "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(json_extract(props, '$.absent')) AS n_absent FROM events GROUP BY event_type",
        "created_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, strftime(ts, '%Y-%m-%d') AS day FROM events",
        "holdout_verdicts": FACTS + "," + _LOO + f", {_HELD} SELECT * FROM held",
        "alarm_rates": STATS
        + ","
        + _LOO
        + f""", {_HELD}, others AS (SELECT sample_id, batch, {_ZONES} AS decision FROM scored WHERE batch <> 3 GROUP BY sample_id, batch)
SELECT CASE WHEN batch = 3 THEN 'false_alarms' ELSE 'detections' END AS kind, count(*) AS n, count(*) FILTER (decision = 'REJECT') AS rejected, count(*) FILTER (decision <> 'ACCEPT') AS not_accepted
FROM (SELECT * FROM held UNION ALL SELECT * FROM others) GROUP BY ALL""",
        "tuned": f"SELECT delta, temperature FROM ({assign_queries.oracle_sql()['grid_tune']}) ORDER BY nll, delta, temperature LIMIT 1",
        "relative_indices": "WITH "
        + _LINES
        + f""",
{wide}, b AS (SELECT {", ".join(f"median({n}) AS b_{n}" for n in names)} FROM w WHERE batch = 3),
t AS (SELECT *, coalesce(b_open_frac > 0, false)::INT AS u1, coalesce(b_qty_mean > 0, false)::INT AS u2, coalesce(b_returned_frac > 0, false)::INT AS u3 FROM w, b)
SELECT sample_id, {", ".join(f"round({n} / nullif(b_{n}, 0), 8) AS {n}" for n in names)},
       round((0.35::DOUBLE * coalesce(open_frac / nullif(b_open_frac, 0), 0) + 0.2::DOUBLE * coalesce(qty_mean / nullif(b_qty_mean, 0), 0) + 0.1::DOUBLE * coalesce(returned_frac / nullif(b_returned_frac, 0), 0))
             / nullif(0.35::DOUBLE * u1 + 0.2::DOUBLE * u2 + 0.1::DOUBLE * u3, 0), 8) AS cli FROM t""",
        "cell_mapping": "WITH "
        + _LINES
        + f""",
w AS (SELECT sample_id, avg(l_discount) AS d, 1 - least(greatest(avg((l_returnflag = 'R')::INT), 0.03::DOUBLE), 0.8::DOUBLE) AS solid FROM lines GROUP BY sample_id),
v AS (SELECT sample_id, d * solid AS si, greatest(solid - d * solid - 0.08::DOUBLE * solid, 0.01::DOUBLE) AS gr FROM w)
SELECT sample_id, round(gr, 8) AS graphite, round(si, 8) AS silicon, round((gr * {GRAPHITE}::DOUBLE + si * {SILICON}::DOUBLE) * {NEGATIVE_UM}::DOUBLE / ({POSITIVE[0]}::DOUBLE * {POSITIVE[1]}::DOUBLE * {POSITIVE_UM}::DOUBLE), 8) AS np_ratio FROM v""",
        "size_class_means": """
SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 25 THEN 'middle' ELSE 'large' END AS size_class, count(*) AS n,
       round(sum(l_discount * l_quantity * l_quantity) / sum(l_quantity * l_quantity), 8) AS mean FROM lineitem GROUP BY ALL""",
        "report_lines": f"""
SELECT v.sample_id, '| ' || v.sample_id || ' | **' || decision || '** | ' || n_reject || '/' || n_investigate || ' | ' || coalesce(kpi || ' ' || direction, 'n/a') || ' |' AS line
FROM ({verdict}) v LEFT JOIN ({STATS},{_DRIVERS} SELECT * FROM drv WHERE place = 1) d ON d.sample_id = v.sample_id""",
        "first_points": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings ORDER BY vec_id LIMIT 300",
        "stale_stages": "SELECT page_id, sha1(html) AS fingerprint FROM pages WHERE sha1(html) NOT IN (SELECT sha1(html) FROM pages WHERE page_id % 3 <> 1 AND page_id % 2 = 0)",
        "snapshot_files": "SELECT 'kpis_' || n_nationkey * 3 || '.csv' AS name, n_nationkey::BIGINT * 3 AS number, lag(n_nationkey::BIGINT * 3) OVER (ORDER BY n_nationkey) AS previous FROM nation",
        "verdict_documents": f"""
SELECT v.sample_id, to_json(struct_pack(sample_id := v.sample_id, verdict := struct_pack(batch := v.batch, decision := decision, n_reject := n_reject), drivers := d.drivers))::VARCHAR AS document
FROM ({verdict}) v JOIN (SELECT sample_id, list(struct_pack(kpi := kpi, direction := direction) ORDER BY place) AS drivers FROM ({STATS},{_DRIVERS} SELECT * FROM drv WHERE place <= 3) GROUP BY sample_id) d ON d.sample_id = v.sample_id""",
    }
