import subprocess
import sys
from datetime import datetime

import pytest

from jobs import catalog, period_verdicts, text_quality
from tests.oracle import SF, connect, rows_of, same


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, name):
    settings = dict(spark.conf.getAll)
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name])
    assert {k: (v, spark.conf.getAll.get(k)) for k, v in settings.items() if spark.conf.getAll.get(k) != v} == {}


def rows(df):
    return sorted(map(repr, df.collect()))


def report_sql(paths):
    """The report of job 1 by SQL over some files."""
    con = connect()
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet({paths})")
    want = con.execute(text_quality.JOB1_SQL)
    return rows_of(want.fetchall(), [d[0] for d in want.description])


def test_stream_takes_only_what_is_new(spark, tmp_path):
    """Two runs over growing input, on copies: after each the report is that of all files so far."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = docs.randomSplit([0.4, 0.3, 0.3], 7)
    config = text_quality.default_config() | {"files_per_trigger": 1}
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def go():
        out = text_quality.run(spark, source, output, checkpoint, config)
        out = out.selectExpr("sample_id", "kpi", "round(value, 8) AS value", "round(se, 8) AS se", "round(z, 8) AS z", "documents", "decision", "batch")
        return rows_of([tuple(r) for r in out.collect()], out.columns)  # at once: the next run replaces the files

    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(source)
    assert go() == report_sql([f"{source}/*.parquet"])
    sums = spark.read.parquet(f"{output}/sums")
    assert sorted(r[0] for r in sums.select("ingest").distinct().collect()) == [0, 1]
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "sums").rglob("*.parquet")}
    parts[2].coalesce(1).write.mode("append").parquet(source)
    second = go()
    assert second == report_sql([f"{source}/*.parquet"])
    # The first run's partitions were not touched: only the new file was read.
    assert all(f.stat().st_mtime_ns == t for f, t in kept.items())
    assert go() == second


def test_micro_batch_that_runs_again_counts_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    for _ in range(2):
        text_quality.take(docs.limit(50), 4, str(tmp_path), 5)
    assert spark.read.parquet(f"{tmp_path}/sums").selectExpr("sum(documents)").first()[0] == 50


def test_unusual_documents(spark, tmp_path):
    given = [(None, None, None, None), (1, "", "en", ""), (1, "", "en", ""), (2, "a\nb 9", "1", "x/y"), (3, "é" * 5000, "en", "s")]
    source = str(tmp_path / "in")
    spark.createDataFrame(given, text_quality.DOCUMENTS).selectExpr("*", "1 AS kpi", "2 AS ingest").write.parquet(source)
    out = text_quality.run(spark, source, str(tmp_path / "out"), str(tmp_path / "state"), text_quality.default_config())
    got = {(r["sample_id"], r["kpi"]): (r["value"], r["documents"]) for r in out.collect()}
    assert got["unknown/unknown", "empty_share"] == (1.0, 1) and got["en/unknown", "empty_share"] == (1.0, 2)
    assert got["1/x/y", "lines_mean"] == (2.0, 1) and got["1/x/y", "digit_share"] == (0.2, 1)
    assert got["en/s", "bytes_per_char"] == (2.0, 1) and got["en/unknown", "chars_per_word"] == (None, 2)
    assert {r["batch"] for r in out.collect()} == {"en", "1", "unknown"}


def test_stream_before_the_first_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = text_quality.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), text_quality.default_config())
    assert out.count() == 0


def tables(sf=SF):
    return [f"{sf}/{t}.parquet" for t in ("lineitem", "supplier", "nation")]


def test_period_run_replaces_its_quarters_only(spark, tmp_path):
    output, config = str(tmp_path / "out"), period_verdicts.default_config()
    whole = rows(period_verdicts.run(spark, *tables(), output, config))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    again = rows(period_verdicts.run(spark, *tables(), output, config | {"first": "1996Q2", "last": "1996Q3"}))
    left = {f for f, t in files.items() if f.exists() and f.stat().st_mtime_ns == t}
    assert {f.parent.name for f in set(files) - left} == {"period=1996Q2", "period=1996Q3"}
    # The change against the quarter before the run's first one is there as well.
    assert len(again) == len(whole)

    def short(all_rows):
        return sorted((r["sample_id"], r["kpi"], r["period"], r["decision"], r["changed"], *[None if r[c] is None else round(r[c], 9) for c in ("value", "z", "change")]) for r in all_rows)

    fresh = period_verdicts.run(spark, *tables(), str(tmp_path / "fresh"), config).collect()
    assert short(spark.read.schema(period_verdicts.REPORT).parquet(output).collect()) == short(fresh)


def test_scan_takes_the_range_of_a_run(spark, capsys):
    lines = period_verdicts.within(spark.read.parquet(tables()[0]), "1996Q1", "1996Q1")
    period_verdicts.strip_sums(lines, 5).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(l_shipdate,1995-10-01" in pushed and "LessThan(l_shipdate,1996-04-01" in pushed
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "l_quantity" in read and "l_tax" not in read and "l_partkey" not in read


def test_unusual_line_items(spark, tmp_path):
    lines = spark.read.parquet(tables()[0]).limit(0).select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    at = datetime(1995, 12, 31)
    given = [(1, 1, 2.0, 4.0, 0.1, "R", "O", at), (1, 1, 2.0, 4.0, 0.1, "R", "O", at), (2, 1, None, None, None, None, None, None), (3, 999, 1.0, 1.0, 0.0, "N", "F", at), (None, None, 1.0, 1.0, 0.0, "N", "F", at)]
    path = str(tmp_path / "lines")
    spark.createDataFrame(given, lines.schema).write.parquet(path)
    out = period_verdicts.run(spark, path, *tables()[1:], str(tmp_path / "out"), period_verdicts.default_config()).collect()
    got = {(r["period"], r["sample_id"], r["kpi"]): r["value"] for r in out}
    assert got["1995Q4", 1, "qty_mean"] == 2.0 and got["unknown", 1, "qty_mean"] is None and got["unknown", 1, "returned_frac"] == 0.0
    assert {r["sample_id"] for r in out} == {1}
    spark.createDataFrame([], lines.schema).write.parquet(path + "-none")
    assert period_verdicts.run(spark, path + "-none", *tables()[1:], str(tmp_path / "out"), period_verdicts.default_config()).count() == len(out)


def test_command_lines():
    for name in ("text_quality", "period_verdicts"):
        said = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--help"], capture_output=True, text=True, timeout=120)
        assert said.returncode == 0 and "--output" in said.stdout


def test_halves_of_a_report_go_up(spark):
    from jobs import period_verdicts as V

    rows = spark.createDataFrame([(0.0031874999999999998, -0.0000025000000000001, 0.1)], "se double, z double, change double")
    assert tuple(V.rounded(rows).first()) == (0.003188, -0.000003, 0.1)


def test_report_is_rounded_once(spark):
    """Values a little below a half, of which the SQL has the lower number; the error of a share goes up whatever was left of it."""
    values = [(1641.6688634999998, -0.19531249999999983, 0.49218749999999994), (0.0031874999999999994, 0.5, None)]
    out = period_verdicts.rounded(spark.createDataFrame(values, "se double, z double, change double"))
    assert [tuple(r) for r in out.collect()] == [(1641.668863, -0.195312, 0.492187), (0.003188, 0.5, None)]


def test_halves_of_two_strips_match_sql(spark, tmp_path):
    """Two suppliers, each with an error half way between two numbers of six digits, where all runs of the SQL agree."""
    con = connect("/root/testdata/sf0.1")
    con.execute(f"COPY (SELECT * FROM lineitem WHERE l_suppkey IN (214, 242)) TO '{tmp_path}/lineitem.parquet'")
    for name in ("supplier", "nation"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    same(spark, period_verdicts.job2_period_verdicts, period_verdicts.JOB2_SQL, str(tmp_path))
