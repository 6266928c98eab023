import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.session import shared_dir
from freshet.sources import tables, text


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)
    return path


def test_station_year_tree(spark, tmp_path):
    write(tmp_path / "FY2000/301_CO_SNTL.csv", "date,WTEQ_DAILY\n1999-10-01,1.5\n1999-10-02,\n")
    write(tmp_path / "FY2001/302.csv", "date,PREC_DAILY,WTEQ_DAILY\n2000-10-01,2.0,3.0")
    rows = text.scan_station_years(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.station, r.forecast_year, r.WTEQ_DAILY, r.PREC_DAILY) for r in rows] == [
        ("301_CO_SNTL", 2000, 1.5, None), ("301_CO_SNTL", 2000, None, None), ("302", 2001, 3.0, 2.0)
    ]
    assert rows[0].date == dt.date(1999, 10, 1)


def test_discharge_keeps_leading_zeros_and_drops_the_sentinel(spark, tmp_path):
    p = write(tmp_path / "q.csv", "datetime,site_no,00060_Mean,00060_Mean_cd\n2000-01-01 00:00:00,00123,-999999,A\n2000-01-02 00:00:00,00123,5.0,A\n")
    rows = text.read_discharge_csv(spark, str(p)).orderBy("date").collect()
    assert [(r.site_no, r.discharge_cfs_mean) for r in rows] == [("00123", None), ("00123", 5.0)]


def test_rdb(spark, tmp_path):
    p = write(tmp_path / "a.rdb", "# note\nagency_cd\tsite_no\tflow\n5s\t15s\t14n\nUSGS\t00123\t7.5\nUSGS\t00123\tIce\n")
    rows = text.read_rdb(spark, str(p), ["agency_cd", "site_no", "flow"], ["flow"]).collect()
    assert sorted((r.site_no, r.flow) for r in rows if r.flow) == [("00123", 7.5)]
    assert len(rows) == 2


def test_reservoir_preamble_and_units(spark, tmp_path):
    body = "\n".join(["x"] * 7 + ["Location,Parameter,Result,Units,Datetime (UTC)", "Lake,Inflow,1000,cfs,2000-01-01 00:00:00", "Lake,Inflow,9,af,2000-01-01 00:00:00"])
    p = write(tmp_path / "r.csv", body)
    rows = text.read_reservoir_csv(spark, str(p), {"Lake": "lake_site"}, "Inflow").collect()
    assert [(r.site_id, round(r.volume, 6)) for r in rows] == [("lake_site", 1.983459)]


def test_fixed_width_after_marker(spark, tmp_path):
    p = write(tmp_path / "soi.txt", "ANOMALY\nYEAR\n1999   1.0  2.0\n\nSTANDARDIZED DATA\nYEAR\n1999   0.5-999.9\n")
    rows = text.read_fwf(spark, str(p), (4, 6, 6), ("year", "m1", "m2"), marker="STANDARDIZED").collect()
    assert [tuple(r) for r in rows] == [(1999, 0.5, None)]


def test_whitespace_table(spark, tmp_path):
    p = write(tmp_path / "n.txt", " YR MON A\n 1999   1   *****\n 1999   2   0.5\n")
    rows = text.read_ws(spark, str(p), ["yr", "mon", "a"], skip=("YR",)).collect()
    assert sorted((r.mon, r.a) for r in rows if r.a) == [("2", "0.5")]
    assert len(rows) == 2


def test_sections_carry_their_header_date_and_stop_at_the_end_mark(spark, tmp_path):
    p = write(tmp_path / "c.txt", " 115 1999 FORECAST X\nYEAR MN V\n1999  2 1.5\n 215 1999 FORECAST X\n1999  3 2.5\n9999\n1999  4 9.9\n")
    rows = text.read_sectioned(spark, str(p), "FORECAST X", {}, [("y", 4), ("mn", 3), ("v", 4)]).orderBy("mn").collect()
    assert [(r.issue_date, r.mn, r.v) for r in rows] == [(dt.date(1999, 1, 15), 2.0, 1.5), (dt.date(1999, 2, 15), 3.0, 2.5)]


@pytest.fixture
def small_splits(spark):
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "2k")
    yield
    spark.conf.set(key, before)


def test_one_file_over_many_splits(spark, tmp_path, small_splits):
    sections, fwf = [], ["ANOMALY", *[f"{1800 + i}   1.0" for i in range(400)], "STANDARDIZED", *[f"{1801 + i}{i:6.1f}" for i in range(399)]]
    for m in range(1, 13):
        sections += [f"{m:2d}15 1999 FORECAST X", "YEAR MN V", *[f"1999{m:3d}{i:6.1f}" for i in range(200)]]
    p = write(tmp_path / "c.txt", "\n".join([*sections, "9999", *["1999  4 999.9"] * 500]))
    lines = text.read_lines(spark, str(p))
    assert lines.select("block").distinct().count() > 5
    rows = text.read_sectioned(spark, str(p), "FORECAST X", {}, [("y", 4), ("mn", 3), ("v", 6)]).collect()
    assert sorted((r.issue_date, r.mn, r.v) for r in rows) == [(dt.date(1999, m, 15), float(m), float(i)) for m in range(1, 13) for i in range(200)]
    p = write(tmp_path / "soi.txt", "\n".join(fwf))
    rows = text.read_fwf(spark, str(p), (4, 6), ("year", "m1"), marker="STANDARDIZED").collect()
    assert sorted((r.year, r.m1) for r in rows) == [(1801 + i, float(i)) for i in range(399)]
    body = ["date,WTEQ_DAILY", *[f"{dt.date(1999, 10, 1) + dt.timedelta(i)},{i}" for i in range(366)]]
    write(tmp_path / "FY2000/301.csv", "\n".join(body))
    rows = text.scan_station_years(spark, str(tmp_path)).collect()
    assert sorted(r.WTEQ_DAILY for r in rows) == [float(i) for i in range(366)]


def test_files_without_header_or_marker_and_empty_files_give_no_rows(spark, tmp_path):
    write(tmp_path / "FY2000/301.csv", "1999-10-01,1.5\n")
    write(tmp_path / "FY2000/302.csv", "")
    assert text.scan_station_years(spark, str(tmp_path)).count() == 0
    p = write(tmp_path / "soi.txt", "1999   1.0\n")
    assert text.read_fwf(spark, str(p), (4, 6), ("year", "m1"), marker="STANDARDIZED").count() == 0
    p = write(tmp_path / "r.csv", "Lake,Inflow,1000,cfs,2000-01-01 00:00:00\n")
    assert text.read_reservoir_csv(spark, str(p), {"Lake": "s"}, "Inflow").count() == 0
    p = write(tmp_path / "c.txt", "1999  2 1.5\n")
    assert text.read_sectioned(spark, str(p), "FORECAST X", {}, [("y", 4), ("mn", 3), ("v", 4)]).count() == 0


def test_positional_json_dates_and_codes(spark):
    payload = '{"data":[{"meta":{"name":"S"},"data":[["T","50"],["M","51"],["0.2","M"]]}]}'
    df = spark.createDataFrame([(payload, dt.date(2000, 2, 28))], "payload string, start date")
    rows = tables.flatten_station_json(df, "payload", "start").orderBy("date").collect()
    assert [(r.date.day, r.precip, r.maxt) for r in rows] == [(28, 0.0, 50.0), (29, None, 51.0), (1, 0.2, None)]


def test_grid_bounds_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "g")
    spark.createDataFrame([(1.0, 1.0, 5.0), (9.0, 9.0, 6.0)], "lat double, lon double, value double").write.parquet(p)
    out = tables.scan_grid(spark, p, (0.0, 2.0), (0.0, 2.0))
    assert out.count() == 1
    assert "GreaterThanOrEqual(lat" in out._jdf.queryExecution().executedPlan().toString()


def test_reuse_only_of_the_same_plan(spark):
    calls = []

    def build(k):
        calls.append(k)
        return spark.range(5).select((F.col("id") * k).alias("x"))

    def total(k):
        return tables.read_or_build(spark, "reuse-test", lambda: build(k), version="-v1").agg(F.sum("x")).head()[0]

    assert (total(1), total(1), total(2)) == (10, 10, 20)
    assert shared_dir(spark)


def test_submission_order_and_missing_rows(spark, tmp_path):
    wanted = spark.createDataFrame([(0, 2, "b"), (1, 1, "a"), (2, 3, "c")], "ord int, site int, k string")
    pred = spark.createDataFrame([(1, "a", 1.0, 2.0, 3.0), (2, "b", 4.0, 5.0, 6.0)], "site int, k string, q10 double, q50 double, q90 double")
    rows = tables.submission(pred, wanted, ["site", "k"], "ord").collect()
    assert [(r.site, r.q50) for r in rows] == [(2, 5.0), (1, 2.0), (3, None)]
    path = tables.write_submission(pred, wanted, ["site", "k"], "ord", str(tmp_path / "out"))
    assert spark.read.csv(path, header=True).count() == 3


def test_metadata_override_and_padding(spark):
    meta = spark.createDataFrame([("s", 123, 1.0), ("t", 4, 2.0)], "site string, gauge int, elev double")
    fix = spark.createDataFrame([("t", 9.0)], "site string, elev double")
    assert {(r.gauge, r.elev) for r in tables.read_metadata(meta, "gauge", fix).collect()} == {("00000123", 1.0), ("00000004", 9.0)}


def test_many_small_files_are_kept_in_few(spark, tmp_path, small_splits):
    rows = [(s, y, k, f"{1990 + k},{s * k}.5") for s in range(150) for y in (1998, 1999) for k in range(3)]
    lines = spark.createDataFrame([*rows, *[(s, y, None, "notes\n\ndate,WTEQ_DAILY") for s in range(150) for y in (1998, 1999)]], "station int, fy int, k int, value string")
    path = f"{tmp_path}/bundles"
    text.bundle_lines(lines, ["fy", "station"], "k", 4).write.text(path)
    assert len(list((tmp_path / "bundles").glob("part-*"))) <= 4
    read = text.read_bundles(spark, path)
    assert read.select("block").distinct().count() > 2
    own = sorted((r.block, r.at, r.value) for r in read.where("path = 'fy=1999/station=7/'").collect())
    assert [v for _, _, v in own] == ["notes", "", "date,WTEQ_DAILY", "1990,0.5", "1991,7.5", "1992,14.5"]
    got = text.parse_station_years(read.where("value <> 'notes'"), year=r"fy=(\d+)/", station=r"station=(\d+)/")
    assert sorted((int(r.station), r.forecast_year, r.date.year, r.WTEQ_DAILY) for r in got.collect()) == sorted((s, y, 1990 + k, s * k + 0.5) for s, y, k, _ in rows)
