import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.functions import calendar as cal
from freshet.functions import scalars as sc


def one(spark, value, expr):
    row = spark.createDataFrame([(value,)], "d date").select(expr("d").alias("x")).head()
    return row.x


@pytest.mark.parametrize(
    "day, want",
    [("1999-09-30", 1999), ("1999-10-01", 2000), ("2000-01-01", 2000)],
)
def test_water_year_turns_on_first_october(spark, day, want):
    assert one(spark, dt.date.fromisoformat(day), cal.water_year) == want


def test_water_day_counts_leap_day(spark):
    assert one(spark, dt.date(2000, 9, 30), cal.water_day) == 366
    assert one(spark, dt.date(1999, 9, 30), lambda c: cal.water_day(c, 0)) == 364


@pytest.mark.parametrize(
    "day, want",
    [
        ("2000-03-01", "2000-03-01"),
        ("2000-03-02", "2000-03-08"),
        ("2000-03-22", "2000-03-22"),
        ("2000-12-23", "2001-01-01"),
    ],
)
def test_snap_up(spark, day, want):
    assert one(spark, dt.date.fromisoformat(day), cal.snap_up) == dt.date.fromisoformat(want)


def test_prev_issue_over_new_year(spark):
    assert one(spark, dt.date(2001, 1, 1), cal.prev_issue) == dt.date(2000, 12, 22)
    assert one(spark, dt.date(2001, 1, 8), cal.prev_issue) == dt.date(2001, 1, 1)


def test_leap_day_has_its_own_season_key(spark):
    assert one(spark, dt.date(2000, 2, 29), cal.month_day) == "0229"


def test_month_num_of_other_text_is_null(spark):
    rows = spark.createDataFrame([("Jan",), ("Dec",), ("xx",)], "s string").select(cal.month_num("s").alias("m")).collect()
    assert [r.m for r in rows] == [1, 12, None]


def test_late_season_is_public_next_year(spark):
    issue = F.lit("2000-01-01").cast("date")
    rows = spark.createDataFrame([("OND", 1999), ("NDJ", 1999), ("SON", 1999)], "s string, y int")
    got = [r.x for r in rows.select(cal.season_available("s", "y", issue).alias("x")).collect()]
    assert got == [True, False, True]


def test_null_if_codes(spark):
    rows = spark.createDataFrame([("M",), ("T",), ("-9999",), ("1.5",), ("NaN",), (None,)], "s string")
    got = [r.v for r in rows.select(sc.null_if("s", below=-99.0).alias("v")).collect()]
    assert got == [None, 0.0, None, 1.5, None, None]


def test_safe_div_and_row_mean(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (None, None, None)], "a double, b double, c double")
    rows = df.select(sc.safe_div("a", "b").alias("q"), sc.row_mean("a", "b", "c").alias("m")).collect()
    assert [tuple(r) for r in rows] == [(None, 0.5), (None, None)]


def test_rearranged_quantiles_never_cross(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0), (-5.0, 1.0, 2.0)], "q10 double, q50 double, q90 double")
    for absolute in (False, True):
        for r in sc.rearrange(df, ["q10", "q50", "q90"], absolute).collect():
            assert r.q10 <= r.q50 <= r.q90


def test_haversine_of_a_degree(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    assert df.select(sc.haversine("a", "b", "c", "d").alias("x")).head().x == pytest.approx(111.19, abs=0.01)
