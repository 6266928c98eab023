"""Shuffles of the shipped lines are dealt over tasks by the table's size, and are not cut down again."""

import re

import pytest

from freshet import session
from freshet.catalog import ENTRIES
from freshet.catalog.domain import Domain
from freshet.plans import selection

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 4096)


def dealt(df) -> set[tuple[str, int]]:
    """Keys and tasks of the shuffles that stay as dealt."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"hashpartitioning\(([^()]*), (\d+)\), REPARTITION_BY_NUM", plan)
    return {(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in found}


def test_station_days_are_dealt_by_the_size_of_the_lines(spark, small_parts):
    d = Domain(spark, DIR)
    assert d.parts > spark.sparkContext.defaultParallelism
    assert dealt(d.station_day) == {("station, d", d.parts)}


def test_sparse_series_are_sorted_in_parts(spark, small_parts):
    n = Domain(spark, DIR).parts
    assert {("station, d", n), ("station", n)} <= dealt(ENTRIES["d13_drop_sparse"].run(spark, DIR))


def test_issue_rows_are_dealt_once_and_grouped_there(spark, small_parts):
    n = Domain(spark, DIR).parts
    df = ENTRIES["j8_max_corr_issue"].run(spark, DIR)
    assert ("station", n) in dealt(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^()]*station#\d+, md#", plan)


def test_months_and_sets_are_dealt_by_the_size_of_the_lines(spark, small_parts):
    d = Domain(spark, DIR)
    assert ("station", d.parts) in dealt(d.station_month)
    rows = spark.createDataFrame([(0, 1, s, y, float(s * y % 7), float(y)) for s in range(4) for y in range(8)], "fold int, site int, station int, yr int, x double, vol double")
    sizes = []
    kept = selection.cut_lineage
    try:
        selection.cut_lineage = lambda df: sizes.append(dealt(df)) or kept(df)
        got = selection.greedy_stations(rows, rounds=1, min_years=5, parts=23).count()
    finally:
        selection.cut_lineage = kept
    assert got == 1
    assert ("fold, site, stations", 23) in sizes[0] and ("fold, site, stations", 23) in sizes[2]
