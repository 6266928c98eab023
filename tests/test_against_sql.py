"""Every registered query against its SQL on the smallest tables."""

import re
from pathlib import Path

import compare
import pytest

from freshet.catalog import ENTRIES

FOLDER = "/root/testdata/sf0.001"
# Queries that SQL cannot express, and the test that checks their values.
ACCEPTED = {
    "d6_interpolate_quadratic": "test_operators.py::test_spline_returns_a_parabola_and_meets_its_points",
    "j22_pca": "test_plans.py::test_pca_scores_keep_the_variance",
    "j24_greedy_stations": "test_plans.py::test_greedy_set_beats_single_stations",
    "k16_quantile_regression": "test_plans.py::test_penalised_quantile_regression_equals_the_linear_programme",
    "m10_what_if_fitted": "test_plans.py::test_penalised_quantile_regression_equals_the_linear_programme",
    "m11_group_shapley_fitted": "test_plans.py::test_sampled_coalitions",
    "k17_partial_least_squares": "test_plans.py::test_pls_on_one_feature_is_a_straight_line",
    "k18_boosted_trees": "test_plans.py::test_trees_beat_the_climatology",
}
COUNTS = dict(zip("ABCDEFGHIJKLM", (13, 16, 17, 22, 18, 18, 18, 4, 4, 24, 18, 9, 12)))


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")
@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, con, name):
    status, _, _, note = compare.compare(spark, con, ENTRIES[name], FOLDER)
    assert status == "ok" or (status == "rows" and name in ACCEPTED), note


def test_accepted_queries_have_their_tests():
    here = Path(__file__).resolve().parent
    for name, test in ACCEPTED.items():
        file, _, fn = test.partition("::")
        assert name in ENTRIES and ENTRIES[name].sql is None
        assert f"def {fn}(" in (here / file).read_text()


def test_every_inventory_id_has_a_query():
    have = {re.match(r"([a-z]\d+)_", name).group(1).upper() for name in ENTRIES}
    want = {f"{c}{i}" for c, n in COUNTS.items() for i in range(1, n + 1)}
    assert want - have == set()
