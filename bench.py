"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the
local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from freshet.catalog import ENTRIES  # noqa: E402
from freshet.session import local_session  # noqa: E402

HEADLINE = (
    "b8_snap_up",
    "d3_ffill",
    "d8_climatology_impute",
    "d20_profile",
    "e7_asof_latest",
    "e13_nearest",
    "f3_spread_quantiles",
    "f4_basin_mean",
    "f5_zonal",
    "f7_agg_since_october",
    "g1_roll_mean",
    "h2_top_k",
    "j4_corr_select",
    "j12_deviation",
    "j13_site_deviation",
    "k9_conformal",
    "l7_several_groupings",
    "m3_global_importance",
    "j24_greedy_stations",
    "j6_issue_corr_select",
    "k16_quantile_regression",
    "k17_partial_least_squares",
    "k18_boosted_trees",
    "m10_what_if",
    "m11_waterfall",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    ENTRIES["b2_water_year"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
