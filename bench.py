"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import signal
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "vulnerable_share", "c3", "q_gpdm", "annual_max", "station_runoff_c", "mann_kendall", "gev_lmoments", "slope_gradient", "zonal_terrain",
    "zonal_cn", "softmax_bins", "rank_score", "soil_loss", "c8", "weighted_overlay_15", "c10", "j8", "j12", "j13", "j18", "mask_cells",
    "d8_pointer", "flow_accumulation", "watershed_cells", "soil_by_mapunit", "monthly_climate", "watershed_budget",
    "c1", "c2", "c6", "fill_depressions", "connected_parts", "hillslopes", "roi_homogeneous", "growth_curve", "gev_mle",
]


def main() -> None:
    from hydrospark.catalog import QUERIES
    from hydrospark.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # one machine runs the bench, so a folder of its own can stand for the shared one; it goes at the end
    runs = tempfile.TemporaryDirectory(prefix="bench-")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": runs.name,
    })
    spark.sparkContext.setLogLevel("ERROR")
    # the first query pays for class loading; it is not a measurement
    QUERIES["zonal_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}

    def report() -> None:
        print(json.dumps({
            "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        }), flush=True)

    def ended(*_) -> None:
        # what was measured until then is told
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    runs.cleanup()
    report()


if __name__ == "__main__":
    main()
