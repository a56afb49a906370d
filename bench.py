"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.  Each query
is fully executed with Spark's ``noop`` sink (no rows collected to the driver); the
time includes planning jobs the query runs (size checks, materialized intermediates).
Warm-up: the same headline set runs once, untimed, on the smallest data set
(``$BENCH_WARMUP_DIR``, default sf0.001) so JIT compilation and Python worker start-up
are not charged to the first timed queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e9_daily_metrics",  # scoring: CRPS, MAE, RMSE, pinball, Winkler per day
    "e12_model_table",  # flagship leaderboard with ranks
    "e6_forecast_stats",  # percentiles, exceedance, state
    "e13_quantile_grid_crps",  # scoring from a quantile grid
    "e21_calibration_curve",
    "j1_horizontal_ensemble",
    "j2_vertical_stats",
    "l6_settlement",
    "c8_c9_day_matrix",
    "c13_c14_apply_scaler",
    "i7_skewt_logpdf",
    "k10_seasonal_naive",
    "k1_linear_quantile_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from tidecast.plans import registry
    from tidecast.session import ensure_local_checkpoint_dir, local_session

    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), app="tidecast-bench")
    ensure_local_checkpoint_dir(spark)
    registry.load_all()

    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm):
        for name in names:
            registry.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    from tidecast.sources import fixtures as fx

    sample_rows = fx.samples(spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
                "cpus": int(cpus) if cpus.isdigit() else cpus,
                "sample_rows": sample_rows,
                "scoring_rows_per_sec": round(sample_rows / times["e9_daily_metrics"], 1) if "e9_daily_metrics" in times else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
