"""End-to-end: scoring with the hot-key (bucketed) plan forced equals the default plan."""

import pytest

from tidecast.operators import scores
from tidecast.session import CONF_ROWS_PER_BUCKET
from tidecast.sources import fixtures as fx

from conftest import SF001

KEYS = ["model", "run_id", "zone", "hour"]


def _scores(spark):
    hs = scores.hourly_scores(fx.samples(spark, SF001), fx.actuals(spark, SF001), KEYS)
    return {tuple(r[k] for k in (*KEYS, "date")): r for r in hs.collect()}


def test_forced_bucketed_plan_matches_default(spark):
    default = _scores(spark)
    spark.conf.set(CONF_ROWS_PER_BUCKET, "3")  # every group with more than 3 samples is split
    try:
        forced = _scores(spark)
    finally:
        spark.conf.unset(CONF_ROWS_PER_BUCKET)
    assert default.keys() == forced.keys() and len(default) > 0
    for k, r in default.items():
        for c in ("crps", "abs_err", "pinball_q10", "pinball_q50", "pinball_q90", "winkler"):
            assert forced[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (k, c)
