"""Source/sink round trips in a scratch folder."""

import os

from pyspark.sql import functions as F

from tidecast.sources import forecast_io as io


def test_json_side_files_skipped(spark):
    root = io.scratch_root(spark, "test_json")
    df = spark.createDataFrame([("no1", [1.0, 2.0], [0.5, 0.6])], "zone string, loc array<double>, scale array<double>")
    df.write.json(root)
    local = root.replace("file:", "")
    with open(os.path.join(local, "2024-01-01_state.json"), "w") as f:
        f.write('{"zone": "side", "loc": [9.0], "scale": [9.0]}\n')
    back = io.read_json(spark, root, "zone string, loc array<double>, scale array<double>", skip_suffix="_state.json")
    assert [r["zone"] for r in back.collect()] == ["no1"]
    hours = io.arrays_to_hours(back, ["zone"], ["loc", "scale"]).orderBy("hour").collect()
    assert [(h["hour"], h["loc"], h["scale"]) for h in hours] == [(0, 1.0, 0.5), (1, 2.0, 0.6)]


def test_dynamic_partition_overwrite_keeps_other_dates(spark):
    root = io.scratch_root(spark, "test_parts")
    a = spark.createDataFrame([("z", "2024-01-01", 1.0), ("z", "2024-01-02", 2.0)], "zone string, date string, v double")
    io.write_partitioned(a, root, ["zone", "date"])
    b = spark.createDataFrame([("z", "2024-01-02", 5.0)], "zone string, date string, v double")
    io.write_partitioned(b, root, ["zone", "date"])
    got = {r["date"].isoformat() if hasattr(r["date"], "isoformat") else r["date"]: r["v"] for r in spark.read.parquet(root).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-02": 5.0}


def test_discover_runs_excludes_named(spark):
    df = spark.createDataFrame([("z", "m", "1"), ("z", "m", "2"), ("z", "m", "hEns"), ("z", "m", "vEns")], "zone string, model string, run_id string")
    assert sorted(r["run_id"] for r in io.discover_runs(df, ["zone", "model"]).collect()) == ["1", "2"]


def test_report_csv_two_decimals(spark):
    root = io.scratch_root(spark, "test_csv")
    io.write_report_csv(spark.createDataFrame([("a", 1.23456)], "m string, v double"), root, 2)
    assert spark.read.option("header", True).csv(root).first()["v"] == "1.23"
    _ = F
