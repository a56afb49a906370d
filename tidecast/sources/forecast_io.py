"""Forecast files: writers and readers (survey A2-A14).

Layout is Spark's partitioned directories (``key=value``), so run discovery,
partition pruning and "date from the path" come from partition discovery instead of
hand-parsed file names.  Readers always pass an explicit schema (no inference).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (or the warehouse dir)."""
    base = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(base, "tidecast-io", f"{name}-{uuid.uuid4().hex[:12]}")


# ---------------------------------------------------------------- writers
def write_panel(df: DataFrame, path: str, key: str = "zone") -> None:
    """Hourly panel as Parquet partitioned by series (snappy)."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(key).parquet(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", header: bool = True) -> None:
    """Forecast tables partitioned by (zone, model, run_id, date, ...); with
    dynamic partition overwrite only the partitions present in ``df`` are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def params_to_arrays(params: DataFrame, keys: Sequence[str], hour: str, fields: Sequence[str], slots: int = 24) -> DataFrame:
    """A10: hourly parameter rows to one row per key with ``slots``-element arrays
    indexed by hour (null where an hour is absent).  A day has at most 24 rows, so
    the collect is bounded."""
    g = params.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(hour, F.struct(*fields)))).alias("_m"))
    idx = F.sequence(F.lit(0), F.lit(slots - 1))
    return g.select(*keys, *[F.transform(idx, _slot(f)).alias(f) for f in fields])


def _slot(name: str):
    return lambda h: F.col("_m")[h][name]


def write_params_json(params: DataFrame, path: str, keys: Sequence[str], hour: str, fields: Sequence[str], partition: Sequence[str]) -> None:
    """A10: parameter arrays as JSON, partitioned."""
    params_to_arrays(params, keys, hour, fields).write.mode("overwrite").partitionBy(*partition).json(path)


def write_report_csv(df: DataFrame, path: str, decimals: int = 2) -> None:
    """A (small, aggregated) report table as one CSV with fixed decimals."""
    out = df.select(
        *[
            F.format_string(f"%.{int(decimals)}f", F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """One JSON document per row (``to_json(struct(*))``)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- readers
def read_csv(spark: SparkSession, path: str, schema: StructType | str, skip_suffix: str | None = None) -> DataFrame:
    """A2: CSV files with header and explicit schema; partition columns from the path;
    A4: files whose name ends with ``skip_suffix`` are ignored."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return _skip(df, skip_suffix)


def read_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False, skip_suffix: str | None = None) -> DataFrame:
    """A3: JSON documents with explicit schema (``multiLine`` for one object per file)."""
    df = spark.read.schema(schema).option("multiLine", multiline).json(path)
    return _skip(df, skip_suffix)


def _skip(df: DataFrame, suffix: str | None) -> DataFrame:
    if not suffix:
        return df
    return df.where(~F.col("_metadata.file_name").endswith(suffix))


def arrays_to_hours(df: DataFrame, keys: Sequence[str], fields: Sequence[str], hour: str = "hour") -> DataFrame:
    """A3: equal-length parameter arrays to one row per hour."""
    z = df.select(*keys, F.posexplode(F.arrays_zip(*[F.col(f) for f in fields])).alias(hour, "_z"))
    out = z.select(*keys, F.col(hour).cast("int").alias(hour), *[F.col(f"_z.{f}").alias(f) for f in fields])
    return out.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())  # empty slots


def discover_runs(df: DataFrame, keys: Sequence[str], run: str = "run_id") -> DataFrame:
    """A5: numeric run ids per key (named ensembles excluded), distinct."""
    return df.where(F.col(run).rlike("^[0-9]+$")).select(*keys, run).distinct()


def zone_model_pairs(df: DataFrame, zone: str = "zone", model: str = "model") -> DataFrame:
    """(zone, model) pairs present."""
    return df.select(zone, model).distinct()


def latest_run(df: DataFrame, keys: Sequence[str], run: str = "run_id") -> DataFrame:
    """Run with the newest file per key (file modification time from metadata)."""
    return df.groupBy(*keys).agg(F.max_by(run, F.col("_metadata.file_modification_time")).alias("latest_run"))
