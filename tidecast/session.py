"""Session helpers: library settings, size-checked broadcast, checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Library settings are ordinary Spark conf keys so a cluster job can tune them
# with --conf without code changes.
CONF_ROWS_PER_BUCKET = "tidecast.rank.rowsPerBucket"
CONF_BROADCAST_MAX_ROWS = "tidecast.broadcast.maxRows"

CONF_BROADCAST_MAX_BYTES = "tidecast.broadcast.maxBytes"

DEFAULT_BROADCAST_MAX_BYTES = 256 * 1024 * 1024
DEFAULT_ROWS_PER_BUCKET = 2_000_000
DEFAULT_BROADCAST_MAX_ROWS = 2_000_000


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value not in (None, "") else default


def rows_per_bucket(spark: SparkSession) -> int:
    return conf_int(spark, CONF_ROWS_PER_BUCKET, DEFAULT_ROWS_PER_BUCKET)


def broadcast_max_rows(spark: SparkSession) -> int:
    return conf_int(spark, CONF_BROADCAST_MAX_ROWS, DEFAULT_BROADCAST_MAX_ROWS)


def sized_broadcast(df: DataFrame, max_rows: int | None = None, materialized: bool = False) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows and
    ``tidecast.broadcast.maxBytes`` bytes of files.

    The frame is first materialized (see :func:`materialize`) so that the check and
    the later join read the same rows instead of computing them twice.  The check is
    ``limit(max_rows + 1).count()``.  Above the bound the frame is returned
    unbroadcast, so the join falls back to a shuffle join (with AQE skew splitting)
    instead of shipping an unbounded table to every executor.
    """
    bound = max_rows if max_rows is not None else broadcast_max_rows(df.sparkSession)
    if not materialized:
        df = materialize(df)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) <= conf_int(df.sparkSession, CONF_BROADCAST_MAX_BYTES, DEFAULT_BROADCAST_MAX_BYTES) and df.limit(bound + 1).count() <= bound:
        return F.broadcast(df)
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a frame that several branches of a plan (or several rounds of an
    iterative fit) read.

    Writes the frame as a Parquet table in a fresh folder under the shared folder the
    cluster configures in ``spark.checkpoint.dir`` and reads it back with its schema:
    lost executors then re-read files instead of recomputing the lineage, and later
    scans get column pruning and filter pushdown.  (A written table, rather than
    ``Dataset.checkpoint``, keeps per-round cost flat in long iterative fits.)
    Without a configured folder a local session (tests, a laptop) gets a scratch folder of
    its own; a cluster session fails, as executors would not see such a folder.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = ensure_local_checkpoint_dir(spark)
    path = os.path.join(base, "tidecast-tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster configured, or None."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    return None


def ensure_local_checkpoint_dir(spark: SparkSession) -> str:
    """For tests and local benches only: set a scratch checkpoint dir when none is set."""
    d = checkpoint_dir(spark)
    if d is None:
        d = tempfile.mkdtemp(prefix="tidecast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidecast") -> SparkSession:
    """A local session configured like the tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
