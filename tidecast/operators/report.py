"""Report-table operators: ranks, heat bands, custom order, best candidate,
set operations on date sets (survey F1-F3, G1-G4, H1-H4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed band edges of the heat colouring (upper bounds of the normalised value).
BAND_EDGES = (0.1, 0.25, 0.4, 0.55, 0.7, 0.85)


def heat_bands(long_table: DataFrame, metric: str, value: str, model: str, exclude: Sequence[str] = ()) -> DataFrame:
    """per metric, min-max normalise over models not in ``exclude`` (excluded
    models are still banded), band 1..7 and the best-in-column flag (1e-6)."""
    w = Window.partitionBy(metric)
    keep = ~F.col(model).isin(*exclude) if exclude else F.lit(True)
    lo = F.min(F.when(keep, F.col(value))).over(w)
    hi = F.max(F.when(keep, F.col(value))).over(w)
    d = long_table.withColumns({"_lo": F.coalesce(lo, F.lit(0.0)), "_hi": F.coalesce(hi, F.lit(1.0))})
    norm = F.when(F.col("_hi") == F.col("_lo"), F.lit(None).cast("double")).otherwise(
        (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    band = F.lit(7)
    for i, edge in reversed(list(enumerate(BAND_EDGES, start=1))):
        band = F.when(F.col("norm") <= edge, F.lit(i)).otherwise(band)
    return (
        d.withColumn("norm", norm)
        .withColumn("band", F.when(F.col("norm").isNull(), F.lit(0)).otherwise(band))
        .withColumn("is_best", F.abs(F.col(value) - F.col("_lo")) < 1e-6)
        .drop("_lo", "_hi")
    )


def custom_order(model: Column, run_id: Column, model_order: Sequence[str]) -> list[Column]:
    """Model group order, then numeric runs ascending, then named runs."""
    pos = F.array_position(F.array(*[F.lit(m) for m in model_order]), model)
    return [
        F.when(pos == 0, F.lit(len(model_order) + 1)).otherwise(pos).asc(),
        run_id.try_cast("int").asc_nulls_last(),
        run_id.asc(),
    ]


def best_candidate(scored: DataFrame, keys: Sequence[str], loss: str, candidate: str) -> DataFrame:
    """Minimum-loss candidate per key (``min_by``) with its loss."""
    return scored.groupBy(*keys).agg(
        F.min_by(candidate, loss).alias(f"best_{candidate}"), F.min(loss).alias(f"best_{loss}")
    )


def top_k(scored: DataFrame, keys: Sequence[str], loss: str, k: int) -> DataFrame:
    """The ``k`` lowest-loss rows per key (leaderboard)."""
    w = Window.partitionBy(*keys).orderBy(F.col(loss).asc(), *[F.col(c) for c in scored.columns if c not in keys and c != loss])
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def dates_in_all(df: DataFrame, keys: Sequence[str], member: str, date: str) -> DataFrame:
    """D3/H1: dates present for every member (of the members seen under ``keys``)."""
    members = df.groupBy(*keys).agg(F.countDistinct(member).alias("_m"))
    per_date = df.groupBy(*keys, date).agg(F.countDistinct(member).alias("_c"))
    return per_date.join(members, on=list(keys)).where(F.col("_c") == F.col("_m")).select(*keys, date)


def date_sets_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Dates in ``a`` without ``b`` and the reverse, labelled by ``side``."""
    cols = [*keys, date]
    a_only = a.select(*cols).distinct().join(b.select(*cols), on=cols, how="left_anti")
    b_only = b.select(*cols).distinct().join(a.select(*cols), on=cols, how="left_anti")
    return a_only.withColumn("side", F.lit("left_only")).unionByName(b_only.withColumn("side", F.lit("right_only")))
