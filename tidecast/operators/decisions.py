"""Deterministic bidding rules and settlement (survey L1-L7).

Rules are column expressions over one forecast row (mean, median, quantile columns);
the strategy table says which rule and parameters apply and which model's forecasts
it reads.  Strategies join forecasts on ``model`` (an equi-join against a literal
table of a handful of rows), so no product of strategies and forecasts is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast

CAPACITY_MW = 50.0  # fixed: plant capacity of the bidding study


def quantile_columns(columns: Sequence[str]) -> list[tuple[float, str]]:
    """``qNN`` columns as (level, name), sorted by level."""
    out = []
    for c in columns:
        if len(c) == 3 and c[0] == "q" and c[1:].isdigit():
            out.append((int(c[1:]) / 100.0, c))
    return sorted(out)


def prob_exceed(qcols: Sequence[tuple[float, str]], threshold: Column) -> Column:
    """L3: ``1 - q`` of the smallest level whose quantile exceeds the threshold, else 0."""
    expr = F.lit(0.0)
    for q, c in reversed(list(qcols)):
        expr = F.when(F.col(c) > threshold, F.lit(1.0 - q)).otherwise(expr)
    return expr


def bid_decision(qcols: Sequence[tuple[float, str]], mean: Column, median: Column) -> Column:
    """L1-L5 as one CASE on ``rule``; returns struct(bid BOOLEAN, price DOUBLE)."""
    # the quantile column at each row's own alpha; the mean where there is none or it is null
    at_alpha = [F.when(F.abs(F.col("alpha") - q) < 1e-9, F.col(c)) for q, c in qcols]
    q_alpha = F.coalesce(*at_alpha, mean)
    p_exc = prob_exceed(qcols, F.col("threshold"))
    cvar_value = mean - F.col("risk") * (mean - q_alpha)
    bid = (
        F.when(F.col("rule") == "naive", F.lit(False))
        .when(F.col("rule") == "point", mean > F.col("threshold"))
        .when(F.col("rule") == "prob_threshold", p_exc >= F.col("prob"))
        .when(F.col("rule") == "expected_value", (mean - F.col("da_price")) > 0)
        .when(F.col("rule") == "cvar", cvar_value > F.col("da_price"))
        .otherwise(F.lit(False))
    )
    price = F.when(F.col("rule") == "prob_threshold", median).otherwise(mean)
    return F.struct(bid.alias("bid"), F.when(bid, price).otherwise(F.lit(0.0)).alias("price"))


def decisions(forecasts: DataFrame, strategies: DataFrame, mean: str = "mean", median: str = "median") -> DataFrame:
    """Per strategy and forecast hour: the bid flag and price.  B11: a missing mean
    falls back to the median and vice versa."""
    qcols = quantile_columns(forecasts.columns)
    m = F.coalesce(F.col(mean), F.col(median))
    md = F.coalesce(F.col(median), F.col(mean))
    j = forecasts.join(sized_broadcast(strategies, 10_000), on="model", how="inner")
    return j.withColumn("decision", bid_decision(qcols, m, md)).select(
        "*", F.col("decision.bid").alias("bid"), F.col("decision.price").alias("bid_price")
    ).drop("decision")


def settle(decided: DataFrame, market: DataFrame, keys: Sequence[str], capacity: float = CAPACITY_MW) -> DataFrame:
    """Per strategy totals in thousands: day-ahead revenue, imbalance cost,
    mFRR revenue, hours bid and profit.  ``market`` supplies ``da_price`` (as
    ``market_da_price``), ``activated`` and ``imbalance_mw`` per hour."""
    mk = market.withColumnRenamed("da_price", "market_da_price")
    j = decided.join(mk, on=list(keys), how="inner")
    bid = F.col("bid")
    da = F.when(bid, capacity * F.col("market_da_price")).otherwise(0.0)
    mfrr = F.when(bid & F.col("activated"), capacity * F.col("realized")).otherwise(0.0)
    imb = F.when(bid, F.abs(F.col("imbalance_mw")) * F.abs(F.col("realized") - F.col("market_da_price"))).otherwise(0.0)
    g = j.groupBy("strategy").agg(
        (F.sum(da) / 1000).alias("da_revenue"),
        (F.sum(imb) / 1000).alias("imb_cost"),
        (F.sum(mfrr) / 1000).alias("mfrr_revenue"),
        F.sum(bid.cast("long")).alias("hours_bid"),
    )
    return g.withColumn("total_profit", F.col("da_revenue") + F.col("mfrr_revenue") - F.col("imb_cost"))
