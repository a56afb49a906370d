"""Bidding rules and settlement: L1-L7 (with B11, B14, D6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query
from .util import r, rounded

HOUR_KEYS = ["zone", "date", "hour"]


def _decided(spark, sf):
    return decisions.decisions(fx.forecast_wide(spark, sf), fx.strategies(spark))


_PEXC = (
    "CASE WHEN f.q05 > s.threshold THEN 0.95 WHEN f.q25 > s.threshold THEN 0.75 "
    "WHEN f.q75 > s.threshold THEN 0.25 WHEN f.q95 > s.threshold THEN 0.05 ELSE 0.0 END"
)
_DEC = [
    (
        "dec0",
        f"""SELECT s.strategy, s.rule, f.zone, f.date, f.hour, f.realized,
           coalesce(f.mean, f.median) AS m, coalesce(f.median, f.mean) AS md,
           CASE s.rule WHEN 'naive' THEN false
                       WHEN 'point' THEN coalesce(f.mean, f.median) > s.threshold
                       WHEN 'prob_threshold' THEN ({_PEXC}) >= s.prob
                       WHEN 'expected_value' THEN coalesce(f.mean, f.median) - s.da_price > 0
                       WHEN 'cvar' THEN coalesce(f.mean, f.median) - s.risk * (coalesce(f.mean, f.median) - coalesce(
                           CASE s.alpha WHEN 0.05 THEN f.q05 WHEN 0.25 THEN f.q25 WHEN 0.75 THEN f.q75 WHEN 0.95 THEN f.q95 END, f.mean, f.median)) > s.da_price
                       ELSE false END AS bid
    FROM forecast_wide f JOIN strategies s ON s.model = f.model""",
    ),
    (
        "dec",
        """SELECT strategy, zone, date, hour, realized, bid,
           CASE WHEN bid THEN (CASE WHEN rule = 'prob_threshold' THEN md ELSE m END) ELSE 0.0 END AS bid_price
    FROM dec0""",
    ),
]


def _rule_query(rule_id: str, strategy_names: list[str]):
    names = ", ".join(f"'{n}'" for n in strategy_names)
    sql = with_fixtures(
        f"SELECT strategy, zone, date, hour, bid, {r('bid_price', 'bid_price')} FROM dec WHERE strategy IN ({names})",
        "forecast_wide",
        "strategies",
        local=_DEC,
    )

    def build(spark, sf):
        d = _decided(spark, sf).where(F.col("strategy").isin(*strategy_names))
        return rounded(d.select("strategy", *HOUR_KEYS, "bid", "bid_price"))

    build.__doc__ = f"{rule_id}: hourly bid decisions of {', '.join(strategy_names)}."
    return sql, build


for _id, _names in (
    ("l1_naive_rule", ["Naive"]),
    ("l2_point_rule", ["Point Forecast"]),
    ("l3_prob_threshold_rule", ["PT-Normal", "PT-Skewed-t"]),
    ("l4_expected_value_rule", ["EV-Normal", "EV-Skewed-t"]),
    ("l5_cvar_rule", ["CVaR-Normal", "CVaR-Skewed-t"]),
):
    _sql, _fn = _rule_query(_id, _names)
    query(_id, _sql)(_fn)

_SETTLE = """SELECT d.strategy,
       sum(CASE WHEN d.bid THEN 50.0 * m.da_price ELSE 0.0 END) / 1000 AS da_revenue,
       sum(CASE WHEN d.bid THEN abs(m.imbalance_mw) * abs(d.realized - m.da_price) ELSE 0.0 END) / 1000 AS imb_cost,
       sum(CASE WHEN d.bid AND m.activated THEN 50.0 * d.realized ELSE 0.0 END) / 1000 AS mfrr_revenue,
       CAST(sum(CASE WHEN d.bid THEN 1 ELSE 0 END) AS BIGINT) AS hours_bid
FROM dec d JOIN settlement_input m ON m.zone = d.zone AND m.date = d.date AND m.hour = d.hour
GROUP BY d.strategy"""


def _settled(spark, sf):
    return decisions.settle(_decided(spark, sf), fx.settlement_input(spark, sf), HOUR_KEYS)


@query(
    "l6_settlement",
    with_fixtures(
        "SELECT strategy, "
        + ", ".join(r(c, c) for c in ("da_revenue", "imb_cost", "mfrr_revenue"))
        + ", hours_bid, "
        + r("da_revenue + mfrr_revenue - imb_cost", "total_profit")
        + " FROM st",
        "forecast_wide",
        "strategies",
        "settlement_input",
        local=_DEC + [("st", _SETTLE)],
    ),
)
def l6_settlement(spark, sf):
    return rounded(_settled(spark, sf))


@query(
    "l7_strategy_table",
    with_fixtures(
        "SELECT strategy, "
        + ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 2) + 0.0 AS {c}" for c in ("da_revenue", "imb_cost", "mfrr_revenue"))
        + ", hours_bid, round(da_revenue + mfrr_revenue - imb_cost + 1e-9, 2) + 0.0 AS total_profit,"
        " CAST(rank() OVER (ORDER BY da_revenue + mfrr_revenue - imb_cost DESC) AS INTEGER) AS profit_rank FROM st",
        "forecast_wide",
        "strategies",
        "settlement_input",
        local=_DEC + [("st", _SETTLE)],
    ),
)
def l7_strategy_table(spark, sf):
    st = _settled(spark, sf).withColumn("profit_rank", F.rank().over(Window.orderBy(F.col("total_profit").desc())))
    return rounded(st, 2)
