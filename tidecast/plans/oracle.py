"""DuckDB text of the fixtures, written independently of the Spark builders.

``with_fixtures(body, *names)`` prefixes a query with the CTEs it needs (dependencies
are pulled in automatically, in order).
"""

from __future__ import annotations

PANEL = ("premium", "price_up", "price_down", "vol_up", "vol_down")

_FFILL = ",\n    ".join(f"last_value(r.{c} IGNORE NULLS) OVER w AS {c}" for c in PANEL)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "span": (
        (),
        """SELECT d0, d0 + CAST(n // 3 AS INTEGER) AS d_third, d0 + CAST(n * 7 // 10 AS INTEGER) AS d_eval, d0 + CAST(n * 7 // 9 AS INTEGER) AS d_val
    FROM (SELECT min(CAST(ts AS DATE)) AS d0, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS n FROM events)""",
    ),
    "hourly_raw": (
        (),
        """SELECT event_type AS zone, date_trunc('hour', ts) AS ts,
           avg(value) AS premium, max(value) AS price_up, min(value) AS price_down,
           sum(value) AS vol_up, CAST(count(*) AS DOUBLE) AS vol_down
    FROM events GROUP BY 1, 2""",
    ),
    "spine": (
        ("hourly_raw",),
        """SELECT zone, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS ts
    FROM (SELECT zone, min(ts) AS t0, max(ts) AS t1 FROM hourly_raw GROUP BY zone)""",
    ),
    "hourly": (
        ("spine", "hourly_raw"),
        f"""SELECT s.zone, s.ts,
    {_FFILL}
    FROM spine s LEFT JOIN hourly_raw r ON r.zone = s.zone AND r.ts = s.ts
    WINDOW w AS (PARTITION BY s.zone ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "actuals": (
        ("hourly", "span"),
        """SELECT zone, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, premium AS y
    FROM hourly, span WHERE ts >= d_eval""",
    ),
    "samples": (
        ("span",),
        """SELECT 'hist' AS model, '1' AS run_id, event_type AS zone, CAST(hour(ts) AS INTEGER) AS hour,
           event_id AS sample_id, value AS x
    FROM events, span WHERE CAST(ts AS DATE) >= d0 AND CAST(ts AS DATE) < d_eval
    UNION ALL
    SELECT 'early', '2', event_type, CAST(hour(ts) AS INTEGER), event_id, value
    FROM events, span WHERE CAST(ts AS DATE) >= d0 AND CAST(ts AS DATE) < d_third
    UNION ALL
    SELECT 'late', '3', event_type, CAST(hour(ts) AS INTEGER), event_id, value
    FROM events, span WHERE CAST(ts AS DATE) >= d_third AND CAST(ts AS DATE) < d_eval""",
    ),
    "order_hours": (
        (),
        """SELECT s.zone, s.ts, coalesce(r.value, 0.0) AS value
    FROM (SELECT zone, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
          FROM (SELECT o_orderpriority AS zone, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts FROM orders) GROUP BY zone) s
    LEFT JOIN (SELECT o_orderpriority AS zone, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2) r
      ON r.zone = s.zone AND r.ts = s.ts""",
    ),
    "settlement_input": (
        ("hourly",),
        """SELECT zone, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
           price_down AS da_price, hour(ts) % 3 = 0 AS activated,
           coalesce(vol_up - lag(vol_up) OVER (PARTITION BY zone ORDER BY ts), 0.0) AS imbalance_mw
    FROM hourly""",
    ),
    "strategies": (
        (),
        """SELECT * FROM (VALUES
      ('Naive', 'naive', 'late', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
      ('Point Forecast', 'point', 'late', 50.0, NULL, NULL, NULL, NULL),
      ('PT-Normal', 'prob_threshold', 'hist', 60.0, 0.7, NULL, NULL, NULL),
      ('EV-Normal', 'expected_value', 'hist', NULL, NULL, 60.0, NULL, NULL),
      ('CVaR-Normal', 'cvar', 'hist', NULL, NULL, 60.0, 0.95, 0.3),
      ('PT-Skewed-t', 'prob_threshold', 'late', 60.0, 0.7, NULL, NULL, NULL),
      ('EV-Skewed-t', 'expected_value', 'late', NULL, NULL, 60.0, NULL, NULL),
      ('CVaR-Skewed-t', 'cvar', 'late', NULL, NULL, 60.0, 0.95, 0.3)
    ) t(strategy, rule, model, threshold, prob, da_price, alpha, risk)""",
    ),
}


CTES["forecast_wide"] = (
    ("samples", "actuals"),
    """SELECT f.model, a.zone, a.date, a.hour, f.mean, f.median, f.std, f.q05, f.q25, f.q75, f.q95,
           a.y AS realized
    FROM (SELECT model, zone, hour, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
                 stddev_pop(x) AS std, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25,
                 quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95
          FROM samples GROUP BY model, zone, hour) f
    JOIN actuals a ON a.zone = f.zone AND a.hour = f.hour""",
)

CTES["quantile_fc"] = (
    ("samples",),
    """SELECT model, zone, hour, unnest(qs) AS q, unnest(vs) AS value
    FROM (SELECT model, zone, hour, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[] AS qs,
                 quantile_cont(x, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS vs
          FROM samples GROUP BY model, zone, hour)""",
)

CTES["param_fc"] = (
    ("samples",),
    """SELECT model, zone, hour, loc, scale,
           1 + least(greatest(coalesce(ku, 0.0) / 2, 0.0), 10.0) AS tailweight,
           least(greatest(coalesce(sk, 0.0), -10.0), 10.0) AS skewness,
           3 + CASE WHEN sk > 0 THEN least(sk, 5.0) ELSE 0.0 END AS a,
           3 + CASE WHEN sk < 0 THEN least(-sk, 5.0) ELSE 0.0 END AS b
    FROM (SELECT model, zone, hour, loc, scale,
                 CASE WHEN scale > 1e-9 * (1 + abs(loc)) THEN m3 / pow(m2, 1.5) END AS sk,
                 CASE WHEN scale > 1e-9 * (1 + abs(loc)) THEN m4 / (m2 * m2) - 3 END AS ku
          FROM (SELECT model, zone, hour, avg(x) AS loc, stddev_pop(x) AS scale,
                       avg(pow(x - mx, 2)) AS m2, avg(pow(x - mx, 3)) AS m3, avg(pow(x - mx, 4)) AS m4
                FROM (SELECT *, avg(x) OVER (PARTITION BY model, zone, hour) AS mx FROM samples)
                GROUP BY model, zone, hour))""",
)


def register_cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(body: str, *names: str, local: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixtures in dependency order>, <local CTEs> <body>``."""
    parts = [f"{n} AS (\n    {CTES[n][1]}\n)" for n in _order(names)]
    parts += [f"{n} AS (\n    {sql}\n)" for n, sql in (local or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
