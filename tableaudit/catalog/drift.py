"""Rolling mean, drift and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import (
    box_stats,
    corr_heatmap,
    frequency,
    histogram,
    missing_matrix,
    top_pair,
    top_pair_scatter,
    trend,
    trend_means,
)
from ..operators.drift import drift_ks, rolling_mean_last, temporal_report
from .common import GAPPY_LINEITEM, gappy_lineitem, table, union_all
from .relations import _REVERSING, _reversing


def event_rolling_mean(spark, sf_dir):
    return rolling_mean_last(table(spark, sf_dir, "events"), "ts", "value")


def typed_rolling_mean(spark, sf_dir):
    """The last rolling mean of every kind of event."""
    return rolling_mean_last(table(spark, sf_dir, "events"), "ts", "value", by=["event_type"])


def order_drift(spark, sf_dir):
    """Distance of prices by order date; many orders share the date at the cut."""
    return drift_ks(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select("n_early", "n_late", "ks_stat")


def event_drift(spark, sf_dir):
    return drift_ks(table(spark, sf_dir, "events"), "ts", "value").select("n_early", "n_late", "ks_stat")


def _distance_sql(source: str, ts: str, value: str) -> str:
    return f"SELECT n_early, n_late, ks_stat FROM ({_drift_sql(source, ts, value)})"


def _drift_sql(source: str, ts: str, value: str, raw: bool = False) -> str:
    """The p value is the limit distribution of samples above 10 000 values, by its series."""
    placed = (
        f"SELECT {value} AS v, row_number() OVER (ORDER BY {ts} NULLS LAST, {value} NULLS LAST) <= count(*) OVER () // 2 AS early FROM {source}"
    )
    steps = (
        "SELECT sum(e) OVER w * 1.0 / sum(e) OVER () - sum(l) OVER w * 1.0 / sum(l) OVER () AS gap, sum(e) OVER () AS n1, sum(l) OVER () AS n2 FROM "
        f"(SELECT v, count(*) FILTER (WHERE early) AS e, count(*) FILTER (WHERE NOT early) AS l FROM ({placed}) WHERE v IS NOT NULL GROUP BY v) "
        "WINDOW w AS (ORDER BY v)"
    )
    if raw:
        return f"SELECT CAST(max(n1) AS BIGINT) AS n_early, CAST(max(n2) AS BIGINT) AS n_late, max(abs(gap)) AS d FROM ({steps})"
    x = "(d * sqrt(n1 * n2 * 1.0 / (n1 + n2)))"
    tail = f"2.0 * list_sum(list_transform(range(1, 101), lambda k : (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * {x} * {x})))"
    p = f"least(1.0, greatest(0.0, {tail}))"
    return (
        f"SELECT CAST(n1 AS BIGINT) AS n_early, CAST(n2 AS BIGINT) AS n_late, round(d, 4) AS ks_stat, round({p}, 4) AS ks_pvalue, {p} < 0.05 AS drift_detected "
        f"FROM (SELECT max(abs(gap)) AS d, max(n1) AS n1, max(n2) AS n2 FROM ({steps}))"
    )


def order_drift_limit(spark, sf_dir):
    """The same with p value and decision by the limit distribution, whatever the number of orders."""
    return drift_ks(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", method="limit")


def event_drift_limit(spark, sf_dir):
    return drift_ks(table(spark, sf_dir, "events"), "ts", "value", method="limit")


def purchase_drift_exact(spark, sf_dir):
    """Drift of the values of one kind of event in the first days, by counting paths."""
    return drift_ks(table(spark, sf_dir, "events").where(_EARLY), "ts", "value", method="exact")


_EARLY = "event_type = 'purchase' AND ts < TIMESTAMP_NTZ '2024-01-05 00:00:00'"


def _exact_sql() -> str:
    """Paths counted by a walk over the lattice of both halves."""
    source = "(SELECT * FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-05 00:00:00')"
    found = f"SELECT n_early AS m, n_late AS n, d FROM ({_drift_sql(source, 'ts', 'value', raw=True)})"
    return (
        f"WITH RECURSIVE f AS MATERIALIZED ({found}), walk(i, shares) AS ("
        # one row of the lattice after the other: the share of paths to (i, j) that have touched a line
        "SELECT 0, list_transform(range(n + 1), lambda j : CASE WHEN j / n >= d - 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END) FROM f "
        "UNION ALL SELECT i + 1, list_reduce(list_transform(range(n + 1), lambda j : [j::DOUBLE, shares[j + 1]]), "
        "lambda acc, x : list_append(acc, CASE WHEN abs((i + 1) / m - x[1] / n) >= d - 1e-12 THEN 1.0 "
        "ELSE (x[2] * (i + 1) + acc[-1] * x[1]) / (i + 1 + x[1]) END), "
        "[CASE WHEN (i + 1) / m >= d - 1e-12 THEN 1.0::DOUBLE ELSE shares[1] END])[2:] FROM walk, f WHERE i < m) "
        "SELECT m::BIGINT AS n_early, n::BIGINT AS n_late, round(d, 4) AS ks_stat, round(shares[-1], 4) AS ks_pvalue, "
        "shares[-1] < 0.05 AS drift_detected FROM walk, f WHERE i = m"
    )


def ship_drift(spark, sf_dir):
    """Drift of prices by shipping date, with halves above 10 000 values."""
    return drift_ks(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")


def event_timeline(spark, sf_dir):
    """The temporal report of events without their keys."""
    out = temporal_report(table(spark, sf_dir, "events").select("ts", "value", "event_type"))
    return out.select("has_datetime", "date_col", "metric", "rolling_mean_last", "ks_stat", F.date_format("first_time", "yyyy-MM-dd").alias("first_day"),
                      F.date_format("last_time", "yyyy-MM-dd").alias("last_day"))


def _rolling(source: str, ts: str, value: str) -> str:
    return f"SELECT round(avg({value}), 4) FROM (SELECT {value} FROM {source} ORDER BY {ts} DESC NULLS FIRST, {value} DESC NULLS FIRST LIMIT 30)"


# --- charts --------------------------------------------------------------------------------------------------
_GAPPY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def heatmap(spark, sf_dir):
    return corr_heatmap(gappy_lineitem(spark, sf_dir)).select("x", "y", F.round("r", 6).alias("r"))


def order_trend(spark, sf_dir):
    """The mean price of all orders by month."""
    means = trend_means(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "month")
    return means.select(F.date_format("ts", "yyyy-MM").alias("month"), "n", F.round("mean", 4).alias("mean"))


def _heatmap_sql() -> str:
    return union_all(
        [
            f"SELECT '{a}' AS x, '{b}' AS y, {f'round(corr({a}, {b}), 6)' if a != b else 'max(1.0::DOUBLE)'} AS r FROM ({GAPPY_LINEITEM})"
            for a in _GAPPY
            for b in _GAPPY
        ]
    )


def value_histogram(spark, sf_dir):
    return histogram(table(spark, sf_dir, "events"), "value").select(
        "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n"
    )


_HISTOGRAM = (
    "WITH s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM events), "
    "b AS (SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1) "
    "SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n "
    "FROM s, range(0, 30) t(i) LEFT JOIN b ON b.bin = i"
)


def boxes(spark, sf_dir):
    found = box_stats(gappy_lineitem(spark, sf_dir))
    return found.select("position", "column", *[F.round(c, 4).alias(c) for c in ("q25", "median", "q75", "whisker_low", "whisker_high")], "n_outside")


def _boxes_sql() -> str:
    parts = []
    for i, c in enumerate(_GAPPY):
        inside = f"{c} BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", round(max(q25), 4) AS q25, round(max(med), 4) AS median, round(max(q75), 4) AS q75, "
            f"round(min({c}) FILTER (WHERE {inside}), 4) AS whisker_low, round(max({c}) FILTER (WHERE {inside}), 4) AS whisker_high, "
            f"count(*) FILTER (WHERE NOT ({inside})) AS n_outside FROM ({GAPPY_LINEITEM}), "
            f"(SELECT quantile_cont({c}, 0.25) AS q25, median({c}) AS med, quantile_cont({c}, 0.75) AS q75 FROM ({GAPPY_LINEITEM}))"
        )
    return union_all(parts)


def strongest_pair(spark, sf_dir):
    return top_pair(_reversing(spark, sf_dir)).select("col1", "col2", F.round("r", 6).alias("r"))


def event_scatter(spark, sf_dir):
    """Sample points of the strongest pair of events with a derived column."""
    events = table(spark, sf_dir, "events").select("event_id", "value", F.sqrt("value").alias("root"))
    return top_pair_scatter(events, ["value", "root"], rows=1000, keys=["event_id"]).select(
        "x_name", "y_name", "x", F.round("y", 6).alias("y")
    )


_EVENT_ORDER = "CAST('0x' || substr(md5('42' || chr(31) || event_id), 1, 13) AS BIGINT)"


def event_trend(spark, sf_dir):
    out = trend(table(spark, sf_dir, "events"), "ts", "value", rows=1000, keys=["event_id"])
    return out.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value")


def priority_frequency(spark, sf_dir):
    return frequency(table(spark, sf_dir, "orders"), "o_orderpriority")


def gap_matrix(spark, sf_dir):
    """Rows of the 0/1 matrix of missing cells, counted by pattern."""
    cells = missing_matrix(gappy_lineitem(spark, sf_dir))
    return cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n"))


_PATTERN = [*_GAPPY, "l_returnflag", "l_linestatus"]

QUERIES = {
    "event_rolling_mean": (
        event_rolling_mean,
        f"SELECT ({_rolling('events', 'ts', 'value')}) AS rolling_mean_last",
    ),
    "typed_rolling_mean": (
        typed_rolling_mean,
        "SELECT event_type, round(avg(value), 4) AS rolling_mean_last FROM (SELECT * FROM events QUALIFY row_number() OVER "
        "(PARTITION BY event_type ORDER BY ts DESC NULLS FIRST, value DESC NULLS FIRST) <= 30) GROUP BY event_type",
    ),
    "order_drift": (order_drift, _distance_sql("orders", "o_orderdate", "o_totalprice")),
    "event_drift": (event_drift, _distance_sql("events", "ts", "value")),
    "ship_drift": (ship_drift, _drift_sql("lineitem", "l_shipdate", "l_extendedprice")),
    "order_drift_limit": (order_drift_limit, _drift_sql("orders", "o_orderdate", "o_totalprice")),
    "event_drift_limit": (event_drift_limit, _drift_sql("events", "ts", "value")),
    "purchase_drift_exact": (purchase_drift_exact, _exact_sql()),
    "event_timeline": (
        event_timeline,
        f"SELECT true AS has_datetime, 'ts' AS date_col, 'value' AS metric, ({_rolling('events', 'ts', 'value')}) AS rolling_mean_last, "
        f"(SELECT ks_stat FROM ({_drift_sql('events', 'ts', 'value')})) AS ks_stat, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events",
    ),
    "heatmap": (heatmap, _heatmap_sql()),
    "value_histogram": (value_histogram, _HISTOGRAM),
    "boxes": (boxes, _boxes_sql()),
    "strongest_pair": (
        strongest_pair,
        "SELECT col1, col2, round(r, 6) AS r FROM ("
        + union_all(
            [
                f"SELECT {i} AS p, '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM ({_REVERSING})"
                for i, (a, b) in enumerate((("level", "rate"), ("level", "l_tax"), ("rate", "l_tax")))
            ]
        )
        + ") ORDER BY abs(r) DESC, p LIMIT 1",
    ),
    "event_scatter": (
        event_scatter,
        f"SELECT 'value' AS x_name, 'root' AS y_name, value AS x, round(sqrt(value), 6) AS y FROM events ORDER BY {_EVENT_ORDER} LIMIT 1000",
    ),
    "event_trend": (event_trend, f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, value FROM events ORDER BY {_EVENT_ORDER} LIMIT 1000"),
    "order_trend": (
        order_trend,
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1",
    ),
    "priority_frequency": (
        priority_frequency,
        "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
    ),
    "gap_matrix": (
        gap_matrix,
        "SELECT " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in _PATTERN) + f", count(*) AS n FROM ({GAPPY_LINEITEM}) GROUP BY ALL",
    ),
}
