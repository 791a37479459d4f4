"""Cleaning, winsorising and feature transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import clean, missing_flags, missing_mechanism, winsorize
from ..operators.features import (
    date_parts,
    engineer,
    interactions,
    log_skewed,
    raw_interactions,
    squared_skewed,
)
from ..plans.aggregates import small_table
from .common import GAPPY_LINEITEM, PRICED_LINEITEM, gappy_lineitem, priced_lineitem, steady, steady_sql, table, union_all

_FILLED = (
    "SELECT l_quantity, l_extendedprice, coalesce(l_discount, (SELECT median(l_discount) FROM g)) AS l_discount, "
    "coalesce(l_tax, (SELECT median(l_tax) FROM g)) AS l_tax, "
    "coalesce(l_returnflag, (SELECT l_returnflag FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag, "
    "l_linestatus, CAST(l_discount IS NULL AS INTEGER) AS l_discount_was_missing, CAST(l_tax IS NULL AS INTEGER) AS l_tax_was_missing, "
    "CAST(l_returnflag IS NULL AS INTEGER) AS l_returnflag_was_missing FROM g"
)


def cleaned_lines(spark, sf_dir):
    """Flags, median and mode fill, and distinct rows."""
    return clean(gappy_lineitem(spark, sf_dir)).data


def cleaning_report(spark, sf_dir):
    """What cleaning did to orders whose large prices and one priority are missing, prices clipped."""
    df = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.when(F.col("o_totalprice") < 350000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_totalprice") < 100000, F.col("o_totalprice")).alias("low_price"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        "o_orderstatus",
    )
    return clean(df, target="o_orderstatus", cap_outliers=True).report


def _report_sql() -> str:
    source = (
        "SELECT o_custkey, CASE WHEN o_totalprice < 350000 THEN o_totalprice END AS price, CASE WHEN o_totalprice < 100000 THEN o_totalprice END AS low_price, "
        "nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, o_orderstatus FROM orders"
    )
    filled = f"SELECT *, coalesce(price, (SELECT median(price) FROM ({source}))) AS full_price FROM ({source})"

    def outliers(v: str) -> str:
        stats = (
            f"(SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3, median({v}) AS m, mad({v}) AS mad FROM ({filled}))"
        )
        return (
            f"(SELECT count(*) FROM ({filled}) f, {stats} s WHERE (s.mad > 0 AND 0.6745 * abs(f.{v} - s.m) / s.mad > 3.5) "
            f"OR f.{v} < s.q1 - 1.5 * (s.q3 - s.q1) OR f.{v} > s.q3 + 1.5 * (s.q3 - s.q1))"
        )

    def gaps(c: str) -> str:
        return f"(SELECT count(*) - count({c}) FROM ({source}))"

    rows = []
    for i, (c, v) in enumerate((("o_custkey", "o_custkey"), ("price", "full_price"), ("low_price", "low_price"), ("priority", None), ("o_orderstatus", None))):
        share = f"{gaps(c)} * 100.0 / (SELECT count(*) FROM orders)"
        numeric = v is not None
        action = (
            "'target'" if c == "o_orderstatus"
            else f"CASE WHEN {share} > 40 THEN 'high_missing' WHEN {share} > 0 THEN '{'median' if numeric else 'mode'}' ELSE 'none' END"
        )
        fill = "NULL"
        if c == "price":
            fill = f"CASE WHEN {share} BETWEEN 1e-9 AND 40 THEN (SELECT printf('%.2f', median(price)) FROM ({source})) END"
        if c == "priority":
            fill = f"(SELECT priority FROM ({source}) WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
        n = outliers(v) if numeric else "NULL"
        capped = f"{outliers(v)} > 0" if numeric else "false"
        rows.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {gaps(c)} AS null_count, {action} AS action, {fill} AS fill_value, {n} AS outliers, {capped} AS winsorized"
        )
    return union_all(rows)


def duplicates_removed(spark, sf_dir):
    df = gappy_lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return clean(df).duplicates_removed()


def gap_mechanism(spark, sf_dir):
    """Whether gaps come together: prices missing above a limit, and priorities missing above a higher one."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    together = orders.select(
        F.when(price < 400000, price).alias("price"), F.when(price < 420000, F.col("o_orderpriority")).alias("priority")
    )
    apart = orders.select(
        F.when(price < 400000, price).alias("price"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    rows = []
    for name, df in (("together", together), ("apart", apart)):
        flagged = missing_flags(df, ["price", "priority"])
        rows.append((name, *missing_mechanism(flagged, ["price_was_missing", "priority_was_missing"])))
    return small_table(spark, rows, "source string, mechanism string, note string")


def _mechanism_sql() -> str:
    rows = []
    for name, second in (("together", "o_totalprice >= 420000"), ("apart", "o_orderpriority = '5-LOW'")):
        r = f"(SELECT abs(corr(CAST(o_totalprice >= 400000 AS INTEGER), CAST({second} AS INTEGER))) FROM orders)"
        rows.append(
            f"SELECT '{name}' AS source, CASE WHEN {r} > 0.3 THEN 'MAR/MNAR' ELSE 'MCAR' END AS mechanism, CASE WHEN {r} > 0.3 THEN "
            f"'Missing indicators show correlation (max r=' || printf('%.2f', {r}) || ') -> Suggests MAR/MNAR mechanism.' ELSE "
            "'Missing indicators are largely uncorrelated -> Suggests MCAR mechanism heuristic.' END AS note"
        )
    return union_all(rows)


def winsorized_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return winsorize(events, ["value"]).select("event_id", "event_type", F.round("value", 6).alias("value"))


# --- features ------------------------------------------------------------------------------------------------
def line_interactions(spark, sf_dir):
    """Centred products of moderately correlated columns."""
    df = priced_lineitem(spark, sf_dir).select("l_quantity", "l_extendedprice", "unit_price")
    out = interactions(df).drop("unit_price")
    return out.select(*[steady(F.col(c), 2).alias(c) for c in out.columns])


_INTERACTING = "SELECT l_quantity, l_extendedprice, unit_price FROM (" + PRICED_LINEITEM + ")"


def raw_line_interactions(spark, sf_dir):
    """Older form: plain products above a lower limit."""
    df = priced_lineitem(spark, sf_dir).select("l_quantity", "l_extendedprice", "unit_price")
    out = raw_interactions(df).drop("unit_price")
    return out.select(*[steady(F.col(c), 2).alias(c) for c in out.columns])


def logged_values(spark, sf_dir):
    """Logarithm of skewed columns, shifted where they reach zero or below."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "value", (F.col("value") - 10).alias("excess"), F.col("user_id").cast("double").alias("user")
    )
    out = log_skewed(events, ["value", "excess", "user"])
    return out.select(*[F.round(c, 6).alias(c) if c != "event_id" else F.col(c) for c in out.columns])


def squared_values(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return squared_skewed(events, ["value"]).select("event_id", "value", F.round("value_sq", 4).alias("value_sq"))


def order_dates(spark, sf_dir):
    """Date parts of a timestamp and of a date written as text."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy").alias("written"), "o_orderstatus"
    )
    return date_parts(orders)


def engineered_report(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = engineer(events).report
    return found.select(
        "kind", "feature", "source", F.round("before", 4).alias("before"), F.round("after", 4).alias("after")
    )


def _dates_sql(c: str) -> str:
    day = "isodow(o_orderdate) - 1"
    return (
        f"CAST(year(o_orderdate) AS INTEGER) AS {c}_year, CAST(month(o_orderdate) AS INTEGER) AS {c}_month, "
        f"CAST({day} AS INTEGER) AS {c}_dayofweek, CAST({day} >= 5 AS INTEGER) AS {c}_is_weekend"
    )


QUERIES = {
    "cleaned_lines": (cleaned_lines, f"WITH g AS ({GAPPY_LINEITEM}) SELECT DISTINCT * FROM ({_FILLED})"),
    "cleaning_report": (cleaning_report, _report_sql()),
    "duplicates_removed": (
        duplicates_removed,
        f"WITH g AS ({GAPPY_LINEITEM}), f AS ({_FILLED}), s AS (SELECT * EXCLUDE (l_extendedprice) FROM f) "
        "SELECT (SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS duplicates_removed",
    ),
    "gap_mechanism": (gap_mechanism, _mechanism_sql()),
    "winsorized_events": (
        winsorized_events,
        "SELECT event_id, event_type, round(least(greatest(value, (SELECT quantile_cont(value, 0.01) FROM events)), "
        "(SELECT quantile_cont(value, 0.99) FROM events)), 6) AS value FROM events",
    ),
    "line_interactions": (
        line_interactions,
        f"WITH s AS ({_INTERACTING}), m AS (SELECT CAST(printf('%.12g', avg(l_quantity)) AS DOUBLE) AS a, CAST(printf('%.12g', avg(l_extendedprice)) AS DOUBLE) AS b, "
        "CAST(printf('%.12g', avg(unit_price)) AS DOUBLE) AS c FROM s) "
        f"SELECT {steady_sql('l_quantity', 2)} AS l_quantity, {steady_sql('l_extendedprice', 2)} AS l_extendedprice, "
        f"{steady_sql('((l_quantity - a) * (unit_price - c))', 2)} AS l_quantity_x_unit_price, "
        f"{steady_sql('((l_extendedprice - b) * (unit_price - c))', 2)} AS l_extendedprice_x_unit_price FROM s, m",
    ),
    "raw_line_interactions": (
        raw_line_interactions,
        f"SELECT {steady_sql('l_quantity', 2)} AS l_quantity, {steady_sql('l_extendedprice', 2)} AS l_extendedprice, "
        f"{steady_sql('(l_quantity * unit_price)', 2)} AS l_quantity_x_unit_price FROM ({_INTERACTING})",
    ),
    "logged_values": (
        logged_values,
        "SELECT event_id, round(value, 6) AS value, round(value - 10, 6) AS excess, round(CAST(user_id AS DOUBLE), 6) AS user, "
        "round(ln(1 + value + (SELECT CASE WHEN min(value) <= 0 THEN abs(min(value)) + 1 ELSE 0 END FROM events)), 6) AS value_log1p, "
        "round(ln(1 + value - 10 + (SELECT CASE WHEN min(value - 10) <= 0 THEN abs(min(value - 10)) + 1 ELSE 0 END FROM events)), 6) AS excess_log1p FROM events",
    ),
    "squared_values": (squared_values, "SELECT event_id, value, round(value * value, 4) AS value_sq FROM events"),
    "order_dates": (
        order_dates,
        f"SELECT o_orderkey, o_orderstatus, {_dates_sql('o_orderdate')}, {_dates_sql('written')} FROM orders",
    ),
    "engineered_report": (
        engineered_report,
        "SELECT 'log1p' AS kind, 'value_log1p' AS feature, 'value' AS source, round(skewness(value), 4) AS before, round(skewness(ln(1 + value + shift)), 4) AS after "
        "FROM events, (SELECT CASE WHEN min(value) <= 0 THEN abs(min(value)) + 1 ELSE 0 END AS shift FROM events) "
        + "".join(
            f"UNION ALL SELECT 'date_part', 'ts_{p}', 'ts', NULL, NULL " for p in ("year", "month", "dayofweek", "is_weekend")
        ),
    ),
}
