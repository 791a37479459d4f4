"""Class balance, leakage, exact split and imputation fitted on the training part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.target import class_balance, class_distribution, leakage, ml_prepare, ml_readiness, split
from ..plans.pairs import all_pairs
from .common import DOCS_LABELS, PRICED_LINEITEM, docs_labels, priced_lineitem, table, union_all
from .relations import _REVERSING, _reversing


def toxic_classes(spark, sf_dir):
    return class_distribution(docs_labels(spark, sf_dir), "toxic")


def toxic_balance(spark, sf_dir):
    return class_balance(docs_labels(spark, sf_dir), "toxic")


def price_leakage(spark, sf_dir):
    """Money columns that nearly repeat a numeric target."""
    return leakage(priced_lineitem(spark, sf_dir), "revenue")


def readiness(spark, sf_dir):
    """Supervised checks of line items with a target, redundancy checks of priced ones without."""
    checks = ml_readiness(_reversing(spark, sf_dir), "l_linestatus") | ml_readiness(priced_lineitem(spark, sf_dir))
    item = {
        "class_distribution": (F.col("class"), F.col("n")),
        "class_balance": (F.col("imbalance_severity"), F.col("imbalance_ratio")),
        "leakage": (F.col("column"), F.col("correlation")),
        "redundant": (F.concat_ws(" & ", "col1", "col2"), F.col("corr")),
        "vif": (F.col("column"), F.col("vif")),
    }
    parts = [
        checks[name].select(F.lit(name).alias("check"), what.alias("item"), value.cast("double").alias("value"))
        for name, (what, value) in item.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def status_leakage(spark, sf_dir):
    """A level that nearly repeats a text target with two values."""
    return leakage(_reversing(spark, sf_dir), "l_linestatus", limit=0.9)


def _leakage_sql(source: str, columns: list[str], target: str, limit: float) -> str:
    return union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", round(abs(corr({c}, {target})), 4) AS correlation FROM ({source}) HAVING abs(corr({c}, {target})) > {limit}"
            for i, c in enumerate(columns)
        ]
    )


def ordered_leakage(spark, sf_dir):
    """Priorities numbered by the first order that has them: how each number of an order goes with them."""
    orders = table(spark, sf_dir, "orders").withColumn("level", F.ascii("o_orderpriority").cast("double"))
    return leakage(orders.select("o_orderkey", "o_totalprice", "level", "o_orderpriority"), "o_orderpriority", -1.0, "o_orderkey").select(
        "position", "column", F.round("correlation", 3).alias("correlation")
    )


def _ordered_leakage_sql() -> str:
    source = (
        "SELECT o.*, ascii(o_orderpriority) AS level, code FROM orders o JOIN (SELECT o_orderpriority AS p, "
        "row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 AS code FROM orders GROUP BY 1) ON o_orderpriority = p"
    )
    return union_all(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", round(abs(corr({c}, code)), 3) AS correlation FROM ({source})"
            for i, c in enumerate(("o_orderkey", "o_totalprice", "level"))
        ]
    )


def _hash(seed: int, *texts: str) -> str:
    text = " || chr(31) || ".join([f"'{seed}'", *texts])
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def order_split(spark, sf_dir):
    """Split of line items in the order of a hash of their keys: size and content of both parts."""
    parts = split(table(spark, sf_dir, "lineitem"), keys=["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"])
    both = parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.sum("l_orderkey").alias("keys")
    )


_KEY_HASH = _hash(42, *[f"CAST({k} AS VARCHAR)" for k in ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")])

_ORDER_SPLIT = (
    "SELECT CASE WHEN place <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS part, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, "
    f"CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY {_KEY_HASH}) AS place "
    "FROM lineitem) GROUP BY ALL"
)


def flag_split(spark, sf_dir):
    """Split of rows that are mostly equal: the parts still have exact sizes."""
    parts = split(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), keys=["l_returnflag", "l_linestatus"])
    both = parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


_FLAG_SPLIT = (
    "SELECT CASE WHEN place <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS part, l_returnflag, l_linestatus, count(*) AS n FROM "
    f"(SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY {_hash(42, 'l_returnflag', 'l_linestatus')}) AS place FROM lineitem) GROUP BY ALL"
)


def _keyed_gaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("price"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
    )


_KEYED_GAPS = (
    "SELECT o_orderkey, CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price, "
    "nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, nullif(o_orderstatus, 'P') AS status FROM orders"
)


def prepared_parts(spark, sf_dir):
    """Train and test orders, gaps filled with train median and train mode; the target keeps its gaps."""
    parts = ml_prepare(_keyed_gaps(spark, sf_dir), target="status", keys=["o_orderkey"])
    both = parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))
    return both.select("part", F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "price", "priority", "status")


_PREPARED = (
    f"WITH placed AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY {_hash(42, 'CAST(o_orderkey AS VARCHAR)')}) AS place FROM ({_KEYED_GAPS})), "
    "cut AS (SELECT *, place <= floor(total * 0.8) AS is_train FROM placed), "
    "fit AS (SELECT median(price) AS price FROM cut WHERE is_train), "
    "top AS (SELECT priority FROM cut WHERE is_train AND priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1) "
    "SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, o_orderkey, coalesce(price, (SELECT price FROM fit)) AS price, "
    "coalesce(priority, (SELECT priority FROM top)) AS priority, status FROM cut"
)

_REDUNDANT = union_all(
    [
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM ({PRICED_LINEITEM})"
        for a, b in all_pairs(["l_quantity", "l_extendedprice", "revenue", "unit_price", "charge"])
    ]
)
_IS_OPEN = "CAST(l_linestatus = 'O' AS INTEGER)"
_READINESS = (
    f"WITH classes AS (SELECT l_linestatus AS c, count(*) AS n FROM ({_REVERSING}) GROUP BY 1), pairs AS ({_REDUNDANT}), "
    "ends AS (SELECT a AS c, r * r AS r2 FROM pairs UNION ALL SELECT b, r * r FROM pairs) "
    "SELECT 'class_distribution' AS \"check\", c AS item, n::DOUBLE AS value FROM classes "
    "UNION ALL SELECT 'class_balance', CASE WHEN ratio < 0.2 THEN 'severe' WHEN ratio < 0.5 THEN 'moderate' ELSE 'balanced' END, ratio "
    "FROM (SELECT round(min(n) / max(n), 4) AS ratio FROM classes) "
    "UNION ALL SELECT 'leakage', \"column\", correlation FROM "
    f"({_leakage_sql(_REVERSING, ['level', 'rate', 'l_tax'], _IS_OPEN, 0.95)}) "
    "UNION ALL SELECT 'redundant', a || ' & ' || b, round(r, 4) FROM pairs WHERE r > 0.9 "
    "UNION ALL SELECT 'vif', c, round(CASE WHEN max(r2) < 0.9999 THEN 1 / (1 - max(r2)) ELSE 999.0 END, 2) FROM ends GROUP BY c"
)

QUERIES = {
    "readiness": (readiness, _READINESS),
    "toxic_classes": (
        toxic_classes,
        f'SELECT CAST(toxic AS VARCHAR) AS "class", count(*) AS n FROM ({DOCS_LABELS}) WHERE toxic IS NOT NULL GROUP BY toxic',
    ),
    "toxic_balance": (
        toxic_balance,
        "SELECT count(*) AS classes, min(n) AS min_count, max(n) AS max_count, round(min(n) * 1.0 / max(n), 4) AS imbalance_ratio, "
        "CASE WHEN round(min(n) * 1.0 / max(n), 4) < 0.2 THEN 'severe' WHEN round(min(n) * 1.0 / max(n), 4) < 0.5 THEN 'moderate' ELSE 'balanced' END AS imbalance_severity "
        "FROM (SELECT count(*) AS n FROM labels WHERE toxic IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents) GROUP BY toxic)",
    ),
    "price_leakage": (
        price_leakage,
        _leakage_sql(PRICED_LINEITEM, ["l_quantity", "l_extendedprice", "unit_price", "charge"], "revenue", 0.95),
    ),
    "status_leakage": (
        status_leakage,
        _leakage_sql(_REVERSING, ["level", "rate", "l_tax"], "CAST(l_linestatus = 'O' AS INTEGER)", 0.9),
    ),
    "ordered_leakage": (ordered_leakage, _ordered_leakage_sql()),
    "order_split": (order_split, _ORDER_SPLIT),
    "flag_split": (flag_split, _FLAG_SPLIT),
    "prepared_parts": (prepared_parts, _PREPARED),
}
