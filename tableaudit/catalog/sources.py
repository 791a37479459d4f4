"""Readers, parts, types, sampling and schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.relations import category_values
from ..operators.target import detect_target, detect_target_or_classes, schema_evidence
from ..plans.aggregates import small_table
from ..plans.materialise import ensure_checkpoint_dir
from ..sources.readers import EmptyDatasetError, flatten, infer_types, read_table, resolve_parts
from ..sources.sampling import sample_rows
from ..sources.sinks import write_run
from .common import DOCS_LABELS, docs_labels, table, union_all


def parts_union(spark, sf_dir):
    """Parts with the same columns in a different order are stacked."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    empty = customers.where("balance > 1e12")
    return resolve_parts({"customers": customers, "empty": empty, "suppliers": suppliers})


def parts_densest(spark, sf_dir):
    """Parts with different columns: the one with the most non-missing cells."""
    return resolve_parts({n: table(spark, sf_dir, n) for n in ("region", "supplier", "customer")})


def typed_text(spark, sf_dir):
    """A table read as text, with tokens for missing values, gets its types back."""
    text = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("custkey"),
        F.when(F.col("c_nationkey") == 0, "N/A")
        .otherwise(F.concat(F.lit("+"), F.col("c_nationkey").cast("string")))
        .alias("nation"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(F.col("c_mktsegment") == "BUILDING", "null").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, "True").otherwise("False").alias("in_credit"),
    )
    return infer_types(text)


def csv_round_trip(spark, sf_dir):
    """A table written as a run's CSV and read back: the same values and types."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return read_table(spark, write_run(customers, root, f"round-trip-{uuid.uuid4().hex}", "customer.csv", "csv"))


def json_round_trip(spark, sf_dir):
    """A table written as JSON lines and read back by its extension: the same values and types."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = write_run(customers, root, f"round-trip-{uuid.uuid4().hex}", "customer.jsonl", "json")
    return read_table(spark, path).select(*customers.columns)


def quoted_csv(spark, sf_dir):
    """Documents with line breaks written as CSV and read back by splits: the same texts."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    back = read_table(spark, write_run(docs, root, f"quoted-{uuid.uuid4().hex}", "documents.csv", "csv"))
    return back.select("doc_id", "source", F.length("text").cast("bigint").alias("size"), F.md5("text").alias("digest"))


def json_documents(spark, sf_dir):
    """Documents written as JSON files, each one object with a list of up to 500 records, and read back by splits."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/documents-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", "n_chars").alias("about"), "text")
    part = F.floor(F.monotonically_increasing_id() / 500)
    files = docs.groupBy(part.alias("part")).agg(F.collect_list(F.struct("doc_id", "about", "text")).alias("records"))
    document = F.to_json(F.struct(F.struct("part", F.array(F.lit(1)).alias("list")).alias("meta"), "records"))
    files.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    back = read_table(spark, folder, "json")
    return back.select(
        "doc_id",
        F.col("`about.source`").alias("source"),
        F.col("`about.n_chars`").alias("n_chars"),
        F.md5("text").alias("digest"),
    )


def empty_inputs(spark, sf_dir):
    """What reading says of every table as it is and without its rows."""
    ensure_checkpoint_dir(spark)
    root, found = spark.sparkContext.getCheckpointDir(), []
    for name in ("region", "customer", "orders", "documents"):
        df = table(spark, sf_dir, name)
        for kind, rows in (("all", df), ("none", df.where(F.lit(False)))):
            path = f"{sf_dir}/{name}.parquet" if kind == "all" else write_run(rows, root, uuid.uuid4().hex, f"{name}.parquet")
            try:
                found.append((name, kind, "rows" if read_table(spark, path, "parquet").columns == df.columns else "other columns"))
            except EmptyDatasetError:
                found.append((name, kind, "empty"))
    return small_table(spark, found, "source string, kind string, outcome string")


def flat_events(spark, sf_dir):
    """Nested objects become dotted columns."""
    events = table(spark, sf_dir, "events")
    nested = events.select(
        "event_id", F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("props")).alias("body")
    )
    return flatten(nested)


def sampled_orders(spark, sf_dir):
    drawn = sample_rows(table(spark, sf_dir, "orders"), 500, seed=42, keys=["o_orderkey"])
    return drawn.select("o_orderkey", "o_totalprice", "o_orderpriority")


def lineitem_schema(spark, sf_dir):
    return schema_evidence(table(spark, sf_dir, "lineitem"), "l_linestatus")


_LINEITEM = [
    ("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True), ("l_quantity", True),
    ("l_extendedprice", True), ("l_discount", True), ("l_tax", True), ("l_returnflag", False),
    ("l_linestatus", False), ("l_shipdate", False),
]


_DTYPE = (
    "CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
    "ELSE lower(typeof({c})) END"
)


def targets(spark, sf_dir):
    """The detected target column of three tables."""
    found = [
        ("docs_labels", detect_target(docs_labels(spark, sf_dir))),
        ("embeddings", detect_target(table(spark, sf_dir, "embeddings"))),
        ("lineitem", detect_target(table(spark, sf_dir, "lineitem"))),
        ("orders (older rule)", detect_target_or_classes(table(spark, sf_dir, "orders"))),
    ]
    return small_table(spark, found, "source string, target string")


def _first_with(source: str, columns: list[str], want: str) -> str:
    whens = " ".join(f"WHEN count(DISTINCT {c}) {want} THEN '{c}'" for c in columns)
    return f"(SELECT CASE {whens} END FROM ({source}))"


def low_cardinality(spark, sf_dir):
    """Values of the non-numeric columns with fewer than 20 distinct values."""
    levels = category_values(table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    ))
    rows = [(c, i, v) for c, values in levels.items() for i, v in enumerate(values)]
    return small_table(spark, rows, "column string, place int, value string")


_JOINED = "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"

QUERIES = {
    "parts_union": (
        parts_union,
        "SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer "
        "UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier",
    ),
    "parts_densest": (parts_densest, "SELECT * FROM customer"),
    "typed_text": (
        typed_text,
        "SELECT c_custkey AS custkey, CAST(nullif(c_nationkey, 0) AS BIGINT) AS nation, "
        "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, nullif(c_mktsegment, 'BUILDING') AS segment, "
        "c_acctbal > 0 AS in_credit FROM customer",
    ),
    "csv_round_trip": (csv_round_trip, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"),
    "json_round_trip": (json_round_trip, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"),
    "quoted_csv": (
        quoted_csv,
        "SELECT doc_id, source, length(text) AS size, md5(text) AS digest FROM documents",
    ),
    "json_documents": (json_documents, "SELECT doc_id, source, n_chars, md5(text) AS digest FROM documents"),
    "empty_inputs": (
        empty_inputs,
        union_all(
            [
                f"SELECT '{t}' AS source, 'all' AS kind, CASE WHEN count(*) > 0 THEN 'rows' ELSE 'empty' END AS outcome FROM {t} "
                f"UNION ALL SELECT '{t}', 'none', 'empty'"
                for t in ("region", "customer", "orders", "documents")
            ]
        ),
    ),
    "flat_events": (
        flat_events,
        'SELECT event_id, event_type AS "body.kind", CAST(json_extract(props, \'$.k\') AS BIGINT) AS "body.props.k" '
        "FROM events",
    ),
    "sampled_orders": (
        sampled_orders,
        "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders "
        "ORDER BY CAST('0x' || substr(md5('42' || chr(31) || o_orderkey), 1, 13) AS BIGINT) LIMIT 500",
    ),
    "lineitem_schema": (
        lineitem_schema,
        union_all(
            [
                f"SELECT {i} AS position, '{c}' AS \"column\", {_DTYPE.format(c=c)} AS dtype, {str(num).lower()} AS is_numeric, "
                f"{str(c == 'l_linestatus').lower()} AS is_target, count(*) AS total_rows, 11 AS total_cols FROM lineitem GROUP BY typeof({c})"
                for i, (c, num) in enumerate(_LINEITEM)
            ]
        ),
    ),
    "targets": (
        targets,
        "SELECT 'docs_labels' AS source, "
        + _first_with(DOCS_LABELS, ["doc_id", "lang", "source", "n_chars", "quality", "toxic"], "= 2")
        + " AS target UNION ALL SELECT 'embeddings', 'label' UNION ALL SELECT 'lineitem', "
        + _first_with("SELECT * FROM lineitem", [c for c, _ in _LINEITEM], "= 2")
        + " UNION ALL SELECT 'orders (older rule)', "
        + "(SELECT CASE WHEN count(DISTINCT o_orderkey) = 2 THEN 'o_orderkey' WHEN count(DISTINCT o_custkey) = 2 "
        "THEN 'o_custkey' WHEN count(DISTINCT o_orderstatus) BETWEEN 2 AND 10 THEN 'o_orderstatus' "
        "WHEN count(DISTINCT o_totalprice) = 2 THEN 'o_totalprice' WHEN count(DISTINCT o_orderdate) BETWEEN 2 AND 10 "
        "THEN 'o_orderdate' WHEN count(DISTINCT o_orderpriority) BETWEEN 2 AND 10 THEN 'o_orderpriority' END FROM orders)",
    ),
    "low_cardinality": (
        low_cardinality,
        "SELECT \"column\", CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS INTEGER) AS place, value FROM ("
        + union_all(
            [
                f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM ({_JOINED}) "
                f"WHERE (SELECT count(DISTINCT {c}) FROM ({_JOINED})) < 20"
                for c in ("o_orderstatus", "o_orderdate", "o_orderpriority", "c_name", "c_mktsegment")
            ]
        )
        + ")",
    ),
}
