"""Reading tables: delimited text, JSON, Parquet, ORC, JDBC, and datasets made of several parts."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, quoted, stripped
from ..functions.constants import NA_TOKENS
from ..plans.materialise import ensure_checkpoint_dir
from .splits import csv_records, json_records, parse_csv

_INTEGER = r"^[+-]?\d{1,19}$"
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity)$"
_TRUTH = r"^(True|False|TRUE|FALSE|true|false)$"

FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".txt": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl",
    ".parquet": "parquet", ".orc": "orc",
}


class EmptyDatasetError(ValueError):
    """A source without rows."""


# --- types ------------------------------------------------------------------------------------------------
def infer_types(df: DataFrame, na_tokens: Sequence[str] = tuple(NA_TOKENS)) -> DataFrame:
    """Text columns to bigint, double or boolean where every present value reads as one.

    One aggregate over the table decides all columns; missing-value tokens become NULL.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    value = {c: F.when(~quoted(c).isin(list(na_tokens)), quoted(c)) for c in texts}
    trimmed = {c: stripped(value[c]) for c in texts}
    whole = {c: F.when(trimmed[c].rlike(_INTEGER), trimmed[c].try_cast("bigint")) for c in texts}
    number = {c: F.when(trimmed[c].rlike(_NUMBER), trimmed[c].try_cast("double")) for c in texts}
    truth = {c: F.when(trimmed[c].rlike(_TRUTH), trimmed[c].try_cast("boolean")) for c in texts}
    row = df.agg(
        *[
            F.count(kind[c]).alias(f"{name}{i}")
            for i, c in enumerate(texts)
            for name, kind in (("p", value), ("w", whole), ("n", number), ("t", truth))
        ]
    ).first()
    out = {}
    for i, c in enumerate(texts):
        present = row[f"p{i}"]
        if present == 0:
            out[c] = F.lit(None).cast("double")  # a column without values counts as numeric
        elif row[f"w{i}"] == present:
            out[c] = whole[c]
        elif row[f"n{i}"] == present:
            out[c] = number[c]
        elif row[f"t{i}"] == present:
            out[c] = truth[c]
        else:
            out[c] = value[c]
    return df.select(*[out[c].alias(c) if c in out else quoted(c) for c in df.columns])


# --- formats ----------------------------------------------------------------------------------------------
def _has_rows(df: DataFrame, source: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyDatasetError(f"the dataset is empty: {source}")
    return df


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    multiline: bool | None = None,
    na_tokens: Sequence[str] = tuple(NA_TOKENS),
    infer: bool = True,
) -> DataFrame:
    """Delimited text with a header. Files whose bytes are not UTF-8 are read as Latin-1, each file by itself.

    ``multiline=None`` looks for quoted line breaks first (a line with an odd number of quotes). Files with such breaks are
    split like others: see ``splits.csv_records``.
    """
    lines = spark.read.text(path)  # bytes as they are
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not lines.where(quotes % 2 == 1).isEmpty()

    def load(paths: str | list[str], encoding: str) -> DataFrame:
        return spark.read.csv(paths, header=True, sep=sep, multiLine=multiline, quote='"', escape='"', encoding=encoding)

    files = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    found = files.collect()  # one row per file
    groups = [([r["file"] for r in found if r["valid"] == valid], name) for valid, name in ((False, "ISO-8859-1"), (True, "UTF-8"))]
    groups = [g for g in groups if g[0]]
    if not groups:
        return load(path, "UTF-8")
    if multiline:
        records, _ = csv_records(spark, path, sep)
        # the reader of whole files only looks at the first record here, for the names
        parts = [
            parse_csv(records.where(F.col("file").isin(names)) if len(groups) > 1 else records, load(names, encoding).columns, sep)
            for names, encoding in groups
        ]
    else:
        parts = [load(path if len(groups) == 1 else names, encoding) for names, encoding in groups]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return infer_types(df, na_tokens) if infer else df


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to columns with dotted names; arrays and maps to JSON text."""
    out: list[Column] = []

    def add(col: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                add(col.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(dtype, (T.ArrayType, T.MapType)):
            out.append(F.to_json(col).alias(name))
        else:
            out.append(col.alias(name))

    for f in df.schema.fields:
        add(quoted(f.name), f.dataType, f.name)
    return df.select(*out)


def read_json(
    spark: SparkSession, path: str, records_key: str | None = None, lines: bool = False
) -> DataFrame:
    """JSON documents (one value per file), or JSON lines with ``lines=True``.

    A root list yields its elements; a root object yields the records of ``records_key``, or of its first list-valued key in
    file order, chosen for each file, or itself where it has no list. Documents with lists are read by many tasks: their
    records are written to the checkpoint folder as lines once, see ``splits.json_records``.
    """
    if lines:
        return flatten(spark.read.json(path))
    records, single = json_records(spark, path, records_key)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/json-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"record": '), F.regexp_replace("text", r"[\r\n]+", " "), F.lit("}"))
    records.select(line.alias("value")).write.text(folder)
    parts = []
    df = spark.read.json(folder)
    if "record" in df.columns:
        parts.append(df.select("record.*") if isinstance(df.schema["record"].dataType, T.StructType) else df.select("record"))
    if single and records_key is None:
        parts.append(spark.read.json(single, multiLine=True))
    if not parts:
        return flatten(spark.read.json(path, multiLine=True).limit(0))
    return flatten(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def jdbc_options(
    table: str,
    database: str,
    host: str = "localhost",
    port: int | str = 3306,
    username: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Options of a MySQL table read; a numeric ``partition_column`` with ``bounds`` reads it in parallel.

    Without both, one task reads the whole table.
    """
    options = {"url": f"jdbc:mysql://{host}:{port}/{database}", "dbtable": table}
    if username is not None:
        options["user"] = username
    if password is not None:
        options["password"] = password
    if partition_column is not None and bounds is not None:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions or 64),
        }
    return options


def read_jdbc(spark: SparkSession, **config) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**config)).load()


def read_table(spark: SparkSession, path: str | None, fmt: str | None = None, **options) -> DataFrame:
    """A table by format, or by file extension when the format is unknown or not given."""
    kind = (fmt or "").lower()
    if kind == "mysql":
        return _has_rows(read_jdbc(spark, **options), options.get("table", "mysql"))
    if kind not in FORMATS.values():
        if not path:
            raise ValueError(f"Unsupported source type: {fmt}")
        dot = path.rstrip("/").rfind(".")
        kind = FORMATS.get(path.rstrip("/")[dot:].lower(), "csv") if dot >= 0 else "csv"
    readers = {
        "csv": lambda: read_csv(spark, path, **options),
        "tsv": lambda: read_csv(spark, path, sep="\t", **options),
        "json": lambda: read_json(spark, path, **options),
        "jsonl": lambda: read_json(spark, path, lines=True, **options),
        "parquet": lambda: spark.read.options(**options).parquet(path),
        "orc": lambda: spark.read.options(**options).orc(path),
    }
    return _has_rows(readers[kind](), path)


# --- several parts ------------------------------------------------------------------------------------------
def _cells(df: DataFrame) -> int:
    """Number of non-missing cells."""
    row = df.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return sum(row)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts with equal column names, a column with differing types widened to double or text."""
    names = parts[0].columns
    kinds = {c: {p.schema[c].dataType for p in parts} for c in names}

    def fitted(c: str) -> Column:
        if len(kinds[c]) == 1:
            return quoted(c)
        return quoted(c).cast("double" if all(is_numeric(t) for t in kinds[c]) else "string").alias(c)

    return reduce(DataFrame.unionByName, [p.select(*[fitted(c) for c in names]) for p in parts])


def resolve_parts(parts: Mapping[str, DataFrame], name: str | int | None = None) -> DataFrame:
    """One table out of the parts of a dataset.

    The named part, or the part at an index; the only part; the union of all non-empty parts when they have
    the same columns; else the part with the most non-missing cells (the first of a tie).
    """
    if not parts:
        raise ValueError("no parts")
    if isinstance(name, int):
        return _has_rows(list(parts.values())[name], str(name))
    if name is not None and name in parts:
        return _has_rows(parts[name], name)
    filled = [p for p in parts.values() if not p.isEmpty()]
    if not filled:
        raise EmptyDatasetError("all parts are empty")
    if len(filled) == 1:
        return filled[0]
    if all(set(p.columns) == set(filled[0].columns) for p in filled):
        return _union(filled)
    sizes = [_cells(p) for p in filled]
    return filled[sizes.index(max(sizes))]
