"""Target detection, class balance, leakage, exact split and train-fitted imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity
from ..functions.columns import is_numeric, key_of, numeric_columns, other_columns, quoted, text_of, value_of
from ..functions.constants import TARGET_NAMES
from ..plans.aggregates import small_table
from ..plans.codes import value_codes
from ..plans.freq import few_valued, most_frequent, value_counts
from ..plans.joins import lookup_join
from ..plans.pairs import pair_moments
from ..plans.quantiles import order_positions
from ..sources.sampling import HASH_RANGE, row_hash
from .imputing import apply_fill, fit_fill
from .relations import redundant_pairs, vif_scores
from .segments import class_balance_by, class_distribution_by


def detect_target(df: DataFrame) -> str | None:
    """The first column with a target name, else the first column with exactly two distinct values."""
    for c in df.columns:
        if c.lower() in TARGET_NAMES:
            return c
    maybe = few_valued(df, df.columns, 3)
    if not maybe:
        return None
    found = most_frequent(value_counts(df, maybe)).where("nunique = 2").select("column").collect()
    two = {r["column"] for r in found}
    return next((c for c in maybe if c in two), None)


def detect_target_or_classes(df: DataFrame, most: int = 10) -> str | None:
    """Older rule: the first column with two distinct values, or a text column with 3 to ``most``."""
    maybe = few_valued(df, df.columns, most + 1)
    if not maybe:
        return None
    sizes = {r["column"]: r["nunique"] for r in most_frequent(value_counts(df, maybe)).collect()}
    other = other_columns(df)
    return next(
        (c for c in maybe if sizes.get(c) == 2 or (c in other and 2 < sizes.get(c, 0) <= most)), None
    )


def schema_evidence(df: DataFrame, target: str | None = None) -> DataFrame:
    """``(position, column, dtype, is_numeric, is_target, total_rows, total_cols)``, one row per column."""
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(is_numeric(f.dataType)).alias("is_numeric"),
                F.lit(f.name == target).alias("is_target"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return counted.select(F.inline(items), "total_rows", F.lit(len(df.columns)).alias("total_cols"))


def class_distribution(df: DataFrame, target: str, by: Sequence[str] | None = None) -> DataFrame:
    """``(class, n)`` without missing values; with ``by``, of every segment."""
    if by:
        return class_distribution_by(df, target, by)
    return value_counts(df, [target], whole=True).select(F.col("value").alias("class"), "n")


def class_balance(df: DataFrame, target: str, by: Sequence[str] | None = None) -> DataFrame:
    """One row: number of classes, smallest and largest class, their ratio and its severity; one a segment with ``by``."""
    if by:
        return class_balance_by(df, target, by)
    sized = class_distribution(df, target).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("min_count"), F.max("n").alias("max_count")
    )
    return balanced(sized)


def balanced(sized: DataFrame) -> DataFrame:
    """Ratio and severity from the number of classes and the sizes of the smallest and the largest one."""
    ratio = F.when(F.col("classes") > 1, F.round(F.col("min_count") / F.col("max_count"), 4))
    return sized.withColumn("imbalance_ratio", ratio).withColumn(
        "imbalance_severity", F.coalesce(severity.imbalance_severity(F.col("imbalance_ratio")), F.lit("balanced"))
    )


def target_codes(
    df: DataFrame, target: str, name: str = "target_code", small: int = 100_000, order_col: str | None = None
) -> DataFrame:
    """``df`` with the target as a number: itself if numeric, else 0, 1, ... by ascending value, missing -1.

    With ``order_col`` the codes follow the first appearance of the values in that row order. Codes are joined by
    bounded keys, so that few but long texts are not broadcast.
    """
    if is_numeric(df.schema[target].dataType):
        return df.withColumn(name, value_of(df, target))
    codes, broadcast = value_codes(df, text_of(df, target), small, quoted(order_col) if order_col else None)
    codes = codes.select(key_of(F.col("value")).alias("__value"), "n", F.col("code").cast("double").alias(name))
    rows = df.withColumn("__value", F.coalesce(key_of(text_of(df, target)), F.lit("")))
    is_missing = text_of(df, target).isNull()
    if broadcast:
        joined = rows.join(F.broadcast(codes.drop("n")), "__value", "left")
    else:
        joined = lookup_join(rows, codes, ["__value"], df.count())
    return joined.withColumn(name, F.when(is_missing, -1.0).otherwise(F.col(name))).drop("__value")


def leakage(df: DataFrame, target: str, limit: float = 0.95, order_col: str | None = None) -> DataFrame:
    """``(position, column, correlation)`` for numeric columns that nearly repeat the target.

    ``order_col`` gives the row order in which a text target's values are numbered.
    """
    names = numeric_columns(df, exclude=[target])
    if not names:
        return small_table(df.sparkSession, [], "position int, column string, correlation double")
    order = [quoted(order_col).alias("__order")] if order_col else []
    slim = df.select(*[quoted(c) for c in names], quoted(target), *order)
    coded = target_codes(slim, target, "__target", order_col="__order" if order_col else None)
    values = {c: value_of(slim, c) for c in names} | {"__target": F.col("__target")}
    found = pair_moments(coded, values, [(c, "__target") for c in names])
    size = F.abs("r")
    return found.where(size > limit).select(F.col("pair").alias("position"), F.col("col1").alias("column"), F.round(size, 4).alias("correlation"))


def ml_readiness(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """Supervised checks when there is a target, redundancy checks otherwise."""
    if target:
        return {
            "class_distribution": class_distribution(df, target),
            "class_balance": class_balance(df, target),
            "leakage": leakage(df, target),
        }
    return {"redundant": redundant_pairs(df), "vif": vif_scores(df)}


# --- exact split ------------------------------------------------------------------------------------------
#: rows of so few different hashes are counted by them
FEW_HASHES = 1_000_000


@dataclass
class Split:
    status: str
    train: DataFrame | None = None
    test: DataFrame | None = None


def split(
    df: DataFrame, frac: float = 0.8, seed: int = 42, keys: Sequence[str] | None = None, min_rows: int = 10
) -> Split:
    """Random split with exactly ``floor(frac * n)`` training rows, without sorting or shuffling the table.

    Rows are ordered by a seeded hash of ``keys`` (default: all columns) and cut at an exact order statistic.
    Rows that share the hash at the cut are ordered by a hash of the whole row; equal rows are counted and
    dealt out by number.
    """
    n, different = _sized(df, keys)
    if n < min_rows:
        return Split("SKIPPED")
    hashes = [(row_hash(df, keys, seed), keys), (row_hash(df, None, seed + 1), None)] if keys else [(row_hash(df, None, seed), None)]
    train, test = _cut(df, int(n * frac), n, different, hashes)
    return Split("COMPLETED", train, test)


def _sized(df: DataFrame, keys: Sequence[str] | None) -> tuple[int, int]:
    """(rows, about how many combinations of ``keys``, by default of all columns)."""
    names = list(keys or df.columns)
    if any(isinstance(df.select(quoted(c)).schema[0].dataType, (T.ArrayType, T.MapType, T.StructType)) for c in names):
        n = df.count()
        return n, n
    # missing values do not change the hash, so their places are hashed as well
    combination = F.xxhash64(*[quoted(c) for c in names], *[quoted(c).isNull() for c in names])
    return tuple(df.agg(F.count(F.lit(1)), F.approx_count_distinct(combination)).first())


def _cut(df: DataFrame, take: int, n: int, different: int, hashes: list) -> tuple[DataFrame, DataFrame]:
    """First ``take`` of ``n`` rows in the order of the hashes, and the rest; the first hash has about ``different`` values."""
    if take <= 0:
        return df.limit(0), df
    if take >= n:
        return df, df.limit(0)
    if not hashes:
        return _deal(df, take)
    h, keys = hashes[0]
    if different <= min(FEW_HASHES, n // 8):
        limit, below, ties = _place_of_few(df, h, keys, take - 1)
    else:
        # the hash is uniform, so the cut is close to its share of the range unless many rows are copies
        spot, slack = take / n, 6.0 * (take / n * (1 - take / n) / n) ** 0.5
        guess = {"h": ((spot - slack) * HASH_RANGE, (spot + slack) * HASH_RANGE)}
        place = order_positions(df, {"h": h}, {"h": [take - 1]}, {"h": n}, guesses=guess)
        limit, below, ties = place[("h", take - 1)]
    if below + ties == take:
        return df.where(h <= limit), df.where(h > limit)
    tied = df.where(h == limit) if ties < n else df
    head, tail = _cut(tied, take - below, ties, _sized(tied, None)[1] if hashes[1:] else 0, hashes[1:])
    if ties == n:
        return head, tail
    return df.where(h < limit).unionByName(head), df.where(h > limit).unionByName(tail)


def _place_of_few(df: DataFrame, h: Column, keys: Sequence[str] | None, rank: int) -> tuple[float, int, int]:
    """(hash, rows below it, rows with it) at a zero-based rank, of rows that are mostly copies of few combinations of keys.

    Rows are counted before they are hashed: one scan, and a hash for each combination.
    """
    counted = df.groupBy(*[quoted(c) for c in keys or df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.select(h.alias("__h"), "__n").groupBy("__h").agg(F.sum("__n").alias("__n"))
    # FEW_HASHES rows at most, within the error of an estimate
    before = Window.partitionBy().orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.max(F.struct("__h", "__below", "__n"))
    return tuple(placed.where(F.col("__below") <= rank).agg(place).first()[0])


def _deal(df: DataFrame, take: int) -> tuple[DataFrame, DataFrame]:
    """Split rows with one common hash: distinct rows (nearly always one) with counts, dealt in order."""
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*[quoted(c) for c in df.columns]).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(take) - F.coalesce(F.sum("__n").over(before), F.lit(0))
    dealt = counted.withColumn("__first", F.least(F.col("__n"), F.greatest(room, F.lit(0))))
    head = _repeat(dealt, F.col("__first"), df.columns)
    return head, _repeat(dealt, F.col("__n") - F.col("__first"), df.columns)


def _repeat(df: DataFrame, times, columns: Sequence[str], block: int = 100_000) -> DataFrame:
    """Every row ``times`` times, in blocks so that no array grows with the count."""
    blocks = df.withColumn("__t", times).where(F.col("__t") > 0)
    blocks = blocks.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__t") - 1) / block))))
    size = F.least(F.lit(block), F.col("__t") - F.col("__b") * block).cast("int")
    return blocks.withColumn("__i", F.explode(F.sequence(F.lit(1), size))).select(*[quoted(c) for c in columns])


# --- imputation fitted on train ---------------------------------------------------------------------------
def fit_imputer(train: DataFrame, target: str | None = None) -> dict[str, object]:
    """Train median of numeric and train mode of other columns; target and missing flags are left out."""
    skip = [target] if target else []
    numeric = numeric_columns(train, exclude=skip, flags=False)
    return fit_fill(train, numeric, other_columns(train, exclude=skip))


def apply_imputer(df: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    return apply_fill(df, fill)


def ml_prepare(
    df: DataFrame, target: str | None = None, frac: float = 0.8, seed: int = 42, keys: Sequence[str] | None = None
) -> Split:
    """Split, then fill both parts with values fitted on the training part only."""
    parts = split(df, frac, seed, keys)
    if parts.status != "COMPLETED":
        return parts
    fill = fit_imputer(parts.train, target)
    return Split(parts.status, apply_imputer(parts.train, fill), apply_imputer(parts.test, fill))
