"""Missing-value policy, imputation, outlier report, winsorising and removal of duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, nan_to_null, numeric_columns, quoted, row_digest, value_of
from ..functions.constants import MISSING_FLAG_SUFFIX
from ..plans.aggregates import small_table
from ..plans.pairs import all_pairs, pair_moments
from ..plans.quantiles import counts_of, exact_quantiles
from .distribution import count_outliers, numeric_values, spread
from .imputing import apply_fill, fit_fill
from .quality import missing_values, row_counts


class Cleaned:
    """A cleaned table. What only describes it is computed when it is asked for.

    ``imputed`` is the table before duplicate rows are dropped, ``data`` after.
    """

    def __init__(self, imputed: DataFrame, filled: DataFrame, flags: Sequence[str], plan: Sequence[tuple], outliers: dict | None):
        self.imputed = imputed
        self._filled, self._flags, self._plan, self._outliers = filled, list(flags), list(plan), outliers

    @cached_property
    def data(self) -> DataFrame:
        if not any(isinstance(f.dataType, T.MapType) for f in self.imputed.schema.fields):
            return self.imputed.dropDuplicates()
        # maps have no equality of their own
        keyed = self.imputed.withColumn("__row", row_digest(self.imputed))
        return keyed.dropDuplicates(["__row"]).drop("__row")

    @cached_property
    def report(self) -> DataFrame:
        """One row per column."""
        found = self._outliers
        if found is None:
            found = _outlier_counts(self._filled, _audited(self._filled))
        rows = [(i, c, gaps, action, text, found.get(c), capped) for i, (c, gaps, action, text, capped) in enumerate(self._plan)]
        return small_table(
            self._filled.sparkSession,
            rows,
            "position int, column string, null_count bigint, action string, fill_value string, outliers bigint, "
            "winsorized boolean",
        )

    @cached_property
    def _mechanism(self) -> tuple[str, str]:
        return missing_mechanism(self._filled, self._flags)

    @property
    def mechanism(self) -> str:
        return self._mechanism[0]

    @property
    def notes(self) -> str:
        return self._mechanism[1]

    def duplicates_removed(self) -> DataFrame:
        """One row with the number of dropped rows."""
        copies = row_counts(self.imputed).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"))
        return copies


def _audited(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if not c.endswith(MISSING_FLAG_SUFFIX)]


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_was_missing`` with 0 or 1."""
    flags = {
        c + MISSING_FLAG_SUFFIX: (value_of(df, c) if is_numeric(df.schema[c].dataType) else quoted(c)).isNull().cast("int")
        for c in columns
    }
    return df.withColumns(flags) if flags else df


def missing_mechanism(df: DataFrame, flags: Sequence[str]) -> tuple[str, str]:
    """(mechanism, note) from the largest correlation between missing flags."""
    if not flags:
        return "none", "No missing indicators needed (0 missing values or >40% threshold)."
    if len(flags) == 1:
        return "MCAR/MAR", "Single missing indicator added -> MCAR/MAR baseline heuristic."
    pairs = pair_moments(df, {f: quoted(f).cast("double") for f in flags}, all_pairs(list(flags)))
    best = pairs.agg(F.max(F.abs("r"))).first()[0] or 0.0
    if best > 0.3:
        return (
            "MAR/MNAR",
            f"Missing indicators show correlation (max r={best:.2f}) -> Suggests MAR/MNAR mechanism.",
        )
    return "MCAR", "Missing indicators are largely uncorrelated -> Suggests MCAR mechanism heuristic."


def winsorize(
    df: DataFrame, columns: Sequence[str] | None = None, lo: float = 0.01, hi: float = 0.99
) -> DataFrame:
    """Clip columns to their exact ``lo`` and ``hi`` quantiles; missing values stay missing."""
    values = numeric_values(df, columns)
    limits = exact_quantiles(df, values, [lo, hi])
    return df.select(
        *[
            F.when(values[c].isNotNull(), F.least(F.greatest(values[c], F.lit(limits[c][lo])), F.lit(limits[c][hi]))).alias(c)
            if c in limits
            else quoted(c)
            for c in df.columns
        ]
    )


def clean(
    df: DataFrame, target: str | None = None, max_missing: float = 40.0, cap_outliers: bool = False
) -> Cleaned:
    """Flag and impute columns with up to ``max_missing`` percent gaps, report outliers, drop duplicate rows.

    Columns above the limit and the target are left as they are. Outliers are counted after imputation, the
    target included, and clipped to the 1st and 99th percentile only with ``cap_outliers``.
    """
    df = nan_to_null(df)
    gaps = {r["column"]: r for r in missing_values(df).collect()}

    def pct(c: str) -> float:
        return gaps[c]["null_count"] * 100.0 / max(gaps[c]["total_rows"], 1)

    high = [c for c in df.columns if c != target and pct(c) > max_missing]
    flagged = [c for c in df.columns if c != target and 0 < pct(c) <= max_missing]
    numeric = numeric_columns(df)
    fill = fit_fill(df, [c for c in flagged if c in numeric], [c for c in flagged if c not in numeric])
    imputed = apply_fill(missing_flags(df, flagged), fill)
    flags = [c + MISSING_FLAG_SUFFIX for c in flagged]
    found, capped, filled = None, [], imputed
    if cap_outliers:
        found = _outlier_counts(imputed, _audited(imputed))
        capped = [c for c in _audited(imputed) if c != target and found.get(c, 0) > 0]
        imputed = winsorize(imputed, capped) if capped else imputed
    plan = []
    for c in df.columns:
        if c == target:
            action = "target"
        elif c in high:
            action = "high_missing"
        elif c in flagged:
            action = "median" if c in numeric else "mode"
        else:
            action = "none"
        text = None if c not in fill else (f"{fill[c]:.2f}" if c in numeric else str(fill[c]))
        plan.append((c, gaps[c]["null_count"], action, text, c in capped))
    return Cleaned(imputed, filled, flags, plan, found)


def _outlier_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    values = numeric_values(df, columns)
    if not values:
        return {}
    counts = counts_of(df, values)
    if not any(counts.values()):
        return {c: 0 for c in columns}
    spreads = spread(df, values, counts)
    for c, s in spreads.items():
        if counts[c] < 3:
            s["mad"] = 0.0
    found = {r["column"]: r["total_outliers"] for r in count_outliers(df, values, spreads).collect()}
    return {c: found.get(c, 0) for c in columns}
