"""All evidence of one table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from .operators import claims as C
from .operators.distribution import categorical_profile, numeric_profile
from .operators.facts import Facts
from .operators.pii import detect_pii
from .operators.quality import category_variants, column_quality, sentinel_values, table_quality
from .operators.relations import correlations, group_tests, redundant_pairs, simpsons, vif_scores
from .operators.target import class_balance, class_distribution, detect_target, leakage, schema_evidence


class Audit:
    """Evidence tables of ``df``; each is planned when first asked for, and holds one row per finding."""

    def __init__(self, df: DataFrame, target: str | None = None, order_col: str | None = None):
        self.df = df
        self.target = target if target is not None else detect_target(df)
        self.order_col = order_col
        self.facts = Facts(df, order_col=order_col)

    @cached_property
    def schema(self) -> DataFrame:
        return schema_evidence(self.df, self.target)

    @cached_property
    def column_quality(self) -> DataFrame:
        return column_quality(self.df)

    @cached_property
    def table_quality(self) -> DataFrame:
        return table_quality(self.df)

    @cached_property
    def sentinels(self) -> DataFrame:
        return sentinel_values(self.df)

    @cached_property
    def variants(self) -> DataFrame:
        return category_variants(self.df)

    @cached_property
    def pii(self) -> DataFrame:
        return detect_pii(self.df)

    @cached_property
    def numeric_dist(self) -> DataFrame:
        return numeric_profile(self.df, facts=self.facts)

    @cached_property
    def categorical_dist(self) -> DataFrame:
        return categorical_profile(self.df)

    @cached_property
    def correlations(self) -> DataFrame:
        return correlations(self.df, facts=self.facts)

    @cached_property
    def group_tests(self) -> DataFrame:
        return group_tests(self.df, order_col=self.order_col, facts=self.facts)

    @cached_property
    def simpsons(self) -> DataFrame:
        return simpsons(self.df, facts=self.facts)

    @cached_property
    def redundant(self) -> DataFrame:
        return redundant_pairs(self.df, facts=self.facts)

    @cached_property
    def vif(self) -> DataFrame:
        return vif_scores(self.df, facts=self.facts)

    @cached_property
    def class_distribution(self) -> DataFrame | None:
        return class_distribution(self.df, self.target) if self.target else None

    @cached_property
    def class_balance(self) -> DataFrame | None:
        return class_balance(self.df, self.target) if self.target else None

    @cached_property
    def leakage(self) -> DataFrame | None:
        return leakage(self.df, self.target, order_col=self.order_col) if self.target else None

    def tables(self) -> dict[str, DataFrame]:
        """Every evidence table by name."""
        names = [n for n, v in vars(type(self)).items() if isinstance(v, cached_property)]
        found = {n: getattr(self, n) for n in names}
        return {n: t for n, t in found.items() if t is not None}

    def claims(self) -> DataFrame:
        """Numbered text claims projected from the evidence."""
        parts = [
            C.missing_claims(self.column_quality),
            C.duplicate_claims(self.table_quality),
            C.constant_claims(self.column_quality),
            C.quasi_constant_claims(self.column_quality),
            C.pii_claims(self.pii),
            C.score_claims(self.table_quality),
            C.distribution_claims(self.numeric_dist),
            C.simpson_claims(self.simpsons),
            C.correlation_claims(self.correlations),
            C.group_test_claims(self.group_tests),
            C.redundancy_claims(self.redundant),
        ]
        if self.target:
            parts += [C.balance_claims(self.class_distribution, self.class_balance), C.leakage_claims(self.leakage)]
        return C.number_claims(*parts)


def audit(df: DataFrame, target: str | None = None, order_col: str | None = None) -> Audit:
    """Evidence tables and claims for any table."""
    return Audit(df, target, order_col)
