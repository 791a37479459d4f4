"""Audit and explore any table with Spark: a DataFrame in, small evidence DataFrames out."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .audit import Audit, audit  # noqa: E402
from .operators.charts import (  # noqa: E402
    box_stats,
    chart_tables,
    corr_heatmap,
    frequency,
    histogram,
    missing_matrix,
    top_pair,
    top_pair_scatter,
    trend,
)
from .operators.claims import gate, gate_claims, gate_counts, number_claims  # noqa: E402
from .operators.cleaning import clean, missing_flags, missing_mechanism, winsorize  # noqa: E402
from .operators.distribution import (  # noqa: E402
    categorical_profile,
    normality,
    numeric_profile,
    outliers,
)
from .operators.drift import chronological, drift_ks, rolling_mean_last, temporal_report  # noqa: E402
from .operators.features import date_parts, detect_datetime, engineer, interactions, log_skewed  # noqa: E402
from .operators.pii import detect_pii, mask_pii  # noqa: E402
from .operators.quality import (  # noqa: E402
    category_variants,
    column_quality,
    duplicates,
    missing_values,
    sentinel_values,
    table_quality,
)
from .operators.relations import (  # noqa: E402
    association_tests,
    bh_adjust,
    contingency_table,
    contingency_tests,
    correlations,
    group_tests,
    pearson_matrix,
    rank_insights,
    redundant_pairs,
    simpsons,
    vif_scores,
)
from .operators.target import (  # noqa: E402
    apply_imputer,
    class_balance,
    class_distribution,
    detect_target,
    fit_imputer,
    leakage,
    ml_prepare,
    ml_readiness,
    schema_evidence,
    split,
)
from .sources.readers import infer_types, read_table, resolve_parts  # noqa: E402
from .sources.sampling import sample_rows  # noqa: E402
from .plans.materialise import materialise  # noqa: E402
from .sources.sinks import write_run  # noqa: E402
