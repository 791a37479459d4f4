"""Word lists, patterns and thresholds that define the results."""

from __future__ import annotations

# --- text treated as missing when types are inferred from text --------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- placeholder values reported as sentinels -------------------------------
SENTINELS = ["-999", "-9999", "999", "9999", "N/A", "null", "none", "NA", "?", "0000-00-00"]

# --- characters removed by a Unicode-aware strip -----------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- target detection ---------------------------------------------------------
TARGET_NAMES = ["target", "label", "class", "y"]
MISSING_FLAG_SUFFIX = "_was_missing"

# --- personal data ------------------------------------------------------------
EMAIL_PATTERN = r"(?U)^[\w\.-]+@[\w\.-]+\.\w+$"
PHONE_PATTERN = r"(?U)^\+?1?\d{9,15}$|^\d{3}[-\s]?\d{3}[-\s]?\d{4}$"
SSN_PATTERN = r"(?U)^\d{3}-\d{2}-\d{4}$|^\d{9}$"
IP_PATTERN = r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"

CARD_NAMES = ["card", "cc", "credit"]
EMAIL_NAMES = ["email"]
PHONE_NAMES = ["phone", "mobile", "tel"]
PERSON_NAMES = ["first_name", "last_name", "full_name", "customer_name", "user_name"]
BLANK_TOKENS = ["", "nan", "none", "null"]

CARD_TYPE = "Credit Card Number"
EMAIL_TYPE = "Email Address"
PHONE_TYPE = "Phone Number"
SSN_TYPE = "SSN / National Identification Number"
IP_TYPE = "IP Address"
PERSON_TYPE = "Full Name / Person Name"

RECOMMENDATIONS = {
    CARD_TYPE: "Mask or Hash prior to model training",
    EMAIL_TYPE: "Anonymize or Redact",
    PHONE_TYPE: "Mask or Redact",
    SSN_TYPE: "Hash or Remove",
    IP_TYPE: "Anonymize IP prefix",
    PERSON_TYPE: "Pseudonymize or Hash",
}

# --- test names -----------------------------------------------------------------
PEARSON = "Pearson Correlation"
SPEARMAN = "Spearman Correlation"
STUDENT_T = "Independent 2-Sample T-Test"
WELCH_T = "Welch's T-Test"
MANN_WHITNEY = "Mann-Whitney U Test"
CHI_SQUARE = "Chi-Square Test of Independence"
CHI_SQUARE_WARNING = "Chi-Square (Warning: Cochran Rule Violated)"
FISHER = "Fisher's Exact Test (Cochran Violation Fallback)"
SHAPIRO = "Shapiro-Wilk"
DAGOSTINO = "D'Agostino K^2"
FRANCIA = "Shapiro-Francia"
SAMPLE_CHECK = "Sample Check"

# --- claim gate -------------------------------------------------------------------
CAUSAL_PATTERN = r"(?i)(?U)\b(?:causes|caused|causation|drives|leads to|resulted in)\b"
EXAGGERATIONS = ["substantial", "critical", "severe", "high missingness"]
REASON_CAUSAL = "Banned Claim Rule: Inferred causation from correlation without experimental control."
REASON_SEVERITY = (
    "Severity Misclassification: %s%% missingness is low (<5%%) and cannot be claimed as substantial/critical."
)
REASON_SIGNIFICANCE = "Unsupported Significance: p_adj=%s >= 0.05 does not reach statistical significance threshold."
REASON_NORMALITY = "Unsupported Normality: Statistical test indicated departure from normal distribution."
REASON_DROP = (
    "Banned Recommendation: Dropping a feature solely due to high missingness without checking "
    "imputation/indicator options."
)
REASON_ANOMALY = (
    "Banned Anomaly Claim: Observations classified as anomalies without underlying statistical evidence."
)
REASON_NUMBER = "Numeric Mismatch: %s is %s in the text and %s in the evidence."
REASON_LABEL = "Label Mismatch: %s is '%s' in the text and '%s' in the evidence."
REASON_NO_EVIDENCE = "No Evidence: nothing is known of the subject of this claim."

# --- wording of claims; the names in braces are facts of the evidence ----------------
SENTENCES = {
    "missingness": "Column '{column}' has {missing_pct}% missing values ({null_count} rows), categorized as {severity} severity.",
    "duplicates": "Dataset contains {duplicate_rows} duplicate rows ({duplicate_pct}%), representing a {severity} uniqueness concern.",
    "constant_column": "Feature '{column}' is a zero-variance constant column with 1 unique value across all rows.",
    "quasi_constant": "Feature '{column}' is quasi-constant, with value '{value}' accounting for {top_pct}% of observations.",
    "pii": "Column '{column}' contains potential {type} PII with {confidence} confidence.",
    "quality_score": "Overall Data Quality Score is {overall_score}/100 with Grade {grade}.",
    "shape": "Numeric feature '{column}' exhibits mean={mean}, median={median}, skewness={skewness} ({severity}).",
    "normality": "Numeric feature '{column}' {verdict} normal distribution assumptions per {test} (p={p_value}).",
    "outliers": "Feature '{column}' contains {total_outliers} outliers ({outlier_pct}%), representing a {severity} outlier presence.",
    "simpsons": (
        "Simpson's Paradox detected between '{feature_x}' and '{feature_y}': overall correlation (r={overall_corr}) "
        "reverses direction when conditioned on subgroup '{group_var}'."
    ),
    "correlation": "Pairwise correlation between {pair} is statistically significant ({method}, r={corr}, FDR p_adj={p_adj}).",
    "group_test": (
        "Group difference test ({test}) on {variables} indicates a statistically significant difference (p_adj={p_adj}, "
        "effect size {effect}={effect_size})."
    ),
    "redundancy": "Features '{col1}' and '{col2}' exhibit high feature redundancy with correlation r={corr}.",
    "imbalance": (
        "Target variable exhibits a class distribution of {classes} with a minority/majority imbalance ratio of {ratio} "
        "({severity} imbalance)."
    ),
    "leakage": "Data leakage warning: Column '{column}' has near-perfect correlation (r={correlation}) with the target variable.",
}
VERDICT_NORMAL = "complies with"
VERDICT_NOT_NORMAL = "departs from"
