"""From documents to packed sequences: five operators of ``tableaudit.llm`` in a row.

Each stage works on all rows that the one before has kept. The first four return the columns of ``documents``:

1. toxicity: documents that the compression-distance score rejects go;
2. near_duplicates: one document of each group of linked SimHash fingerprints stays, the one with the smallest doc_id;
3. decontamination: documents in which a window of a benchmark item occurs go;
4. personal_data: personal data gives way to marks such as ``[EMAIL]``, and n_chars is counted anew;
5. packing: the documents that are left are cut and packed into sequences of 2048 ids.

Defined cases: a null text counts as empty and stays null until it is packed as an empty document; empty texts share
one fingerprint, so one of them stays; rows without a doc_id pass stage 2; extra columns pass stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableaudit.llm import op5_toxicity, op6_simhash, op7_winnowing, op8_pii, op9_best_fit
from tableaudit.llm.common import keep
from tableaudit.llm.tokens import default_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model fitted on the labelled ones."""
    model = op5_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op5_toxicity.keep_ordinary(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op6_simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return op7_winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with marks in place of personal data."""
    return op8_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents that are left."""
    return op9_best_fit.pack(docs, default_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Scores, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
