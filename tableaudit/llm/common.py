"""Small helpers of this subpackage: scratch tables, text batches, word hashes."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.materialise import ensure_checkpoint_dir

#: Text handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def keep(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = folder or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state() -> dict:
    """What a Python worker keeps from task to task. The package travels with each job, so its own modules do not last."""
    return sys.modules.setdefault("_tableaudit_worker_state", types.ModuleType("_tableaudit_worker_state")).__dict__


def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches with a ``text`` column into runs of rows of about ``size`` bytes of text.

    After the last one the worker, which lives on for later stages, gives free memory back.
    """
    for batch in batches:
        start, total = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (the finalizer of splitmix64) on an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return mix(out)
