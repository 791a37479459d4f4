"""Fixed-size random samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.columns import quoted, text_of


_NESTED = (T.ArrayType, T.MapType, T.StructType)
HASH_RANGE = 2.0**52
SAMPLE_DIRECT_ROWS = 5_000_000


def row_hash(df: DataFrame, keys: Sequence[str] | None = None, seed: int = 42) -> Column:
    """Uniform 52-bit whole number per row as a double.

    With ``keys``, from the MD5 of the key texts and the seed, which other systems can reproduce. Without,
    from a faster hash of all columns.
    """
    if not keys:
        columns = [text_of(df, f.name) if isinstance(f.dataType, _NESTED) else quoted(f.name) for f in df.schema.fields]
        # missing values do not change the hash, so their places are hashed as well
        gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
        return F.pmod(F.xxhash64(F.lit(seed), gaps, *columns), F.lit(2**52)).cast("double")
    parts = [F.coalesce(quoted(k).cast("string"), F.lit("\u0000")) for k in keys]
    digest = F.md5(F.concat_ws("\u001f", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hash: the same rows on every run, however the data is partitioned.

    Planned as a top-n. Large tables are first cut at a hash that ``n`` rows are sure to stay under, so that
    many tasks do not each send ``n`` rows; a table of copies, where that fails, is not cut.
    """
    drawn = df.withColumn("__hash", row_hash(df, keys, seed))
    total = df.count()
    if total > SAMPLE_DIRECT_ROWS:
        near = drawn.where(F.col("__hash") < HASH_RANGE * min(1.0, (n + 10 * n**0.5 + 50) / total))
        if near.count() >= n:
            drawn = near
    return drawn.orderBy("__hash").limit(n).drop("__hash")
