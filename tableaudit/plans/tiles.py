"""Pair moments of very wide tables as tiles of columns by columns.

Columns are cut into blocks of ``TILE``. Tasks add up cross products of their rows for a share of the tiles at a time, so
that a task's state stays below ``STATE_BYTES`` whatever the number of columns; a tile leaves a task as one packed row. Sums
of masked values are only held for columns that have gaps. Tiles are added up by their key, and correlations, thresholds and
maxima are worked out inside each tile: nothing of the size of all pairs is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
STATE_BYTES = 256_000_000
#: Tasks that send tiles; more input partitions are read by each when there are more of them.
SENDERS = 256
_PARTS = ("n", "x", "y", "xx", "yy", "xy", "spoiled x", "spoiled y")
_PACKED = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("sums", pa.binary())])
_PACKED_SQL = "a int, b int, sums binary"
_PAIR_SQL = "pair bigint, col1 string, col2 string, n_eff bigint, cov double, var1 double, var2 double, r double"
_BEST_SQL = "column string, max_r2 double"


def _shares(blocks: int, width: int) -> list[list[tuple[int, int]]]:
    """Tiles (a, b) with a <= b, in shares whose sums a task can hold."""
    room = max(1, STATE_BYTES // (len(_PARTS) * 8 * width * width))
    tiles = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    return [tiles[i : i + room] for i in range(0, len(tiles), room)]


def _sums(df: DataFrame, columns: Mapping[str, Column], width: int) -> DataFrame:
    """``(a, b, sums)``: for each tile the sums of products over rows where both columns are present, by task."""
    names = list(columns)
    flat = df.select(*[columns[c].alias(f"x{i}") for i, c in enumerate(names)])
    finite = [F.when(F.abs(f"x{i}") < float("inf"), F.col(f"x{i}")) for i in range(len(names))]
    means = flat.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(finite)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    blocks = -(-len(names) // width)
    parts = []
    for share in _shares(blocks, width):
        used = sorted({k for tile in share for k in tile})

        def run(batches: Iterator[pa.RecordBatch], share=share, used=used) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                values, at = {}, 0
                for k in used:
                    size = min(width, len(names) - k * width)
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[at : at + size]])
                    at += size
                    mask = ~np.isnan(x)
                    x = x - centre[k * width : k * width + size]
                    whole = mask.all()
                    # an infinite value is present: it counts, and leaves its pairs without a correlation
                    endless = np.isinf(x)
                    x[~mask | endless] = 0.0
                    values[k] = x, mask.astype(float), whole, endless.astype(float) if endless.any() else None
                for a, b in share:
                    (x, p, all_x, bad_x), (y, q, all_y, bad_y) = values[a], values[b]
                    if (a, b) not in total:
                        total[a, b] = np.zeros((len(_PARTS), x.shape[1], y.shape[1]))
                    t = total[a, b]
                    t[0] += len(x) if all_x and all_y else p.T @ q
                    t[1] += x.sum(axis=0)[:, None] if all_y else x.T @ q
                    t[2] += y.sum(axis=0)[None, :] if all_x else p.T @ y
                    t[3] += (x * x).sum(axis=0)[:, None] if all_y else (x * x).T @ q
                    t[4] += (y * y).sum(axis=0)[None, :] if all_x else p.T @ (y * y)
                    t[5] += x.T @ y
                    if bad_x is not None:
                        t[6] += bad_x.T @ q
                    if bad_y is not None:
                        t[7] += p.T @ bad_y
            for (a, b), t in total.items():
                yield pa.RecordBatch.from_pydict({"a": [a], "b": [b], "sums": [t.tobytes()]}, schema=_PACKED)

        mine = flat.select(*[f"x{i}" for k in used for i in range(k * width, min((k + 1) * width, len(names)))])
        parts.append(mine.coalesce(SENDERS).mapInArrow(run, _PACKED_SQL))
    return reduce(DataFrame.unionByName, parts)


def _tiles(df: DataFrame, columns: Mapping[str, Column], width: int, work, schema: str) -> DataFrame:
    """``work(names of rows, names of columns, first pair numbers, moments)`` for every whole tile, as pandas-free batches."""
    names = list(columns)
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> Iterator[pa.RecordBatch]:
            a, b = key
            rows, cols = names[a * width : (a + 1) * width], names[b * width : (b + 1) * width]
            n, x, y, xx, yy, xy, bad_x, bad_y = total.reshape(len(_PARTS), len(rows), len(cols))
            xx[bad_x > 0] = yy[bad_y > 0] = np.nan
            xy[(bad_x > 0) | (bad_y > 0)] = np.nan
            with np.errstate(all="ignore"):
                cov = xy / n - (x / n) * (y / n)
                var1, var2 = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
                var1[var1 <= xx / n * 1e-14] = 0.0  # a constant column leaves rounding dust
                var2[var2 <= yy / n * 1e-14] = 0.0
                r = cov / (np.sqrt(var1) * np.sqrt(var2))
            r[~np.isfinite(r)] = np.nan
            np.clip(r, -1.0, 1.0, out=r)
            i, j = np.indices(r.shape)
            i, j = i + a * width, j + b * width
            upper = i < j
            number = i * (2 * k - i - 1) // 2 + j - i - 1
            yield from work(np.array(names), i[upper], j[upper], number[upper], *(v[upper] for v in (n, cov, var1, var2, r)))

        for batch in batches:
            for a, b, sums in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sums"))):
                own = np.frombuffer(sums)
                if (a, b) != key:
                    if key is not None:
                        yield from done()
                    key, total = (a, b), own.copy()
                else:
                    total += own
        if key is not None:
            yield from done()

    dealt = _sums(df, columns, width).repartition("a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(run, schema)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~np.isfinite(values))


def tiled_pairs(df: DataFrame, columns: Mapping[str, Column], least: float | None = None, width: int = TILE) -> DataFrame:
    """``(pair, col1, col2, n_eff, cov, var1, var2, r)`` of all pairs, or of those with an absolute r of ``least`` or more."""

    def work(names, i, j, number, n, cov, var1, var2, r) -> Iterator[pa.RecordBatch]:
        keep = np.ones(len(r), bool) if least is None else np.abs(r) >= least
        for at in np.array_split(np.flatnonzero(keep), max(1, int(keep.sum()) // 50_000)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number[at], pa.int64()),
                    pa.array(names[i[at]], pa.string()),
                    pa.array(names[j[at]], pa.string()),
                    pa.array(n[at].astype(np.int64)),
                    *[_nullable(v[at]) for v in (cov, var1, var2, r)],
                ],
                names=["pair", "col1", "col2", "n_eff", "cov", "var1", "var2", "r"],
            )

    return _tiles(df, columns, width, work, _PAIR_SQL)


def tiled_best(df: DataFrame, columns: Mapping[str, Column], width: int = TILE) -> DataFrame:
    """``(column, max_r2)``: the largest squared correlation of each column; a tile sends one row per column."""

    def work(names, i, j, number, n, cov, var1, var2, r) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(names))
        squared = np.nan_to_num(r) ** 2
        for ends in (i, j):
            np.maximum.at(best, ends, squared)
        at = np.unique(np.concatenate([i, j]))
        yield pa.RecordBatch.from_pydict({"column": names[at].tolist(), "max_r2": best[at]})

    return _tiles(df, columns, width, work, _BEST_SQL).groupBy("column").agg(F.max("max_r2").alias("max_r2"))


def is_wide(columns: Sequence[str] | Mapping[str, Column]) -> bool:
    """Whether all pairs of the columns are too many for one task."""
    return len(columns) > TILE
