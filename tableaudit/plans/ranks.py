"""Rank correlations: average ranks from counts of values, and sums of their products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import inf, nextafter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .freq import number_counts
from .joins import EASY_ROWS, HOT_SHARE
from .materialise import materialise
from .prefix import ROWS_PER_BUCKET, average_ranks, bucket_limits, bucket_of

#: rank tables are broadcast, smallest first, while they hold this many distinct values together (about 60 MB)
BROADCAST_VALUES = 1_000_000
_SALTS = 64
#: rows that are ranked together where they are dealt out by buckets of a column
_ROWS_A_TASK = 250_000
#: sets of gaps that are ranked from the same scans
_SETS_A_PASS = 16


def hot_values(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, list[float]]:
    """Values that hold more than ``1 / HOT_SHARE`` of a column, and possibly a few more, from one sketch scan.

    Such a value spans at least four of the quantiles taken here, so it shows up as a repeated quantile. The
    list has ``4 * HOT_SHARE`` entries at most.
    """
    if not columns:
        return {}
    grid = [k / (4 * HOT_SHARE) for k in range(1, 4 * HOT_SHARE)]
    row = df.agg(*[F.percentile_approx(v, grid, 40 * HOT_SHARE) for v in columns.values()]).first()
    return {c: sorted({x for x, y in zip(q, q[1:]) if x == y}) if q else [] for c, q in zip(columns, row)}


def _salted_join(rows: DataFrame, starts: DataFrame, key: str, bucket: Column, hot: Sequence[float]) -> tuple[DataFrame, list[str]]:
    """Rows with the rows before and in the bucket of ``key``, dealt out by bucket; and the columns they are dealt out by.

    A hot value has a bucket of its own, so its rows need no others to be ranked and are spread by the rest of the row.
    """
    placed, keys = rows.withColumn("__bucket", bucket), ["__bucket"]
    if hot:
        others = [c for c in rows.columns if c != key] or [key]
        salt = F.when(F.col(key).isin(list(hot)), F.pmod(F.xxhash64(*others), F.lit(_SALTS))).otherwise(0)
        placed, keys = placed.withColumn("__salt", salt.cast("int")), ["__bucket", "__salt"]
    return placed.repartition(*keys).join(F.broadcast(starts), "__bucket"), keys


def _ranked(
    df: DataFrame,
    columns: Mapping[str, Column],
    n: int,
    small: set[str],
    rows_per_bucket: int,
    easy_rows: int,
) -> tuple[DataFrame, list[str]]:
    """The ``n`` rows, none with gaps, with one rank per column, doubled to be a whole number, and a weight.

    Ranks of ``small`` columns are sent to the rows. Then rows are dealt out by buckets of one other column after the
    other and ranked where they lie, so that they cross one shuffle a column; the first one also adds equal rows up.
    """
    names = list(columns)
    counts = dict.fromkeys(names, n)
    limits = bucket_limits(df, columns, counts, min(rows_per_bucket, _ROWS_A_TASK))
    large = [(i, c) for i, c in enumerate(names) if c not in small]
    hot = hot_values(df, {c: columns[c] for _, c in large}) if n > easy_rows else {}
    doubled = lambda rank, i: (2 * rank).cast("bigint").alias(f"k{i}")
    rows = df.select(*[columns[c].alias(f"x{i}") for i, c in enumerate(names)])
    for i, c in enumerate(names):
        if c in small:
            table = average_ranks(number_counts(df, {c: columns[c]}), {c: limits[c]} if c in limits else {})
            table = table.select(F.col("value").alias(f"x{i}"), doubled(F.col("rank"), i))
            rows = rows.join(F.broadcast(table), f"x{i}", "left").drop(f"x{i}")
    rows = rows.withColumn("w", F.lit(1).cast("bigint"))
    for step, (i, c) in enumerate(large):
        x, own = f"x{i}", [float(v) for v in hot.get(c, ())]
        edges = sorted({*limits.get(c, ()), *own, *(nextafter(v, -inf) for v in own)})
        bucket = lambda value: bucket_of(F.lit(c), value, {c: edges} if edges else {})  # noqa: B023, E731
        # a few buckets a hot value and MAX_BUCKETS others at most
        sizes = df.groupBy(bucket(columns[c]).alias("__bucket")).agg(F.count(F.lit(1)).alias("__size"))
        before = Window.partitionBy().orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("*", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
        rows, keys = _salted_join(rows, starts, x, bucket(F.col(x)), own)
        if not step:  # equal rows lie in one part
            rows = rows.groupBy(*[k for k in rows.columns if k != "w"]).agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy(*keys).orderBy(x))
        same = F.sum("w").over(Window.partitionBy(*keys, x))
        inside = upto - (same - 1) / 2.0
        if own:
            inside = F.when(F.col(x).isin(own), (F.col("__size") + 1) / 2.0).otherwise(inside)
        rest = [k for k in rows.columns if k != x and not k.startswith("__")]
        rows = rows.select(*rest, doubled(F.col("__before") + inside, i))
    return rows, names


def rank_correlations(
    df: DataFrame,
    columns: Mapping[str, Column],
    pairs: Sequence[tuple[str, str]],
    pair_counts: Mapping[tuple[str, str], int],
    counts: Mapping[str, int],
    distinct: Mapping[str, int],
    total: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    broadcast_values: int = BROADCAST_VALUES,
    easy_rows: int = EASY_ROWS,
) -> dict[tuple[str, str], float | None]:
    """Spearman's rho of each pair over its pair-complete rows; None without spread."""
    found = keyed_rank_correlations(
        df, F.lit(0), [0], columns, pairs, pair_counts, counts, distinct, total, rows_per_bucket, broadcast_values, easy_rows
    )
    return {pair: found.get((0, pair)) for pair in pairs}


def keyed_rank_correlations(
    df: DataFrame,
    key: Column,
    keys: Sequence[int],
    columns: Mapping[str, Column],
    pairs: Sequence[tuple[str, str]],
    pair_counts: Mapping[tuple[str, str], int],
    counts: Mapping[str, int],
    distinct: Mapping[str, int],
    total: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    broadcast_values: int = BROADCAST_VALUES,
    easy_rows: int = EASY_ROWS,
) -> dict[tuple[int, tuple[str, str]], float | None]:
    """Spearman's rho of each pair among the rows of each ``key``, a number in ``keys``; the counts are those of all rows.

    Ranks depend on the rows they are taken over. Pairs that are complete on the same rows, because their columns have
    no gaps or the same gaps, share a ranking: one per column and set of gaps, all of them from the same counts of values.
    Ranks of columns with few values are sent to the rows. A column with many values is counted by value, beside the sum
    of its partner's ranks at each value: running totals of the counts then give its own rank to the whole sum. Only
    where both columns of a pair have many values are rows shuffled, once for each such column; all pairs of these columns
    come from these rows.
    """
    gaps = _gap_classes(pairs, pair_counts, counts, total)
    groups: dict[frozenset, list[tuple[str, str]]] = {}
    for pair in pairs:
        groups.setdefault(frozenset(gaps[c] for c in pair if gaps[c] is not None), []).append(pair)
    small, room = set(), broadcast_values
    for c in sorted(gaps, key=lambda c: distinct[c]):
        size = min(distinct[c] * 1.5, counts[c])  # an estimate is within a few percent of the true number
        if size <= room:
            small.add(c)
            room -= size
    found: list[DataFrame] = []
    # columns with many values that have a pair with another one, and the pairs that come with them
    shuffled = {gap: {c for p in members if not small & {*p} for c in p} for gap, members in groups.items()}
    both = {gap: [p for p in members if shuffled[gap] & {*p}] for gap, members in groups.items()}
    others = {gap: [p for p in members if not shuffled[gap] & {*p}] for gap, members in groups.items()}
    alone = {c: columns[c] for members in others.values() for p in members for c in p if c not in small}
    limits = bucket_limits(df, alone, counts, rows_per_bucket)
    sets = [gap for gap in groups if others[gap]]
    for start in range(0, len(sets), _SETS_A_PASS):
        part = {g: others[g] for g in sets[start : start + _SETS_A_PASS]}
        found += _summed(df, key, columns, part, small, limits)
    for gap, members in both.items():
        if not members:
            continue
        part = df
        for c in sorted(gap):
            part = part.where(columns[c].isNotNull())
        used = {c: columns[c] for c in dict.fromkeys(c for p in members for c in p)}
        for k in keys:
            one = part.where(key == k) if len(keys) > 1 else part
            n = one.count() if len(keys) > 1 else pair_counts[members[0]]
            sums = _rank_sums(one, used, members, n, small, rows_per_bucket, easy_rows)
            at = {c: i for i, c in enumerate(used)}
            cells = [
                _cell(F.lit(k), a, b, F.col(f"p{i}"), F.col(f"s{at[a]}"), F.col(f"s{at[b]}")) for i, (a, b) in enumerate(members)
            ]
            found.append(sums.select(F.inline(F.array(*cells))))
    # one job: all parts run side by side
    rows = reduce(DataFrame.unionByName, found).groupBy("k", "a", "b").agg(*[F.sum(c).alias(c) for c in ("cross", "sa", "sb")])
    out: dict[tuple[int, tuple[str, str]], float | None] = {}
    for r in rows.collect():  # one row per key and pair
        # ranks of a column without spread are all zero once centred
        flat = not r["sa"] or not r["sb"] or r["cross"] is None
        out[r["k"], (r["a"], r["b"])] = None if flat else max(-1.0, min(1.0, r["cross"] / (r["sa"] * r["sb"]) ** 0.5))
    return out


def _cell(k: Column, a: str, b: str, cross: Column, sa: Column, sb: Column) -> Column:
    """A pair's sums; parts of them may come in several cells."""
    number = lambda x: x.cast("double")
    return F.struct(
        k.cast("int").alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"),
        number(cross).alias("cross"), number(sa).alias("sa"), number(sb).alias("sb"),
    )


def _summed(
    df: DataFrame,
    key: Column,
    columns: Mapping[str, Column],
    groups: Mapping[frozenset, list[tuple[str, str]]],
    small: set[str],
    limits: Mapping[str, Sequence[float]],
) -> list[DataFrame]:
    """``(k, a, b, cross, sa, sb)``, in parts, of the pairs of some sets of gaps with a column in ``small``."""
    none = F.lit(None)
    pairs = [(g, a, b) for g, members in enumerate(groups.values()) for a, b in members if a in small or b in small]
    if not pairs:
        return []
    names = list(dict.fromkeys(c for _, a, b in pairs for c in (a, b)))
    slot = {c: f"x{i}" for i, c in enumerate(names)}
    whole = [reduce(Column.__and__, [columns[c].isNotNull() for c in sorted(gap)], F.lit(True)) for gap in groups]
    flat = df.select(
        key.cast("int").alias("k"), *[columns[c].alias(slot[c]) for c in names], *[w.alias(f"w{g}") for g, w in enumerate(whole)]
    )
    sets = range(len(whole))
    numbers = [F.count_if(f"w{g}").alias(f"n{g}") for g in sets]
    few = [c for c in names if c in small]
    cells = [x for c in few for x in (F.lit(slot[c]), F.col(slot[c]))]
    long = flat.select("k", *[f"w{g}" for g in sets], F.stack(F.lit(len(few)), *cells).alias("column", "value"))
    table = long.where(F.col("value").isNotNull()).groupBy("k", "column", "value").agg(*numbers)
    own = Window.partitionBy("k", "column")
    before = own.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    middle = lambda g: _centred(F.coalesce(F.sum(f"n{g}").over(before), F.lit(0)), F.col(f"n{g}"), F.sum(f"n{g}").over(own))
    # BROADCAST_VALUES rows at most
    table = materialise(table.select("*", *[middle(g).alias(f"r{g}") for g in sets]))
    squares = table.groupBy("k", "column").agg(*[F.sum(F.col(f"n{g}") * F.col(f"r{g}") * F.col(f"r{g}")).alias(f"q{g}") for g in sets])

    def beside(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
        """Rows with the ranks of some columns, null where the value is missing."""
        for c in wanted:
            at = sorted({g for g, a, b in pairs if c in (a, b)})
            ranks = table.where(F.col("column") == slot[c]).select(
                F.col("k"), F.col("value").alias(slot[c]), *[F.col(f"r{g}").alias(f"{slot[c]}_r{g}") for g in at]
            )
            rows = rows.join(F.broadcast(ranks), ["k", slot[c]], "left")
        return rows

    rank = lambda c, g: F.col(f"{slot[c]}_r{g}")
    found = []
    # the squares of a column with few values, for every pair it is in
    parts = [
        F.when(F.col("column") == slot[c], _cell(F.col("k"), a, b, none, *((F.col(f"q{g}"), none) if c == a else (none, F.col(f"q{g}")))))
        for g, a, b in pairs
        for c in (a, b)
        if c in small
    ]
    found.append(squares.select(F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull()))))
    direct = [(g, a, b) for g, a, b in pairs if a in small and b in small]
    if direct:
        rows = beside(flat, list(dict.fromkeys(c for _, a, b in direct for c in (a, b))))
        sums = rows.groupBy("k").agg(*[F.sum(rank(a, g) * rank(b, g)).alias(f"p{i}") for i, (g, a, b) in enumerate(direct)])
        found.append(
            sums.select(F.inline(F.array(*[_cell(F.col("k"), a, b, F.col(f"p{i}"), none, none) for i, (_, a, b) in enumerate(direct)])))
        )
    for c in names:
        if c in small:
            continue
        mine = [(g, a, b, b if a == c else a) for g, a, b in pairs if c in (a, b)]
        used = sorted({g for g, *_ in mine})
        bucket = bucket_of(F.lit(c), F.col("value"), {c: limits[c]} if c in limits else {}).alias("bucket")
        others = list(dict.fromkeys(o for *_, o in mine))
        rows = flat.where(F.col(slot[c]).isNotNull()).withColumn("value", F.col(slot[c]))
        sizes = [F.count_if(f"w{g}").alias(f"n{g}") for g in used]
        counted = beside(rows, others).groupBy("k", "value").agg(
            *sizes, *[F.sum(rank(o, g)).alias(f"p{i}") for i, (g, _, _, o) in enumerate(mine)]
        )
        # MAX_BUCKETS rows a key at most
        blocks = rows.select("*", bucket).groupBy("k", "bucket").agg(*sizes)
        earlier = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = [F.sum(f"n{g}").over(Window.partitionBy("k")).alias(f"t{g}") for g in used]
        starts = blocks.select(
            "k", "bucket", *[F.coalesce(F.sum(f"n{g}").over(earlier), F.lit(0)).alias(f"o{g}") for g in used], *totals
        )
        joined = counted.select("*", bucket).join(F.broadcast(starts), ["k", "bucket"])
        inside = Window.partitionBy("k", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        under = lambda g: F.col(f"o{g}") + F.coalesce(F.sum(f"n{g}").over(inside), F.lit(0))
        ranked = joined.select("*", *[_centred(under(g), F.col(f"n{g}"), F.col(f"t{g}")).alias(f"r{g}") for g in used])
        sums = ranked.groupBy("k").agg(
            *[F.sum(F.col(f"n{g}") * F.col(f"r{g}") * F.col(f"r{g}")).alias(f"q{g}") for g in used],
            *[F.sum(F.col(f"p{i}") * F.col(f"r{g}")).alias(f"c{i}") for i, (g, *_) in enumerate(mine)],
        )
        parts = [
            _cell(F.col("k"), a, b, F.col(f"c{i}"), *((F.col(f"q{g}"), none) if a == c else (none, F.col(f"q{g}"))))
            for i, (g, a, b, _) in enumerate(mine)
        ]
        found.append(sums.select(F.inline(F.array(*parts))))
    return found


def _centred(before: Column, n: Column, total: Column) -> Column:
    """The mean rank of ``n`` rows after ``before`` others, less the mean of all ranks, as a share of all rows."""
    return (before + (n + 1) / 2.0 - (total + 1) / 2.0) / F.greatest(total, F.lit(1)).cast("double")


def _gap_classes(pairs, pair_counts, counts, total) -> dict[str, str | None]:
    """For each column the first column with the same missing rows, None if nothing is missing."""
    out: dict[str, str | None] = {}
    for c in dict.fromkeys(c for p in pairs for c in p):
        if counts[c] == total:
            out[c] = None
            continue
        same = [
            d
            for d in out
            if out[d] == d and counts[d] == counts[c] == pair_counts.get((d, c), pair_counts.get((c, d), -1))
        ]
        out[c] = same[0] if same else c
    return out


def _rank_sums(df, columns, pairs, n, small, rows_per_bucket, easy_rows) -> DataFrame:
    """One row: the sum of squared centred ranks of each column, then the cross sums of each pair."""
    rows, names = _ranked(df, columns, n, small, rows_per_bucket, easy_rows)
    at = {c: i for i, c in enumerate(names)}
    centred = lambda k: (k - (n + 1)) / (2.0 * max(n, 1))
    rows = rows.select("w", *[centred(F.col(f"k{i}")).alias(f"r{i}") for i in range(len(names))])
    w = F.col("w")
    return rows.agg(
        *[F.sum(w * F.col(f"r{i}") * F.col(f"r{i}")).alias(f"s{i}") for i in range(len(names))],
        *[F.sum(w * F.col(f"r{at[a]}") * F.col(f"r{at[b]}")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)],
    )
