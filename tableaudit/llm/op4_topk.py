"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are split by components into ``parts``; each part of a query against each part of the rows is a score list, and
the score is the sum over the parts. The lists are cut into blocks of rows that stay where they are, all parts of a row
in one block; queries, in blocks too, are dealt to all of them.

1. Every list block reports its ``k`` best partial scores for each query. The sums of what is known name ``k`` likely
   rows a query, whose scores are resolved; the k-th of them is a cutoff that no result lies below.
2. The cutoff goes to all list blocks with the queries. A row whose partial scores all lie below cutoff / parts cannot
   reach the cutoff, so the entries at or above that threshold are sufficient; each block collects them as bitmaps.
3. The remaining scores of rows with an entry are resolved exactly where both blocks lie, and the best ``k`` of each
   block that reach the cutoff are reported. No entry leaves its block otherwise.

Equal vectors: only the ``k`` + 1 smallest ids of a vector can be among any results, so the others leave the candidates
before the phases; queries with equal vectors are answered once. A vector held by a third of all rows so costs as much
as a few rows, with unchanged results.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without an id;
of rows with one id the smallest vector counts; shorter vectors are filled up with zeros; ties go to the smaller id; a
query with fewer than ``k`` other rows gets them all; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, record, table

PARTS = 2
ROWS_A_BLOCK = 2048
QUERIES_A_BLOCK = 1024
#: Groups of list blocks that every query block is dealt to; queries are copied so many times.
SLOTS = 256
#: Bytes of query blocks that are sent to all tasks; larger ones are copied to the slots.
SENT_BYTES = 32_000_000
_LOWEST = -(1 << 62)

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("data", pa.list_(pa.binary())), ("cuts", pa.binary())])
_BLOCK_SQL = "block bigint, ids binary, data array<binary>, cuts binary"
_SCORE = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
_ENTRY = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("score", pa.int64())])
_ENTRY_SQL = "query bigint, row bigint, part int, score bigint"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): one vector of whole numbers floor(scale * x) for each id that has a finite vector."""
    value = F.col(embedding).cast("array<double>")
    finite = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    whole = F.transform(value, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    return rows.select(F.col(vec_id).cast("bigint").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _blocks(rows: DataFrame, width: int, parts: int, size: int) -> DataFrame:
    """Rows (id, v, cut) packed into blocks of ``size`` rows, each cut into ``parts`` by components."""
    edges = [width * p // parts for p in range(parts + 1)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, data, cuts = [np.empty(0, "<i8")], [np.empty((0, width), "<i8")], [np.empty(0, "<i8")]
        held = 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, data, cuts, held
            own, grid, low = np.concatenate(ids), np.concatenate(data), np.concatenate(cuts)
            at = 0
            while len(own) - at >= size or last and at < len(own):
                stop = min(at + size, len(own))
                yield record(
                    _BLOCK,
                    block=[number],
                    ids=[own[at:stop].tobytes()],
                    data=[[grid[at:stop, a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]],
                    cuts=[low[at:stop].tobytes()],
                )
                number, at = number + 1, stop
            ids, data, cuts, held = [own[at:]], [grid[at:]], [low[at:]], len(own) - at

        for batch in batches:
            grid = np.zeros((batch.num_rows, width), "<i8")
            values = batch.column("v")
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False)
            grid[np.arange(width) < sizes[:, None]] = flat
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            cuts.append(batch.column("cut").to_numpy(zero_copy_only=False))
            data.append(grid)
            held += batch.num_rows
            if held >= size:
                yield from blocks(False)
        yield from blocks(True)

    return rows.select("id", "v", "cut").mapInArrow(pack, _BLOCK_SQL)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point while all sums are whole numbers it can hold."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _pairs(queries: DataFrame, rows: DataFrame, slots: int, size: int = SENT_BYTES + 1) -> DataFrame:
    """Every block of queries, of ``size`` bytes together, beside every list block.

    Spark takes the copies of query blocks to be as small as the file of the queries, and would send them all through the
    driver: up to SENT_BYTES the blocks themselves are sent, beyond that their copies are shuffled.
    """
    slot = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot")
    lists = rows.select(slot, "ids", "data")
    asked = [F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("cuts")]
    if size <= SENT_BYTES:
        return lists.repartition(slots, "slot").drop("slot").crossJoin(F.broadcast(queries.select(*asked)))
    dealt = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), *asked)
    return dealt.join(lists.hint("merge"), "slot").drop("slot")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Ids of both sides, partial scores by part, and cutoffs, of each pair of blocks."""
    for q_ids, q_data, cuts, ids, data in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_data", "cuts", "ids", "data"))):
        q, c = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
        grid = lambda x, n: np.frombuffer(x, "<i8").reshape(n, -1)
        scores = (_product(grid(a, len(q)), grid(b, len(c))) for a, b in zip(q_data, data))
        yield q, c, scores, np.frombuffer(cuts, "<i8")


def _best_lists(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: the ``k`` best entries of each list that a task has seen, for each query."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            query, row, part, score = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((row, -score, part, query))
            query, row, part, score = query[order], row[order], part[order], score[order]
            new = np.concatenate([[True], (query[1:] != query[:-1]) | (part[1:] != part[:-1])])
            place = np.arange(len(query)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            return tuple(x[place < k] for x in (query, row, part, score))

        for batch in batches:
            for q, c, lists, _ in _unpacked(batch):
                for part, scores in enumerate(lists):
                    top = np.argpartition(-scores, min(k, len(c)) - 1, axis=1)[:, :k]
                    at = np.arange(len(q))[:, None]
                    n = top.size
                    held.append((np.repeat(q, top.shape[1]), c[top].reshape(-1), np.full(n, part), scores[at, top].reshape(-1)))
            if held:
                held = [merged()]
        if held:
            yield record(_ENTRY, **dict(zip(("query", "row", "part", "score"), held[0])))

    return pairs.mapInArrow(best, _ENTRY_SQL)


def _reaching(pairs: DataFrame, parts: int, k: int) -> DataFrame:
    """Phases 2 and 3: the ``k`` best rows of each pair of blocks that reach the cutoff, for each query."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, c, lists, cuts in _unpacked(batch):
                lists = list(lists)
                least = -(-cuts // parts)[:, None]
                sufficient = lists[0] >= least  # which entries are at or above the threshold, in any list
                for scores in lists[1:]:
                    sufficient |= scores >= least
                a, b = np.nonzero(sufficient)
                total = sum(scores[a, b] for scores in lists)
                reach = total >= cuts[a]
                a, b, total = a[reach], b[reach], total[reach]
                order = np.lexsort((c[b], -total, a))
                a, b, total = a[order], b[order], total[order]
                new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
                place = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else a
                best = place < k
                if best.any():
                    yield record(_SCORE, query=q[a[best]], row=c[b[best]], score=total[best])

    return pairs.mapInArrow(resolve, "query bigint, row bigint, score bigint")


def _inner(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _resolved(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores of (query, row) pairs from the vectors, whose files are a small part of their size in memory."""
    q = queries.select(F.col("id").alias("query"), F.col("v").alias("qv"))
    c = rows.select(F.col("id").alias("row"), F.col("v").alias("cv"))
    return pairs.join(c.hint("merge"), "row").join(q.hint("merge"), "query").select("query", "row", _inner("qv", "cv").alias("score"))


def _first(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best rows of each query with their ``place``; ties go to the smaller id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, parts: int = PARTS, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of ``vectors`` (id, v) for each row with ``is_query``."""
    vectors = keep(vectors)
    same = Window.partitionBy("v").orderBy("id")
    rows = keep(vectors.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1).select("id", "v"))
    asked = vectors.filter(is_query).select("id", "v")
    asked = keep(asked.join(asked.groupBy("v").agg(F.min("id").alias("query")), "v"))
    queries = keep(asked.filter("id = query").select("id", "v"))
    width, count = vectors.agg(F.max(F.size("v"))).first()[0] or 1, queries.count()
    parts = max(1, min(parts, width))
    want = k + 1  # a query's own row is among the candidates

    lists = keep(_blocks(rows.withColumn("cut", F.lit(0).cast("bigint")), width, parts, rows_a_block))
    slots = max(1, min(SLOTS, lists.count()))

    def paired(cut: DataFrame) -> DataFrame:
        few = cut.repartition(max(1, -(-count // QUERIES_A_BLOCK)))
        return _pairs(_blocks(few, width, parts, QUERIES_A_BLOCK), lists, slots, 8 * count * (width + 2))

    # 1: likely rows and the cutoff
    known = _best_lists(paired(queries.withColumn("cut", F.lit(0).cast("bigint"))), want)
    known = known.groupBy("query", "row").agg(F.sum("score").alias("score"))
    likely = _resolved(_first(known, want).select("query", "row"), queries, rows)
    cuts = _first(likely, want).filter(F.col("place") == want).select(F.col("query").alias("id"), F.col("score").alias("cut"))
    cut = keep(queries.join(cuts, "id", "left").withColumn("cut", F.coalesce("cut", F.lit(_LOWEST).cast("bigint"))))

    # 2 and 3: sufficient entries, their remaining scores, and what reaches the cutoff
    answers = _first(_reaching(paired(cut), parts, want), want).drop("place")

    mine = asked.select("query", F.col("id").alias("asker")).join(answers, "query").filter("asker <> row")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "row")
    return (
        mine.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("asker").alias("query_id"), "rank", F.col("row").alias("vec_id"), "score")
    )


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


_SQL = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q "
    "FROM embeddings WHERE len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0), "
    "p AS (SELECT a.vec_id AS query_id, b.vec_id, "
    "CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t : t[1] * t[2])) AS BIGINT) AS score "
    "FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) "
    "SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p) WHERE n <= 5"
)

QUERIES = {"op4_exact_topk": (op4_exact_topk, _SQL)}
