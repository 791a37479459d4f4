"""SimHash near duplicates by covering locality-sensitive hashing.

A document's fingerprint holds, for each of 64 bits, whether most of its shingle hashes have the bit set. To find all
pairs of fingerprints within a radius, every bit position gets ``replicas`` random vectors over the field of two
elements, of replicas * radius + 1 components; each non-zero vector v of that size is one table, whose mask drops the
positions all of whose vectors are orthogonal to v. The vectors of any ``radius`` positions leave some v orthogonal to
all of them, so that table's mask drops every position in which a pair differs: the pair shares a key there, always.

Fingerprints are made distinct first, so copies cost one row. Fingerprints with one key are compared where they meet in
a sorted partition: small groups pair by pair, large ones by flipping the bits that the mask drops, and each group
gives a spanning set of links, never all its pairs. The links' components are found by distributed rounds.

Defined cases: a null text or one without words has fingerprint zero and is linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows stay, each with its class; null doc_ids count for no component's
smallest id, and a component of such documents alone has a null id; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from .common import keep, record, table, text_slices
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: 2 gives 31 masks of about 48 bits for a radius of 2; 1 gives 7 masks of about 32 bits, for few documents.
REPLICAS = 2
_PAIRWISE = 512
_HASHES_AT_ONCE = 1 << 16

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYS = pa.schema([("tab", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# --- fingerprints --------------------------------------------------------------------------------------------
def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``k`` words, lower-cased in A-Z and joined by spaces; fewer words are one run."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    parts = map(joined.__getitem__, map(slice, starts, ends[k - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bits set in more than half the hashes, as a signed number."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[i : i + _HASHES_AT_ONCE].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64 bits as a signed number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [simhash(shingle_hashes(t, k)) for t in batch.column("text").to_pylist()]
            yield record(_FP, doc_id=batch.column("doc_id"), fp=found)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(compute, "doc_id bigint, fp bigint")


# --- links ---------------------------------------------------------------------------------------------------
def covering_masks(radius: int, replicas: int = REPLICAS, bits: int = 64, seed: int = 7) -> list[int]:
    """Masks of kept bits such that any ``radius`` positions are dropped together by some mask."""
    size = replicas * radius + 1
    draw = random.Random(seed)
    vectors = [[draw.randrange(1 << size) for _ in range(replicas)] for _ in range(bits)]
    return [
        sum(1 << i for i, own in enumerate(vectors) if any((m & v).bit_count() % 2 for m in own))
        for v in range(1, 1 << size)
    ]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` vertices' components under the links (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def group_links(fps: np.ndarray, free: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links between distinct fingerprints that agree outside the bits of ``free``."""
    n = len(fps)
    if n <= _PAIRWISE:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(np.triu(near, 1))
    else:
        fps = np.sort(fps)
        flips = [0]
        for _ in range(radius):
            flips = list({f ^ (1 << i) for f in flips for i in range(64) if free >> i & 1} | set(flips))
        left, right = [], []
        for flip in flips:
            if flip:
                want = fps ^ np.uint64(flip)
                at = np.minimum(np.searchsorted(fps, want), n - 1)
                hit = np.flatnonzero((fps[at] == want) & (want > fps))
                left.append(hit)
                right.append(at[hit])
        a, b = np.concatenate(left), np.concatenate(right)
    root = _roots(n, a, b)
    member = np.flatnonzero(root != np.arange(n))
    return fps[member], fps[root[member]]


def close_links(distinct: DataFrame, radius: int = RADIUS, replicas: int = REPLICAS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs in column ``fp`` at ``radius`` or fewer bits.

    ``fp`` must hold each fingerprint once.
    """
    masks = covering_masks(radius, replicas)
    kept = np.array(masks, np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            yield record(
                _KEYS,
                tab=np.repeat(np.arange(len(kept), dtype=np.int32), len(fps)),
                key=(fps[None, :] & kept[:, None]).reshape(-1).view(np.int64),
                fp=np.tile(fps, len(kept)).view(np.int64),
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of one (tab, key) stand together; the last group of a batch may go on in the next."""
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def close(tab: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1
            start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(tab)]])
            size = stop - start
            found = []
            two = start[size == 2]
            x, y = fp[two], fp[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            found.append((x[near], y[near]))
            for i in np.flatnonzero(size > 2).tolist():
                free = ~masks[int(tab[start[i]])] & (1 << 64) - 1
                a, b = group_links(fp[start[i] : stop[i]].view(np.uint64), free, radius)
                found.append((a.view(np.int64), b.view(np.int64)))
            yield record(_LINKS, a=np.concatenate([f[0] for f in found]), b=np.concatenate([f[1] for f in found]))

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "key", "fp")]
            tab, key, fp = (np.concatenate([h, x]) for h, x in zip(held, new))
            last = int(np.flatnonzero((tab != tab[-1]) | (key != key[-1]))[-1]) + 1 if len(tab) and (tab[0] != tab[-1] or key[0] != key[-1]) else 0
            if last:
                yield from close(tab[:last], key[:last], fp[:last])
            held = [tab[last:], key[last:], fp[last:]]
        if len(held[0]):
            yield from close(*held)

    keyed = distinct.select("fp").mapInArrow(keys, "tab int, key bigint, fp bigint")
    met = keyed.repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(meet, "a bigint, b bigint")
    return met.distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, replicas: int = REPLICAS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id
    reachable over links.
    """
    prints = keep(fingerprints(docs, k))
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reached = components(close_links(classes, radius, replicas)).withColumnRenamed("vertex", "fp")
    rooted = classes.join(reached, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, replicas: int = REPLICAS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Of rows with equal doc_id and text one stays; rows without a doc_id stay, since nothing tells them apart.
    """
    found = keep(near_duplicates(docs, k, radius, replicas))
    firsts = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(firsts, "doc_id", "left_semi")
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = keep(repeated)
        once = named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        named = named.join(repeated, "doc_id", "left_anti").union(once)
    return named.select(*[quoted(c) for c in docs.columns]).union(docs.filter("doc_id IS NULL"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_near_dedup": (op6_simhash_near_dedup, None)}
