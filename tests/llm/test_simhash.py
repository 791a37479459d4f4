"""SimHash fingerprints, covering masks and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tableaudit.llm import op6_simhash as simhash
from tableaudit.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, linked):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "Two Éa", "A b c", "a\x0bB\x0cc d e " * 9, "x y " * 50])
def test_fingerprint(text):
    assert simhash.simhash(simhash.shingle_hashes(text)) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("radius, replicas", [(1, 1), (2, 1), (2, 2), (3, 1)])
def test_masks_cover_every_difference(radius, replicas):
    masks = simhash.covering_masks(radius, replicas)
    assert len(masks) == 2 ** (radius * replicas + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("n", [2, 40, 700])
def test_links_within_a_group(n):
    draw = random.Random(n)
    values = sorted({sum(1 << b for b in draw.sample(range(14), draw.randrange(8))) for _ in range(3 * n)})[:n]
    a, b = simhash.group_links(np.array(values, np.uint64), (1 << 14) - 1, 2)
    near = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    assert len(a) < len(values)
    assert roots(values, lambda x, y: frozenset((x, y)) in near) == roots(values, lambda x, y: (x ^ y).bit_count() <= 2)


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(5, 5), (7, 6), (None, 3)]
    edges += [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)]
    links = {frozenset(e) for e in edges if None not in e}
    values = sorted({v for e in edges if None not in e and e[0] != e[1] for v in e})
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == roots(values, lambda x, y: frozenset((x, y)) in links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def sample():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        base = [draw.choice(words) for _ in range(draw.randrange(3, 200))]
        rows.append((1000 - i, " ".join(base)))
        for j in range(draw.randrange(3)):
            other = list(base)
            other[draw.randrange(len(other))] = "changed"
            rows.append((2000 + 10 * i + j, " ".join(other)))
    rows += [(5000 + i, "same text in many copies of one document") for i in range(200)]
    rows += [(1, None), (2, ""), (3, " \n"), (None, ""), (None, "alone without id"), (1000, rows[0][1])]
    return [(d, t, "f", "c") for d, t in rows]


def test_near_duplicates(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    root = roots(sorted({f for _, f in prints}), lambda x, y: (x ^ y).bit_count() <= 2)
    first = {}
    for d, f in prints:
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    want = [(d, f"{f:016x}", first.get(root[f])) for d, f in prints]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0

    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(set(first.values()))
    assert kept.filter("doc_id IS NULL").count() == 2
