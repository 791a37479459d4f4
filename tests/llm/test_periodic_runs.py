"""Periodic runs against a search of every period, and the planted stretches against the words of the contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableaudit.llm import op12_periodic_runs as periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """Runs by trying every period, smallest first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any((start, length, p) in seen for p in range(1, q) if q % p == 0):
                out.append((start, length, q))
            if length >= 2 * q:
                seen.add((start, length, q))
    return sorted(out)


def collapse(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def smallest(words, found):
    """Drop rows whose period is not the smallest of their stretch."""
    keep = []
    for s, length, q in found:
        part = words[s : s + length]
        if not any(part[p:] == part[:-p] for p in range(1, q)):
            keep.append((s, length, q))
    return keep


def reference(words):
    return smallest(words, plain(words))


def by_arrays(texts):
    found, kept = periodic.runs_of([[w.encode() for w in t] for t in texts])
    ends = np.cumsum([len(t) for t in texts])
    return [
        (sorted(tuple(r[:3]) for r in found.tolist() if r[3] == i), [w for w, k in zip(t, kept[e - len(t) : e]) if k])
        for i, (t, e) in enumerate(zip(texts, ends))
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4))
def test_small_alphabets(texts):
    for text, (runs, rest) in zip(texts, by_arrays([list(t) for t in texts])):
        assert runs == reference(list(text))
        assert rest == collapse(list(text), runs)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_planted_periods(data):
    parts = []
    for _ in range(data.draw(st.integers(1, 4))):
        unit = data.draw(st.lists(st.sampled_from("abcd"), min_size=1, max_size=17))
        times = data.draw(st.integers(1, 6))
        parts += unit * times + unit[: data.draw(st.integers(0, len(unit)))]
    assert by_arrays([parts])[0][0] == reference(parts)


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 32, 33, 100])
def test_least_lengths(period):
    unit = [f"w{i}" for i in range(period)]
    least = max(6, 4 * period)
    long = (unit * 8)[:least]
    assert by_arrays([long])[0][0] == [(0, least, period)]
    assert by_arrays([long[:-1]])[0][0] == []
    assert by_arrays([["x"] + long + ["y"]])[0][0] == [(1, least, period)]


def test_long_text_of_one_word():
    runs, rest = by_arrays([["la"] * 300_000])[0]
    assert runs == [(0, 300_000, 1)] and rest == ["la"]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_rows(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\x0b", "a", "\x00 \x00 " * 9, "é é   x" * 30, "a b " * 50, "w" * 100_000]
    docs = [(i, rng.choice(texts) if i % 3 else " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for i in range(300)]
    docs += [docs[3], docs[3], (None, "a b a b a b a b a b")]
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, runs string, start int")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in docs:
        words = planted(doc_id, text) if doc_id is not None else WORD.findall(text)
        runs = reference(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        start, length, period = best or (None, None, None)
        want.append(
            (
                doc_id,
                len(runs),
                start,
                length,
                period,
                best and 1000 * length // period,
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(" ".join(collapse(words, runs)).encode()).hexdigest(),
            )
        )
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(empty).collect() == []
    assert periodic.find_runs(empty.select("doc_id", F.col("text"))).columns == ["doc_id", "n_words", "runs", "collapsed"]
