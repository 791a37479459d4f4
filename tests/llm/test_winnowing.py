"""Benchmark decontamination against a search for every window."""

import random
import re

import numpy as np
import pytest

from tableaudit.llm import op7_winnowing as winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def plain(text, items):
    own = words(text)
    hit, found = set(), set()
    for item, other in items:
        other = words(other)
        size = min(10, len(other))
        windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(own), sorted(hit), sorted(found)


def data():
    draw = random.Random(8)
    vocabulary = ["the", "a", "B", "é1", "x_y", "Z9"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, text(draw.randrange(0, 40))) for i in range(40)] + [(100, "la " * 30), (101, None), (102, "..."), (7, "one two")]
    rows = []
    for i in range(150):
        own = text(draw.randrange(0, 80)).split(" ")
        for _ in range(draw.randrange(3)):
            item = (draw.choice(items)[1] or "").split(" ")
            start = draw.randrange(len(item))
            at = draw.randrange(len(own) + 1)
            own[at:at] = item[start : start + draw.randrange(5, 30)]
        rows.append((i, draw.choice([" ", ", ", "\n"]).join(own)))
    rows += [(500, "la " * 500), (501, None), (502, ""), (None, items[3][1]), (500, "la " * 500)]
    return rows, items


@pytest.mark.parametrize("block_bytes", [10**9, 1500])
def test_contamination(spark, block_bytes):
    rows, items = data()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, items int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnowing.contamination(docs, bench, block_bytes=block_bytes).collect()
    shown = [(r["doc_id"], r["n_words"], [w for s in r["spans"] for w in range(s["start"], s["end"])], sorted(r["items"])) for r in got]
    want = [(d, *plain(t, items)) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(shown, key=key) == sorted(want, key=key)
    clean = winnowing.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _, hit, _ in want if not hit)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in winnowing.contamination(docs, none).collect()] == [(1, 2, [], [])]
    assert winnowing.contamination(docs.limit(0), none).count() == 0
    assert winnowing.drop_contaminated(docs, none).count() == 1


def test_winnowing_keeps_a_fingerprint_of_every_shared_span():
    draw = random.Random(3)
    for _ in range(200):
        span = [b"%d" % draw.randrange(6) for _ in range(10)]
        texts = [[b"%d" % draw.randrange(6) for _ in range(draw.randrange(30))] + span + [b"q"] * draw.randrange(9) for _ in range(2)]
        own = []
        for t in texts:
            found = winnowing.grams(winnowing.word_hashes(t), 5)
            own.append(set(found[winnowing.winnow(found, 6)].tolist()))
        assert own[0] & own[1]


def test_one_block_of_items_at_a_time(spark):
    rows, items = data()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, items int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(winnowing._blocks(bench, 800))) > 2
    clean = winnowing.drop_contaminated(docs, bench, block_bytes=800)
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, winnowing.drop_contaminated(docs, bench).collect()))


def test_template_of_many_items():
    """Windows of a template lead to one list of items, whatever their number."""
    import time

    template = [f"w{i}" for i in range(300)]
    items = [(i, " ".join([f"own{i}", *template])) for i in range(3000)]
    index = winnowing.Index(items)
    group = index.groups[0]
    assert len(group.keys) == 291 + 3000 and len(group.lists) == 3001
    start = time.time()
    spans, found = index.search([b"x", *[w.encode() for w in template], b"y"])
    assert spans == [(1, 301)] and found == set(range(3000))
    assert time.time() - start < 1
    assert index.search([b"own7", *[w.encode() for w in template[:9]]]) == ([(0, 10)], {7})


def test_windows_with_one_hash(monkeypatch):
    """Windows are told apart by their words when their hashes agree."""
    monkeypatch.setattr(winnowing, "grams", lambda hashes, k: np.zeros(max(0, len(hashes) - k + 1), np.uint64))
    index = winnowing.Index([(1, "a b c"), (2, "a b d"), (3, "a b c")], window=3, gram=3)
    assert index.search([b"a", b"b", b"c"]) == ([(0, 3)], {1, 3})
    assert index.search([b"a", b"b", b"d"]) == ([(0, 3)], {2})
    assert index.search([b"a", b"b", b"e"]) == ([], set())
