"""Compression-distance scores: held-out accuracy and defined cases."""

import os
import random
import zlib

import pytest

from tableaudit.llm import op5_toxicity as toxicity

SF_DIR = "/root/testdata/sf0.1"


def corpus(n=1500, seed=1):
    draw = random.Random(seed)
    syllables = ["an", "er", "in", "on", "th", "es", "ti", "re", "ou", "ble", "ing", "tion"]
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    marks = ["gruffhound", "snarlix", "bogwart", "vilekin", "muckrat"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(common) if draw.random() < 0.4 else "".join(draw.choices(syllables, k=draw.randrange(1, 4))) for _ in range(draw.randrange(60, 300))]
        toxic = i % 6 == 0
        for _ in range(draw.randrange(2, 6) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(marks))
        rows.append((i, " ".join(words), 9, "x"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(90001, None, None, None), (90002, "", 0, "x"), (None, "no id", 1, "x"), rows[0]], "doc_id bigint, text string, score int, toxic string")
    known = labels + [(None, 1, 1), (3, 1, None), (4, 1, 7), (90002, 1, 0), labels[0]]
    known = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    return docs, known, toxicity.fit(docs, known)


def test_held_out_rows(fitted):
    docs, _, model = fitted
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    apart = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic, other = [i for i in apart if i % 6 == 0], [i for i in apart if i % 6]
    assert sum(got[i] >= 0.5 for i in toxic) / len(toxic) >= 0.95
    assert sum(got[i] >= 0.5 for i in other) / len(other) <= 0.02
    assert all(0 <= s <= 1 for s in got.values())
    assert got[90001] == got[90002] < 0.5


def test_rejected_documents_go(fitted):
    docs, _, model = fitted
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    scores = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert kept.count() == sum(s < 0.5 for s in scores)
    assert kept.filter("text IS NULL").count() == 1


def test_learning_leaves_held_out_labels_alone(spark, fitted):
    docs, known, model = fitted
    other = known.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert toxicity.fit(docs, other) == model


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0
    few = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    assert toxicity.score(texts, toxicity.fit(texts, few)).count() == 40


def test_windows_hold_every_word():
    words = [f"w{i}" for i in range(1000)]
    assert " ".join(w.decode().strip() for w in toxicity.windows_of(" ".join(words))).split() == words


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_given_tables(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = toxicity.op5_toxicity(spark, SF_DIR).join(labels, "doc_id").filter("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"]]
    wrong = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(caught) / len(caught) >= 0.55 and sum(wrong) / len(wrong) <= 0.02


def test_margins_against_single_compressions(fitted):
    """Features of whole texts from one compressor call per window and dictionary."""
    import numpy as np

    _, _, model = fitted
    draw = random.Random(7)
    words = ["gruffhound", "the", "ÉTÉ", "of", "snarlix", "tion", "ing", "\x00", "a" * 300]
    texts = [None, "", "one", "  ", *(" ".join(draw.choices(words, k=draw.randrange(1, 90))) for _ in range(25))]
    one = {name: toxicity._compressor(getattr(model, name)) for name in ("ordinary", "toxic", "marked")}
    for text, row in zip(texts, model.features(texts)):
        own = toxicity.words_of(text)
        windows = [own[i : i + 16] for i in range(0, len(own), 16)] or [[]]
        length = lambda name: [len(one[name].compress(b" " + b" ".join(w) + b" ")) for w in windows]  # noqa: B023, E731
        plain, toxic, marked = length("ordinary"), length("toxic"), length("marked")
        margin = [a - b for a, b in zip(plain, marked)]
        other = [a - b for a, b in zip(plain, toxic)]
        gain = sorted((max(m, 0) for m in margin), reverse=True)
        n = len(windows)
        two = sum(m >= 2 for m in margin)
        want = [1, *(gain + [0, 0, 0])[:3], np.log1p(sum(m >= 1 for m in margin)), np.log1p(two), np.log1p(sum(gain)), np.log(n)]
        want += [two / n, sum(margin) / n, max(other), sum(other) / n, sum(m >= 2 for m in other) / n]
        assert np.allclose(row, want)
