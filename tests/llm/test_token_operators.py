"""Encoder, length histogram, packing and token files against the plain tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableaudit.llm import op3_token_counts as counts
from tableaudit.llm import op9_best_fit as packing
from tableaudit.llm import op10_token_files as files
from tableaudit.llm.common import scratch
from tableaudit.llm.tokens import Encoder, default_path

PATH = default_path()
ENCODER = Encoder(PATH)

TEXTS = [
    None,
    "",
    " ",
    "  a  b \n c",
    "x\n \n y   z\n\nq\n",
    "a b\t \x1c c'll <|endoftext|> don't. U.S.A., x.. ½ ²",
    "Ouréaux qui\nÉlle. l’été   fin\r\n\r\n ok",
    "日本語 のテキスト 🙂🙂 é " + "long" * 40,
    "word " * 3000,
    "7 77 777 7777 3.14 -5 +6",
]
SCHEMA = "doc_id bigint, text string, ids string, length string, source string"


def plain(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def docs(spark, texts=TEXTS, first=0):
    rows = [(first + 3 * i, t, "x", "y", "src0") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[-1], (None, "no id", None, None, None)], SCHEMA)


def test_encoder_on_odd_texts():
    for _ in range(2):  # the second time most pieces are known
        assert [ids(x) for x in ENCODER.encode(TEXTS)] == [plain(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r.,'aZé1½²_-  \x1c日🙂st"), max_size=40), max_size=4))
def test_encoder_on_random_texts(texts):
    assert [ids(x) for x in ENCODER.encode(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_encoder_with_another_tokenizer(name):
    other = Encoder(default_path(name))
    want = [other.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS[:7]]
    assert [ids(x) for x in other.encode(TEXTS[:7])] == want


def test_histogram(spark):
    table = docs(spark)
    sizes = [len(plain(r["text"])) for r in table.collect()]
    got = {r["length"]: r for r in counts.length_histogram(table, PATH).collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == Counter(sizes)
    for limit, row in got.items():
        assert row["truncated_tokens"] == sum(min(n, limit) for n in sizes)
        assert row["n_longer"] == sum(n > limit for n in sizes)
        assert row["cut_tokens"] + row["truncated_tokens"] == row["total_tokens"] == sum(sizes)
    histogram = counts.length_histogram(table, PATH)
    limits = {r["limit"]: r for r in counts.at_limits(histogram, [0, 5, 10**6]).collect()}
    assert all(r["truncated_tokens"] == sum(min(n, k) for n in sizes) for k, r in limits.items())
    half = counts.quantiles(histogram, [0.5, 1.0]).collect()
    assert [r["length"] for r in half] == [sorted(sizes)[(len(sizes) + 1) // 2 - 1], max(sizes)]
    assert counts.length_histogram(table.limit(0), PATH).count() == 0


def test_best_fit_runs_are_best_fit_decreasing():
    draw = random.Random(1)
    for capacity in (7, 20, 64):
        sizes = [draw.randrange(1, capacity + 1) for _ in range(400)]
        gaps = []
        for n in sorted(sizes, reverse=True):  # one document after the other
            fits = [i for i, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[min(fits, key=lambda i: gaps[i])] -= n
            else:
                gaps.append(capacity - n)
        filled = defaultdict(list)
        for length, _, count, sequence, place in packing.best_fit_runs(Counter(sizes), capacity):
            for i in range(count):
                filled[sequence + i].append((place, length))
        assert sorted(n for x in filled.values() for _, n in x) == sorted(sizes)
        assert len(filled) == len(gaps)
        for own in filled.values():
            ends = [0]
            for place, length in sorted(own):
                assert place == ends[-1]
                ends.append(place + length)
            assert ends[-1] <= capacity


def test_packing(spark):
    table = docs(spark, TEXTS + ["many words here " * 900, "b " * 5000])
    rows = packing.pack(table, PATH, capacity=512, ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 <= 512 and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_doc[r["doc_id"]].append((r["start"], r["piece"], ids(r["ids"])))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter((r["doc_id"], tuple(plain(r["text"]) + [0])) for r in table.collect())
    for (doc_id, whole), n in want.items():
        parts = sorted(by_doc[doc_id])[::n] if n > 1 else sorted(by_doc[doc_id])
        assert [p for _, p, _ in parts] == list(range(len(parts)))
        assert tuple(i for _, _, x in parts for i in x) == whole
        assert all(len(x) == 512 for _, _, x in parts[1:])
    for own in by_sequence.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 512) + 1
    joined = packing.sequences(packing.pack(table, PATH, capacity=512, ids=True)).collect()
    assert sum(len(r["ids"]) for r in joined) == total and max(len(r["ids"]) for r in joined) <= 512
    assert packing.pack(table.limit(0), PATH).count() == 0


def test_packing_ranks_split_frequent_lengths(spark, monkeypatch):
    table = spark.range(3000).selectExpr("id AS doc_id", "'same' AS text")
    monkeypatch.setattr(packing, "RANK_GROUP", 100)
    rows = packing.pack(table, PATH).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert len({r["sequence_id"] for r in rows}) == -(-3000 * 2 // 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), max_size=700), st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_blocks_round_trip(values, percentile):
    values = np.array(values, np.uint32)
    cut = len(values) // 3
    parts = [values[:cut], values[cut:cut], values[cut:]]
    image = files.Image(files.write_image([5, None, -1], [p.astype("<u4").tobytes() for p in parts], percentile))
    assert image.doc_ids == [5, None, -1] and image.lengths.tolist() == [len(p) for p in parts]
    assert np.array_equal(image.read(), values)
    assert np.array_equal(image.read(cut, cut + 300), values[cut : cut + 300])


def test_exceptions_keep_blocks_narrow():
    values = np.random.default_rng(1).integers(0, 100, 256 * 50).astype(np.uint32)
    plain_size = sum(map(len, files.pack_blocks(values)[0]))
    values[::97] = 50_000
    blocks, exceptions = files.pack_blocks(values)
    assert exceptions > 0 and sum(map(len, blocks)) < 1.4 * plain_size


def test_token_files(spark):
    table = docs(spark, first=-9).repartition(3)
    path = scratch(spark)
    files.write_tokens(table, path, PATH)
    got = files.read_documents(spark, path).collect()
    start, want = 0, []
    for r in sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        own = plain(r["text"]) + [2]
        want.append((r["doc_id"], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = scratch(spark)
    files.write_tokens(table.limit(0), empty, PATH)
    assert files.read_documents(spark, empty).count() == 0


def test_packing_encodes_little_text_at_once(spark, monkeypatch):
    """All workers of an executor hold what they encode; 8 MB of text at once took too much of it."""
    import pyarrow as pa

    from tableaudit.llm import op9_best_fit

    sizes = []

    class Sizes:
        def encode(self, texts):
            sizes.append(sum(map(len, texts)))
            return [b""] * len(texts)

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            return work

    monkeypatch.setattr(op9_best_fit, "encoder", lambda path: Sizes())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": ["word " * 1000] * 2000})
    rows = sum(out.num_rows for out in op9_best_fit.cut_pieces(Docs(), "none")(iter([batch])))
    assert rows == 2000 and sum(sizes) == 10_000_000 and max(sizes) <= 4_000_000


def test_pieces_are_looked_up_in_a_table_of_the_shorter_list(monkeypatch):
    """A batch of few new pieces beside many known ones hashes the few, and no piece becomes a string by itself."""
    import pyarrow as pa

    from tableaudit.llm import tokens

    tables, index_in = [], tokens.pc.index_in

    def counted(values, value_set):
        tables.append(len(value_set))
        return index_in(values, value_set=value_set)

    monkeypatch.setattr(tokens.pc, "index_in", counted)
    known = tokens.Known(lambda pieces: (np.array([len(p) for p in pieces], np.uint32), np.ones(len(pieces), np.int64)))
    for pieces in ([f"w{i}" for i in range(1000)], ["w7", "", "é\n", "w999"], [f"w{i}" for i in range(3000)], ["w2999", "new", "w0"]):
        ids, start, size = known.find(pa.array(pieces, pa.large_string()))
        assert ids[start].tolist() == [len(p) for p in pieces] and (size == 1).all()
    assert tables == [0, 4, 1002, 3]
