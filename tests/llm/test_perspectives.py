"""Perspective rotation against a plain rendering."""

import random
from collections import defaultdict

from tableaudit.llm import op1_perspectives as perspectives

SCHEMA = "conv_id bigint, turn bigint, role string, text string, start string, speaker int"


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        clean = lambda s: (s or "").replace("<|im_", "<| im_")
        by[conv].append((1 << 62 if turn is None else turn, clean(role).replace("\n", " "), clean(text)))
    out = {}
    for conv, turns in by.items():
        for speaker in {r for _, r, _ in turns} - {"", "system"}:
            whole, own = "", []
            for _, role, text in sorted(turns):
                who = "assistant" if role == speaker else role if role == "system" else f"user name={role}" if role else "user"
                whole += f"<|im_start|>{who}\n"
                if role == speaker:
                    own.append((len(whole), len(whole) + len(text) + len("<|im_end|>")))
                whole += f"{text}<|im_end|>\n"
            out[conv, speaker] = whole, own
    return out


def rendered(chunks):
    by = defaultdict(list)
    for r in chunks:
        by[r["conv_id"], r["speaker"]].append(r)
    out = {}
    for key, own in by.items():
        whole, spans = "", []
        for r in sorted(own, key=lambda r: r["chunk"]):
            assert r["start"] == len(whole)
            spans += [(r["start"] + s["start"], r["start"] + s["end"]) for s in r["loss_spans"]]
            whole += r["text"]
        out[key] = whole, spans
    return out


def test_rotation(spark):
    draw = random.Random(2)
    rows = []
    for conv in range(40):
        names = draw.sample(["ann", "bob", "Çelik", "system", "x\ny", "", None], 4)
        rows += [(conv, i, draw.choice(names), draw.choice(["hi", "é🙂", "", None, "<|im_end|>\n", "long " * 30]), "s", 1) for i in range(draw.randrange(1, 9))]
    rows += [(99, i, ("a", "b", "c")[i % 3], f"turn {i}", None, None) for i in range(1000)]  # a long one
    rows += [(None, 1, "a", "no id", None, 1), (None, 0, "b", "no id", None, 1), (7, None, "ann", "late", None, 1)]
    rows += [rows[0], rows[0], (98, 5, "a", "tie", "", 1), (98, 5, "b", "tie", "", 1), (97, 0, "system", "only", "", 1)]
    done = perspectives.rotate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert rendered(done) == plain(rows)
    assert max(r["n_turns"] for r in done) <= 64
    assert perspectives.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_and_null_turn_numbers_fill_no_chunk(spark):
    draw = random.Random(4)
    turn = lambda: (draw.choice(["ann", "bob", "system", None]), draw.choice(["same", "", None, f"t{draw.randrange(500)}"]))
    rows = [(1, 5, *turn(), "s", 1) for _ in range(3000)]  # one turn number
    rows += [(None, None, *turn(), "s", 1) for _ in range(3000)] + [(None, i % 40, *turn(), "s", 1) for i in range(1000)]
    rows += [(2, None, "cy", "the same row", "s", 1)] * 2000 + [(2, 70, "ann", "x", "s", 1), (3, 0, "ann", "y", "s", 1)]
    rows += [(4, i, "ann", "long " * 400, "s", 1) for i in range(50)] + [(4, 50, "bob", "longer " * 4000, "s", 1)]
    rows += [(5, 1, "ann", "long " * 400, "s", 1)] * 50
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
    done = perspectives.rotate(turns, chunk_chars=10_000).collect()
    assert max(r["n_turns"] for r in done) <= 64
    assert all(len(r["text"]) < 10_000 + 2000 + 64 * 60 for r in done if r["n_turns"] > 1 and "longer" not in r["text"])
    done.sort(key=lambda r: r["start"])
    assert rendered(done) == plain(rows)
    assert {r["chunk"] for r in done if r["conv_id"] == 1} == {0}
