"""Quoted CSV and JSON documents in tiny splits against the readers of whole files."""

import json
import random

import pytest

from tableaudit.sources import readers as S
from tableaudit.sources import splits


@pytest.fixture(params=[64, 700])
def tiny(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def whole(spark, path, encoding="UTF-8", sep=","):
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding, sep=sep)


def random_csv(seed, end="\n"):
    rng = random.Random(seed)

    def cell():
        kind = rng.randrange(7)
        if kind == 0:
            return ""
        if kind == 1:
            return str(rng.randrange(1000))
        if kind == 2:
            return '5" pipe' if rng.random() < 0.5 else 'a "quoted" word'
        text = "".join(rng.choice(['a', 'b ', '""', ',', end, end + end, ' ', 'é']) for _ in range(rng.randrange(25)))
        return f'"{text}"' if kind < 6 else '"' + "z" * rng.randrange(200) + end + '"'

    lines = ["id,one,two"]
    for i in range(60):
        lines.append(f"{i},{cell()},{cell()}")
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


@pytest.mark.parametrize("seed", range(2))
def test_csv_like_the_whole_reader(spark, tmp_path, tiny, seed):
    path = tmp_path / "q.csv"
    path.write_bytes(random_csv(seed, "\r\n" if seed % 2 else "\n").encode())
    records, other = splits.csv_records(spark, str(path))
    names = whole(spark, str(path)).columns
    got = splits.parse_csv(records, names)
    assert other == []
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole(spark, str(path)).collect()), key=repr)
    if tiny < 200:
        assert records.rdd.getNumPartitions() > 3


def test_csv_of_several_files_and_encodings(spark, tmp_path, tiny):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_bytes(random_csv(11).encode())
    (tmp_path / "d" / "b.csv").write_bytes(random_csv(12).encode("latin-1"))
    (tmp_path / "d" / "c.csv").write_bytes(random_csv(13, "\r\n").encode())
    got = S.read_csv(spark, str(tmp_path / "d"), infer=False).select("id", "one", "two")
    want = [
        tuple(r)
        for name, encoding in (("a", "UTF-8"), ("b", "ISO-8859-1"), ("c", "UTF-8"))
        for r in whole(spark, str(tmp_path / "d" / f"{name}.csv"), encoding).collect()
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_csv_one_record_over_many_splits(spark, tmp_path, tiny):
    path = tmp_path / "l.csv"
    path.write_text('id\tt\n1\t"' + "line\n" * 500 + '"\n2\tx\n')
    got = {r["id"]: r["t"] for r in S.read_csv(spark, str(path), sep="\t", infer=False).collect()}
    assert got == {"1": "line\n" * 500, "2": "x"}


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [
        (b'a,"b', False, True),
        (b'b",c', True, False),
        (b'5" pipe,"x', False, True),
        (b'"",""""', False, False),
        (b'"a""', False, True),
        (b'"a" junk " , "b', False, False),
        (b'x","y', True, True),
        (b"", True, True),
    ],
)
def test_states_of_lines(line, inside, after):
    assert splits.quoted_after(line, inside, b",") is after


def random_json(seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['a', ',', '"', "\\", "[", "]", "{", "}", ":", "é", "\n"]) for _ in range(rng.randrange(20)))
    record = lambda i: {
        "id": i,
        "s": text(),
        "o": {"k": rng.choice([None, text()]), "l": [i, [i]]},
        "n": rng.choice([1.5, None, 2]),
    }
    rows = [record(i) for i in range(rng.randrange(1, 40))]
    root = {text() + str(i): rng.choice([1, None, text(), {"in": [1, {"x": [2]}]}]) for i in range(rng.randrange(4))}
    root |= {"ro,ws": rows, "later": [record(-1)], "end": text()}
    return root, rows


@pytest.mark.parametrize("seed", range(2))
def test_json_like_the_parsed_document(spark, tmp_path, tiny, seed):
    root, rows = random_json(seed)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(root, indent=seed % 3 or None, ensure_ascii=bool(seed % 2)))
    records, single = splits.json_records(spark, str(path))
    key = lambda r: json.dumps(r, sort_keys=True)
    assert single == []
    assert sorted((json.loads(r["text"]) for r in records.collect()), key=key) == sorted(rows, key=key)
    later, _ = splits.json_records(spark, str(path), "later")
    assert [json.loads(r["text"]) for r in later.collect()] == root["later"]
    path.write_text(json.dumps(rows))
    records, _ = splits.json_records(spark, str(path))
    assert sorted((json.loads(r["text"]) for r in records.collect()), key=key) == sorted(rows, key=key)


def test_json_files_of_all_kinds(spark, tmp_path, tiny):
    folder = tmp_path / "j"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"x": [{"id": 1}, {"id": 2}], "y": [{"id": 9}]}))
    (folder / "b.json").write_text(json.dumps([{"id": 3}, {"id": 4}]))
    (folder / "c.json").write_text(json.dumps({"id": 5}))
    (folder / "d.json").write_text(json.dumps({"none": [], "id": 6}))
    got = S.read_json(spark, str(folder))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 5]
    assert [r["id"] for r in S.read_json(spark, str(folder), records_key="y").orderBy("id").collect()] == [3, 4, 9]


def test_json_list_of_values_and_nulls(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"v": [1, 2, None]}))
    assert sorted(map(str, (r["record"] for r in S.read_json(spark, str(path)).collect()))) == ["1", "2", "None"]
