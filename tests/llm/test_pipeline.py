"""The corpus pipeline stage by stage on small tables, against plain versions of the stages."""

import pytest

import corpus_pipeline
from tableaudit.llm import op5_toxicity, op6_simhash, op7_winnowing, op8_pii
from tableaudit.llm.common import keep, scratch
from tableaudit.llm.tokens import Encoder, default_path
from test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark):
    rows, labels = corpus(600, seed=3)
    benchmark = [(1, " ".join(f"item{i}" for i in range(20))), (2, None)]
    rows = [(d, t, "en", f"src{d % 3}", len(t)) for d, t, *_ in rows]
    rows += [(1000 + i, rows[1][1], "en", "src0", len(rows[1][1])) for i in range(30)]
    rows += [(2000, "before " + benchmark[0][1], "en", "src1", 5), (2001, "mail me a.b@c.example or +1 (414) 555-7134 today", "de", "src1", 48)]
    rows += [(2002, None, None, None, None), (2003, "", "", "", 0), (None, "a text without an id", "en", "src0", 20), rows[1]]
    path = scratch(spark)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumnRenamed(
        "lang", "lang"
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    model = op5_toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = keep(stage(spark, docs, folder))
        rows = docs.collect()
        left[name] = rows
        if name == "toxicity":
            scores = model.scores([r["text"] for r in before])
            assert len(rows) == sum(s < 0.5 for s in scores) < len(before)
        elif name == "near_duplicates":
            prints = {(r["doc_id"], op6_simhash.simhash(op6_simhash.shingle_hashes(r["text"]))) for r in rows if r["doc_id"] is not None}
            ids = [d for d, _ in prints]
            assert len(ids) == len(set(ids)) and 1 in ids and not {*range(1000, 1030)} & {*ids}
            assert all((a ^ b).bit_count() > 2 for d, a in prints for e, b in prints if d < e)
            gone = [r for r in before if r["doc_id"] is not None and r["doc_id"] not in ids]
            for r in gone:  # each has a kept neighbour or neighbour's neighbour
                own = op6_simhash.simhash(op6_simhash.shingle_hashes(r["text"]))
                assert any((own ^ p).bit_count() <= 6 for _, p in prints)
        elif name == "decontamination":
            index = op7_winnowing.Index([(1, " ".join(f"item{i}" for i in range(20)))])
            assert len(before) - len(rows) == sum(bool(index.search(op7_winnowing.words_of(r["text"]))[1]) for r in before) == 1
        elif name == "personal_data":
            want = {r["doc_id"]: op8_pii.redacted(r["text"]) for r in before}
            assert {r["doc_id"]: r["text"] for r in rows} == want
            assert want[2001] == "mail me [EMAIL] or [PHONE] today"
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        if name != "packing":
            assert docs.columns == columns
    encoder = Encoder(default_path())
    sizes = {r["doc_id"]: len(encoder.encode([r["text"]])[0]) // 4 + 1 for r in left["personal_data"]}
    packed = {}
    for r in left["packing"]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == sizes
    assert len({r["sequence_id"] for r in left["packing"]}) <= -(-sum(sizes.values()) // 2048) + 1


def test_run_and_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, folder))
        assert docs.count() == 0
