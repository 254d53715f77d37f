"""Every stage on its own input, against plain versions; the stages as a whole; odd rows."""

import pytest
from test_decontaminate import brute as leaks
from test_lines import brute as stripped
from test_minhash import brute as classes

import corpus_pipeline as pipeline
from tidemark.llm import lines, quality
from tidemark.llm.frames import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        found.append(docs)
    return [{r.doc_id: r for r in df.collect()} for df in found], [df.columns for df in found]


def test_columns(stages):
    assert stages[1][:-1] == [COLUMNS] * 5 and stages[1][-1] == [*COLUMNS, "copies"]


def test_quality(spark, sf_dir, stages):
    before, after = stages[0][:2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert after.keys() < before.keys()
    judged = [(i in after) == labels[i] for i in before if i in labels]
    assert sum(judged) / len(judged) > 0.95
    assert all(after[i] == before[i] for i in after)


def test_lines(stages):
    before, after = stages[0][1:3]
    want = {r[0]: r[4] for r in stripped([(r.doc_id, r.text, r.source) for r in before.values()], lines.MIN_SITES, lines.MAX_SHARE)}
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)


def test_near_duplicates(stages):
    before, after = stages[0][2:4]
    want = {r[0] for r in classes([(r.doc_id, r.text) for r in before.values()], 5, 80) if r[3]}
    assert after.keys() == want < before.keys()


def test_decontamination(spark, sf_dir, stages):
    before, after = stages[0][3:5]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r[0] for r in leaks([(r.doc_id, r.text) for r in before.values()], items)}
    assert gone and after.keys() == before.keys() - gone


def test_mix(stages):
    before, after = stages[0][4:]
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert after.keys() <= before.keys() and all(1 <= r.copies <= 3 for r in after.values())
    taken = sum(len(r.text.split()) * r.copies for r in after.values())
    assert abs(taken / size(before.values()) - 1) < 0.1


def test_odd_rows(spark, sf_dir, odd, no_rows, tmp_path):
    spark.createDataFrame([(7, 1), (2, 0), (8, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, no_rows):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            after = materialize(stage(spark, docs, str(tmp_path)), name)
            if name != "mix":
                assert after.columns == docs.columns
            assert after.count() <= docs.count() and (n or after.count() == 0)
            docs = after


def test_null_texts_stay_null_when_lines_go(spark, odd):
    found = pipeline.strip_boilerplate(spark, odd, "")
    assert found.where("text IS NULL").count() == odd.where("text IS NULL").count()
    assert found.schema.names == odd.schema.names


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).columns == [*COLUMNS, "copies"]
    assert [name for name, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mix"]
    assert quality.MAX_ROWS == 20_000
