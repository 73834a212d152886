"""The pipeline's stages, each on its own input, and the whole."""

import hashlib

import pytest

import corpus_pipeline
from tidemark.llm import neardup, quality, suffixes


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((docs, new))
        docs = new
    return out


def test_stages(staged, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    assert len(corpus_pipeline.STAGES) == 5
    assert all(sorted(new.dtypes) == sorted(columns) for _, new in staged[:-1])
    assert all(new.columns == [c for c, _ in columns] for _, new in staged[:-1])


def test_quality_stage(staged, spark, sf):
    old, new = staged[0]
    w = quality.fit(old, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in quality.score(old, w).collect() if r.predicted}
    assert {r.doc_id for r in new.collect()} == want and 0 < len(want) <= old.count()


def test_near_stage(staged):
    old, new = staged[1]
    classes = {r.doc_id: r.class_id for r in neardup.classes(old).collect()}
    assert sorted(r.doc_id for r in new.collect()) == sorted(set(classes.values()))


def test_suffix_stage(staged):
    old, new = staged[2]
    want = {r.doc_id: r for r in suffixes.digest(old).collect()}
    for r in new.collect():
        if want[r.doc_id].n_removed == 0:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id].kept_sha256
        assert r.n_chars == len(r.text)
    assert new.count() == old.count()


def test_pii_stage(staged):
    old, new = staged[3]
    before = {r.doc_id: r.text for r in old.collect()}
    for r in new.collect():
        assert "@mail" not in r.text and (r.text == before[r.doc_id] or "<" in r.text)
    assert new.count() == len(before)


def test_packing_stage_and_run(staged, spark, sf):
    old, new = staged[4]
    assert {r.doc_id for r in new.select("doc_id").collect()} == {r.doc_id for r in old.select("doc_id").collect()}
    tokens = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert tokens == {r.doc_id: r.doc_tokens for r in new.collect()}


def test_stages_on_odd_tables(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() > 0, name
        assert stage(spark, empty, sf).count() == 0, name
