"""The pipeline's stages, each on its own input, against brute force."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phenoframe.llm import quality
from phenoframe.llm.session import cut
from test_llm_operators import FOLDER, components, hits


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], FOLDER), name))
    return [s.collect() for s in steps], [s.columns for s in steps]


def test_stages_keep_the_columns(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[1:-1])


def test_quality_rejects_what_it_scores_low(spark, stages):
    rows, _ = stages
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit_model(docs, labels.where(~quality.held_out("doc_id")), "doc_id", "text", "quality")
    keep = {r.doc for r in quality.score(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in rows[1]} == keep
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & keep) > 0.95 * len(good)


def test_one_document_of_each_group_stays(stages):
    rows, _ = stages
    expected = components([(r.doc_id, r.text) for r in rows[1]], 80)
    assert {r.doc_id for r in rows[2]} == {i for i, (_, _, kept) in expected.items() if kept}


def test_contaminated_documents_go(spark, stages):
    rows, _ = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {i for i, *_, contaminated in hits([(r.doc_id, r.text) for r in rows[2]], items) if contaminated}
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]} - bad


def test_secrets_are_replaced(stages):
    rows, _ = stages
    sure = re.compile(r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')
    before = {r.doc_id: r for r in rows[3]}
    assert len(rows[4]) == len(rows[3])
    for r in rows[4]:
        assert r.text == sure.sub("[SECRET]", before[r.doc_id].text)
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)


def test_packing_covers_every_token(stages):
    rows, _ = stages
    total = {}
    for r in rows[5]:
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert set(total) == {r.doc_id for r in rows[4]} and all(a == b for a, b in total.values())


def test_stages_take_awkward_documents(spark):
    body = " ".join(f"word{k}" for k in range(80))
    rows = [(None, None), (None, body), (1, ""), (2, body), (2, body), (3, body + " more"), (4, "x" * 300_000), (5, None)]
    docs = spark.createDataFrame(
        [(i, t, None, None, None if t is None else len(t), "a", "b", 1.0) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, doc string, _row string, score double")
    for _, stage in corpus_pipeline.STAGES[1:]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, FOLDER)
            count = out.count()
            assert count == 0 if table is not docs else count > 0
    kept = corpus_pipeline.keep_one_of_each(spark, docs, FOLDER).where(F.col("doc_id").isNotNull()).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4, 5]
    assert zlib.crc32(b"") == 0
