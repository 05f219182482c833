"""The pipeline's stages against plain versions, one after another."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_contamination, brute_near, brute_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(root / f"{name}.parquet"))
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    rows = lambda f: [(r.doc_id, r.text) for r in f.collect()]
    before = rows(docs)
    known = steps["language_id"](spark, docs, folder)
    assert known.columns == columns and len(rows(known)) >= 0.99 * len(before)
    before = rows(known)
    unique = steps["near_dedup"](spark, known, folder)
    assert unique.columns == columns and {i for i, _ in rows(unique)} == {x[0] for x in brute_near(before, 5, 80) if x[3]}
    before = dict(rows(unique))
    clean = steps["decontamination"](spark, unique, folder)
    judged = {x[0]: x for x in brute_contamination(list(before.items()), items)}
    after = dict(rows(clean))
    assert clean.columns == columns and set(after) == {i for i, x in judged.items() if not x[5] and (x[2] < x[1] or not x[2])}
    assert all(after[i] == before[i] for i in after if not judged[i][2])
    assert all(x[2] == 0 or len(after[x[0]]) < len(before[x[0]]) for x in judged.values() if x[0] in after)
    private = steps["pii"](spark, clean, folder)
    assert private.columns == columns and set(dict(rows(private))) == set(after)
    assert not any(brute_spans(t) for _, t in rows(private))
    packed = steps["packing"](spark, private, folder).collect()
    assert {r.doc_id for r in packed} == set(after) and max(r.offset + r.length for r in packed) <= 2048


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert corpus_pipeline.ORACLE_SQL is None and out.count() > 0
