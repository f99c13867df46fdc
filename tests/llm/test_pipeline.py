"""The pipeline, stage by stage, against plain code on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_similar import groups
from tests.llm.test_texts import check_pieces, plain_spans
from zonemill.llm.store import stored

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


def test_stages(spark):
    docs, tables = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = stored(stage(spark, docs, str(FOLDER)), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    rows = {n: t.collect() for n, t in tables.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows["quality"]}
    labelled = [r.doc_id for r in rows["language"] if r.doc_id in labels]
    assert sum((d in kept) == (labels[d] == 1) for d in labelled) >= 0.97 * len(labelled)
    want = groups([(r.doc_id, r.text) for r in rows["quality"]], 80)
    assert {r.doc_id for r in rows["near_dedup"]} == {d for d, (_, root) in want.items() if d == root}
    assert {r.doc_id for r in rows["personal_data"]} == {r.doc_id for r in rows["near_dedup"]}
    before = {r.doc_id: r.text for r in rows["near_dedup"]}
    assert all(not plain_spans(r.text) and (r.text == before[r.doc_id] or "<" in r.text) and r.n_chars == len(r.text) for r in rows["personal_data"])
    check_pieces(rows["packing"], [(r.doc_id, r.text) for r in rows["personal_data"]], 4096)


def test_near_copies_go_by_row(spark):
    x, y, z = ("".join(f"{w}{i} " for i in range(40)) for w in ("ab", "cd", "ef"))
    rows = [(3, x), (5, x), (5, y), (7, z), (7, z), (9, z + "more"), (1, ""), (1, ""), (None, x), (None, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, x), (5, y), (7, z), (1, ""), (1, ""), (None, x), (None, x)], key=str)
    both = spark.createDataFrame([(2, x), (2, x + "more"), (4, x)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, both, "").collect()] == [2]
