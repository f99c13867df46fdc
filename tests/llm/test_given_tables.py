"""Registered queries on the given tables: against plain code, and held-out accuracy."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import test_align
import test_runs
from zonemill.llm import queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no tables")


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_periodic_runs(spark):
    got = Counter(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect())
    assert got == Counter(test_runs.plain_report(d, t) for d, t in documents(spark, SMALL)) and any(r[1] for r in got)


def test_token_alignment(spark):
    got = Counter(tuple(r) for r in queries.QUERIES["op13_token_alignment"](spark, SMALL).collect())
    assert got == test_align.plain_report(documents(spark, SMALL))


def test_quality_of_held_out_documents(spark):
    scored = {r.doc_id: r for r in queries.QUERIES["op1_quality_classifier"](spark, MORE).collect()}
    labels = [r for r in spark.read.parquet(f"{MORE}/labels.parquet").collect() if r.quality is not None and scored[r.doc_id].held_out]
    assert len(labels) > 50 and np.mean([scored[r.doc_id].predicted == r.quality for r in labels]) >= 0.95


def test_language_of_held_out_documents(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op8_language"](spark, MORE).collect()}
    known = [r for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect() if r.lang is not None and found[r.doc_id].held_out]
    assert len(known) > 100 and np.mean([found[r.doc_id].lang_pred == r.lang for r in known]) >= 0.95


def test_recall_of_nearest_neighbours(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{MORE}/embeddings.parquet").collect() if r.embedding is not None and None not in r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    near = {}
    for r in queries.QUERIES["op9_nearest"](spark, MORE).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    right = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        right, total = right + len(near.get(ids[q], set()) & set(best.tolist())), total + len(best)
    assert right / total >= 0.9
