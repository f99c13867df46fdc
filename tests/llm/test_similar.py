"""Near-duplicates, fingerprints and nearest neighbours against plain code."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from zonemill.llm import components, mih, neardup, winnow


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def groups(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and root[a] < root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    return {d: (len(s), root[d]) for d, s in sets.items()}


def variants(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for base in range(4):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 90]))]
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return list(enumerate(out))


def test_groups_equal_brute_force(spark):
    rows = variants(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows, 85)


def test_large_nodes_and_blocks(spark, monkeypatch):
    for name, value in (("NODE", 4), ("BLOCK", 3)):
        monkeypatch.setattr(neardup, name, value)
    rows = variants(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == groups(rows, 80)


def test_groups_of_odd_rows(odd, empty):
    got = [tuple(r) for r in neardup.near_duplicates(odd).collect()]
    by_id = {}
    for doc, n, component, kept in got:
        by_id.setdefault(doc, []).append((n, component, kept))
    assert len(got) == odd.count()
    assert by_id[2] == [by_id[2][0]] * 2 and by_id[2][0][1:] == (1, False)
    assert by_id[3] == [(0, 3, True)] and by_id[4] == [(0, 4, True)] and by_id[6] == [(0, 6, True)]
    assert by_id[None][0][1:] == (None, True)
    assert by_id[12] == [(1, 11, False)] and by_id[11] == [(1, 11, True)]
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7 + 1)], "a long, b long")
    got = {r.a: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components.components(edges.limit(0)).count() == 0


def winnowed(grams, window):
    picked = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i:i + window]
        low = min(part)
        at = i + max(k for k, g in enumerate(part) if g == low)
        if not picked or picked[-1] != at:
            picked.append(at)
    return picked


def test_winnowing_positions(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") + rng.choice("ab") for _ in range(n)) for n in (1, 3, 5, 8, 21, 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    every = df.select("doc_id", winnow.selected(F.col("text"), 5, 1).alias("all"), winnow.selected(F.col("text"), 5, 4).alias("some")).collect()
    for r in every:
        grams = [x >> 31 for x in r["all"]]
        n = len(texts[r.doc_id].split())
        assert len(grams) == max(1, n - 4)
        assert [winnow.PLACE - (x & winnow.PLACE) - 1 for x in r["some"]] == winnowed(grams, 4)


def test_shared_passage_is_found(spark):
    passage = " ".join(f"shared{i}" for i in range(winnow.WINDOW + winnow.K - 1))
    df = spark.createDataFrame([(1, "some words before " + passage), (2, passage + " and other words after it"), (3, "nothing of that kind")], "doc_id long, text string")
    a, b, c = (set(r[0]) for r in df.orderBy("doc_id").select(winnow.hashes(winnow.selected(F.col("text")))).collect())
    assert a & b and not c & (a | b)


def test_edited_texts(odd, empty, spark):
    rows = [(i * 3, t) for i, t in enumerate(["", "a", "é😀 long text with more than twenty words " * 4, None, "xyz " * 700, "tail"])]
    got = {r.doc_id: r for r in winnow.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    for i, (doc, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[:len(text) - half] + ordered[(i + 1) % len(ordered)][1][:half]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[doc].n_chars == len(text)
        assert 0 <= got[doc].near_edited <= 1 and (edited != text or got[doc].near_edited == 1 and got[doc].fingerprint == got[doc].edited_fingerprint)
    assert winnow.fingerprint_report(odd).count() == odd.count() and winnow.fingerprint_report(empty).count() == 0


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(winnow, "ROWS", 3)
    ids = [-50, -3, 0, 1, 2, 900, 901, 5000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next.text for r in winnow.with_next(df, "text").collect()}
    assert got == {d: f"t{ids[k - 1]}" for k, d in enumerate(ids)}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[40:60] = x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [1.0, None] * 8), (1100, [1.0] * 3), (None, [1.0] * 16)]
    got = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    found, right = {}, 0
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    for q, near in found.items():
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        right += len(set(best) & {v for v, _ in near})
        assert [s for _, s in near] == [score[v] for v, _ in near] and near == sorted(near, key=lambda p: (-p[1], p[0]))
    assert right / (20 * len(found)) >= 0.9
    few = mih.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert mih.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_radius_search_is_complete():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (300, mih.PARTS), dtype=np.uint16)
    index = mih.Index(codes)
    for radius in (0, 90, 110, 128, 256):
        query = codes[5] ^ np.uint16(1)
        assert set(index.within(query, radius)) == set(np.flatnonzero(mih.distances(codes, query) <= radius))


def test_rows_of_one_id_are_candidates_each(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(7, [9.0] * 8), (7, [-9.0] * 8), (20, [1.0, -2.0, 3.0, 0.5, 1.0, 1.0, 0.0, 4.0])]
    rows.append(rows[40])
    found = {}
    for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    want = {}
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0 and (i, v) not in rows[:q]:
            best = sorted((-float(np.dot(v, w)), j) for k, (j, w) in enumerate(rows) if k != q)[:5]
            want.setdefault(i, []).extend((n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(best))
    assert {i: sorted(r) for i, r in found.items()} == {i: sorted(r) for i, r in want.items()}
