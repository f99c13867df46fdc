"""Exact duplicates against plain grouping, with budgets so small that subtrees are written out many times."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from zonemill.llm import owners


def expected(rows):
    normal = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = defaultdict(list)
    for d, t in normal:
        groups[t].append(d)
    out, taken = Counter(), set()
    for d, t in sorted(normal, key=lambda p: (p[0] is None, p[0] or 0)):
        keep = min(groups[t], key=lambda x: (x is None, x or 0))
        out[(d, keep, len(groups[t]), t not in taken, hashlib.sha256(t.encode()).hexdigest())] += 1
        taken.add(t)
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_trie_leaves_and_eviction():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 9, 40]))) for _ in range(3000)]
    trie, seen = owners.Trie(), set()
    for t in texts:
        node = trie.leaf(t)
        assert (node.owner is not None) == (t in seen)
        node.owner = [0]
        seen.add(t)
    assert {t for r in trie.roots.values() for t, _ in trie.leaves(r, b"")} == seen
    out = [t for t, _ in trie.evict(trie.held // 3)]
    kept = {t for r in trie.roots.values() for t, _ in trie.leaves(r, b"")}
    assert len(out) == len(set(out)) and not kept & set(out) and kept | set(out) == seen and kept
    assert all((trie.leaf(t) is None) == (t in out) for t in seen)
    list(trie.evict(0))
    assert [t for r in trie.roots.values() for t, _ in trie.leaves(r, b"")] == texts[:1]


def test_odd_and_empty(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(owners.exact_duplicates(odd)) == expected(rows)
    assert owners.exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("local, budget, target", [(1 << 30, 1 << 30, 1 << 30), (4000, 3000, 5000), (1, 1, 2000)])
def test_groups_do_not_depend_on_budgets(spark, local, budget, target):
    rng = random.Random(11)
    base = ["common  prefix " * k + rng.choice(["x", "y\t", "z "]) * k for k in range(40)] + ["q" * 5000 + c for c in "abc"]
    rows = [(rng.choice([None, *range(300)]), (rng.choice([*base, base[7], base[7], ""]).replace(" ", rng.choice([" ", "\n", " \t "])) or None)) for _ in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(owners.exact_duplicates(df, local, budget, target)) == expected(rows)


def test_equal_hashes_do_not_make_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(owners.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(i, t) for i, t in enumerate(["ab", "ba", "ab", "aa", "bb", "ba", "ab "])]
    assert found(owners.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
