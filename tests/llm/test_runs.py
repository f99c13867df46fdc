"""Periodic runs against plain code that looks at every period of every document."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from zonemill.llm import runs


def plain_runs(words, least=24, times=3):
    n, found = len(words), {}
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, n // times + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        starts, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e + q - s >= max(least, times * q):
                found.setdefault((s, e + q - s), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_report(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def found(df):
    return Counter(tuple(r) for r in runs.report(runs.periodic_runs(runs.repeated_tails(df))).collect())


def test_the_cover_meets_every_pair():
    assert all(runs.IN_COVER[(a + runs.SHIFT[a, b]) % runs.V] and runs.IN_COVER[(b + runs.SHIFT[a, b]) % runs.V] for a in range(runs.V) for b in range(runs.V))


@pytest.mark.parametrize("least, times, seed", [(24, 3, 1), (6, 2, 2), (30, 4, 3), (1, 2, 4)])
def test_runs_of_small_alphabets(least, times, seed):
    rng = random.Random(seed)
    docs = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab") * 40, list("abcdefghijk") * 3, list("aab") * 30 + list("aba") * 30]
    for _ in range(150):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 90))]
        for _ in range(rng.randrange(3)):
            at, q = rng.randrange(len(words)), rng.randrange(1, 30)
            words[at:at] = (words[at:at + q] or ["z"]) * rng.randrange(2, 8)
        docs.append(words)
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    doc, start, length, period = runs.find_runs(ids, np.array([len(d) for d in docs]), least, times)
    got = [[] for _ in docs]
    for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(r))
    assert got == [sorted(plain_runs(d, least, times), key=lambda r: (r[0], r[2])) for d in docs]


def test_extensions_of_long_repeats():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, 700)
    ids = np.concatenate([base, base, base[:100], rng.integers(0, 3, 50), base])
    words, ahead, back, begin = runs._laid_out(ids, np.array([len(ids) - 300, 300]))
    right = runs.Extensions(words, ahead)
    right.sort()
    i = rng.integers(1, len(ids) - 302, 4000)
    j = np.minimum(i + rng.choice([1, 5, 700, 1400, 1550], 4000), len(ids) - 300)
    i, j = i[i < j], j[i < j]
    want = [next(k for k in range(5000) if words[a + k] != words[b + k]) for a, b in zip(i, j)]
    assert right(i, j).tolist() == want


def test_odd_and_empty(spark, odd, empty):
    more = [(i, random.Random(i).choice(["la ", "a b\t", "x y z \n"]) * (i % 40) + "tail of it " * (i % 7)) for i in range(300)] + [(5, None), (11, "É é\x0b" * 30), (None, "w " * 30)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + more
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert found(df) == Counter(plain_report(d, t) for d, t in rows)
    assert runs.periodic_runs(empty).count() == 0


def test_slices_do_not_matter(spark, monkeypatch):
    text = " ".join(random.Random(4).choice("abcd") for _ in range(300))
    rows = [(i, f"{text} " * (1 + i % 5)) for i in range(40)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert got == Counter(plain_report(d, t) for d, t in rows)
