"""Alignment of two tokenisations against the libraries and plain loops over tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from zonemill.llm import align, tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
OWN = Tokenizer.from_file(BYTES)
OWN.encode_special_tokens = True


def byte_of():
    """The usual table of byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


BYTE_OF = byte_of()


def plain_groups(text):
    if not text:
        return []
    a = OWN.encode(" " + text, add_special_tokens=False).ids
    b = MODEL.encode(text)
    bytes_a = [bytes(BYTE_OF[c] for c in OWN.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends = [{sum(map(len, x[:k + 1])) for k in range(len(x))} if len(x) < 300 else set(np.cumsum(list(map(len, x))).tolist()) for x in (bytes_a, bytes_b)]
    cuts = sorted(ends[0] & ends[1])
    out, at = [([], []) for _ in cuts], [0, 0]
    for side, (ids, sizes) in enumerate(((a, bytes_a), (b, bytes_b))):
        end, g = 0, 0
        for i, s in zip(ids, sizes):
            end += len(s)
            out[g][side].append(i)
            g += end == cuts[g]
    return out


def plain_report(rows):
    groups = [plain_groups(t) for _, t in rows]
    held = Counter(p for g in groups for p in {(a, b) for x, y in g for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = Counter()
    for (doc, _), g in zip(rows, groups):
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out[(doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[p] == top[p[0]] for p in links),
             sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else "")] += 1
    return out


def found(df, size=align.SLICE):
    return Counter(tuple(r) for r in align.report(align.alignments(df, BYTES, PIECES, size), len(MODEL)).collect())


TEXTS = ["", " ", "a", "A  b\n\n c\t\td  ", "it's  we'll x　y ", "é ́x ΑΣ Σ", "a\x1cb \x1d c", "12  345\r\n6 <|endoftext|> <s> </s> <unk> <0x41>", "x" * 300 + " " * 50 + "é" * 100,
         "!? ... -- 😀😀", "a\0b \0", "tail ", "\n", " x\n y", "a  b", "one\ntwo three\n", "a.\nB c\n\nd", "x \ny", "low▁line ▁ x", "▁", "漢字かな交じり文 한국어 текст", "﻿z ​­", "  two", "a\n", "\n\na"]


def test_cached_pieces_are_the_models_own():
    encoder = tokens.PieceEncoder(PIECES)
    assert encoder.cut
    for _ in range(2):
        assert encoder.encode_each([*TEXTS, None]) == [MODEL.encode(t) for t in [*TEXTS, ""]]
    encoder.cut = False
    assert encoder.encode_each(TEXTS) == [MODEL.encode(t) for t in TEXTS]


def test_random_texts_have_the_models_own_pieces():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "be", " ", "\n", "ing", "é", "漢", "1", "▁", "the ", "\t"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert tokens.PieceEncoder(PIECES).encode_each(texts) == [MODEL.encode(t) for t in texts]


def test_components_by_doubling():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n)) for _ in range(2)]
        cuts = np.intersect1d(*ends)
        for got, end in zip(align.components(*ends), ends):
            assert got.tolist() == np.searchsorted(cuts, end).tolist()
    one, two = align.components(np.arange(2, 200002, 2), np.append(np.arange(1, 199999, 2), 200000))
    assert set(one.tolist()) == {0} == set(two.tolist())  # one chain over all tokens


@pytest.mark.parametrize("size, wide, links", [(align.SLICE, align.WIDE, align.LINKS), (40, 2, 3)])
def test_counts_links_and_groups(spark, odd, empty, monkeypatch, size, wide, links):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200 + i, f"running tokenization of {t} unbelievable") for i, t in enumerate(TEXTS)]
    rows = [(d, t[:2000] if t and size == 40 else t) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if size == 40:
        monkeypatch.setattr(align, "WORK", 100)
    assert found(df, size) == plain_report(rows)
    assert align.report(align.alignments(empty, BYTES, PIECES), len(MODEL)).count() == 0


def test_wide_groups_are_paired_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 300)
    first_a, first_b = np.array([0, 1, 250, 251, 400]), np.array([0, 120, 121, 200, 300])
    group_a = np.repeat(np.arange(4), np.diff(first_a))
    doc = np.array([0, 0, 1, 3])
    want = Counter((doc[g], a[i] * 7 + b[j]) for g in range(4) for i in range(first_a[g], first_a[g + 1]) for j in range(first_b[g], first_b[g + 1]))
    for wide, links in ((1 << 12, 1 << 20), (1, 5), (10**9, 50)):
        monkeypatch.setattr(align, "WIDE", wide)
        monkeypatch.setattr(align, "LINKS", links)
        assert Counter({(d, p): n for d, p, n in zip(*align._linked(a, b, group_a, first_a, first_b, doc, 7))}) == want
