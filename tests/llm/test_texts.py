"""Token ids, packing, archives, personal data, language and quality against plain code and round trips."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonemill.llm import langid, lattice, packing, pii, quality, simple8b, tokens, warc

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def ids_of(path, text):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_cached_ids_are_the_tokenizers_own(path):
    texts = ["", " ", "a", "A  b\n\n c\t\td  ", "it's  we'll x　y ", "é ́x ΑΣ Σ", "a\x1cb \x1d c", "12  345\r\n6 <|endoftext|>", "x" * 300 + " " * 50 + "é" * 100, "!? ... -- 😀😀", "a\0b \0", "tail ", "\n", " x\n y", "a\u2003 b", "one\ntwo three\n", "a.\nB c\n\nd", "a.\nB c\nD", "x \ny"]
    encoder = tokens.Encoder(path)
    for _ in range(2):
        assert encoder.encode_each([*texts, None]) == [ids_of(path, t) for t in [*texts, ""]]


def test_simple8b_round_trip():
    rng = np.random.default_rng(4)
    for ids in ([], [0], [2**60, 5, 2**64 - 1], [0] * 700, rng.integers(0, 50257, 5000), rng.integers(0, 3, 3000), 2 ** rng.integers(0, 63, 2000), [1] * 511 + [2**61] + [7] * 600):
        ids = np.array(ids, np.uint64)
        words, blocks = simple8b.encode(ids)
        assert (simple8b.decode(words, blocks, len(ids)) == ids).all()
    assert len(simple8b.encode(np.ones(600, np.uint64))[0]) <= 12


def test_token_files(spark, odd, empty, tmp_path):
    simple8b.write(odd, f"{tmp_path}/a", BYTES)
    got = sorted(simple8b.read(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda p: (p[0] is not None, p[0], p[1]))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = ids_of(BYTES, text) + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    simple8b.write(empty, f"{tmp_path}/b", BYTES)
    assert simple8b.read(spark, f"{tmp_path}/b").count() == 0


def check_pieces(pieces, docs, length):
    by_place, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_place[p.sequence_id].append((p.offset, p.length))
        by_doc[(p.doc_id, p.doc_tokens)].append((p.start, p.length, bytes(p.ids)))
    assert sorted(by_place) == list(range(len(by_place)))
    for sequence, parts in by_place.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or sequence == max(by_place) and at <= length
    whole = sorted((d or -1, len(ids_of(WORDS, t)) + 1) for d, t in docs)
    covered = sorted((d or -1, sum(n for _, n, _ in parts)) for (d, _), parts in by_doc.items())
    assert sum(n for _, n in whole) == sum(n for _, n in covered)
    return by_doc


def test_packing(odd, empty):
    rows = odd.where("doc_id is null or doc_id <> 2").collect()
    by_doc = check_pieces(packing.pack(odd.where("doc_id is null or doc_id <> 2"), WORDS, length=64, window=256).collect(), [(r.doc_id, r.text) for r in rows], 64)
    for r in rows:
        ids = ids_of(WORDS, r.text) + [2]
        parts = sorted(by_doc[(r.doc_id, len(ids))])
        assert np.frombuffer(b"".join(p[2] for p in parts), "<u4").tolist() == ids and [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts[:-1]]]).tolist()
    check_pieces(packing.pack(odd, WORDS, length=64, window=256).collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert packing.pack(empty, WORDS).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 5}])
def test_windows_keep_the_mixture(weights):
    totals = {"a": 10_000, "b": 4_321, "c": 77}
    mix = packing.Mixture(totals, weights, 500)
    last = [0, 0, 0]
    for k in range(1, -(-sum(totals.values()) // 500) + 1):
        served, total = mix.served(k)
        assert total == sum(served) and 0 <= min(k * 500, sum(totals.values())) - total < 3
        assert all(a <= b <= t for a, b, t in zip(last, served, totals.values()))
        last = served
    assert last == list(totals.values())
    whole = sorted(s for q, n in enumerate(totals.values()) for s in ((p, size) for _, _, size, p in mix.spans(q, 0, n)))
    at = 0
    for place, size in whole:
        assert place == at
        at += size
    assert at == sum(totals.values())


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(version):
    head, payload = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\n", b"<p>\n\nWARC/1.1\r\n filedesc://x</p>\n"
    data = warc.arc_version_block(version, "a.arc", "19960801") + b"\n" + warc.arc_record(version, "http://a b/c", "19970102030405", head, payload) + b"\n" + warc.arc_record(version, "dns:x", "19970102", b"", b"") + b"\n"
    got = list(warc.parse_arc(data))
    assert [(g[2], g[4], g[6]) for g in got] == [("http://a b/c", "19970102030405", head + payload), ("dns:x", "19970102", b"")]
    assert warc.split_http(got[0][6]) == (head, payload) and warc.iso("19970102") == "1997-01-02T00:00:00Z"
    for bad in (data[:-10] + b"9", b"http://x 1 2 3 4\n", data.replace(b"filedesc", b"filedisc")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad + b"http://cut 0 1996 text/html 99\nshort"))


def test_archives_round_trip(spark, tmp_path):
    long = "<html>é " + "x" * 1200
    rows = [(5, "http://e", long, 1), (9, "http://a b", long, 2), (7, None, long, 2), (1, "u", "short", 3), (2, "u", "short", 3), (3, "", None, 3), (None, "n", "", None), (4, "w", "a\r\n\r\nb\n" * 200, 1), (6, "w", "😀" * 250, 1), (8, "w", "😀" * 250, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, version int")
    warc.pages_to_arc(pages, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", warc.page_of())
    got = {r.page_id: r for r in warc.page_digests(warc.read_warc(spark, f"{tmp_path}/warc")).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        last = max(p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None) if page is not None else None
        refers = last if len(data) >= 1000 and last != page else None
        assert tuple(got[page])[:5] == (page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers)
    warc.pages_to_arc(pages.limit(0), f"{tmp_path}/arc0")
    warc.convert(spark, f"{tmp_path}/arc0", f"{tmp_path}/warc0", warc.page_of())
    assert warc.read_warc(spark, f"{tmp_path}/warc0").count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_personal_data_spans(spark, odd, empty):
    texts = ["@@a@b@c.d..e.f@g.h", "é+1 (555) 123-4567é 4111-1111-1111-1111 256.1.1.1 1.2.3.4.5.6.7.8 00001.2.3.4", "x@y.z" * 300, "4111 1111 1111 1111 1 2 3", "+1" + "(" * 2000, "1 " * 3000, "1" * 20000, None, "", "a.b%x@c.d-e.%f@g.h", "+123456789+123456789 1.2.3"]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = plain_spans(text or "")
        assert got[i].spans == ",".join(want) and got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
    strange = odd.withColumns({"base": F.lit(1), "extra": F.lit(2), "key": F.lit(3), "base_spans": F.lit(4), "term": F.lit(5)})
    assert pii.sanitised(strange).where("base_spans = 4 and base = 1 and extra = 2").count() == odd.count() == pii.spans(strange).count()
    clean = pii.sanitised(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and pii.sanitised(empty).count() == 0
    assert clean.where("doc_id is null").first().text == "no key here, mail <email>"
    assert clean.where("doc_id = 3").first().text is None


def test_disclosing_terms_go(spark):
    common = "some plain words that everybody writes every day about nothing special"
    rows = [(i, f"{common} number {'abcdefghij'[i % 10]}") for i in range(60)]
    rows += [(100 + i, f"{' '.join(common.split()[i:])} Zanzibar boat@sea.org owner {'kilo lima mike nova oscar'.split()[i]} lives here") for i in range(5)]
    got = {r.doc_id: r for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zanzibar" not in got[100 + i].text and "<email>" in got[100 + i].text and "about" in got[100].text for i in range(5))
    assert all(got[i].text == dict(rows)[i] for i in range(60))


def test_disclosing_terms_far_short_and_with_digits(spark):
    common = "some plain words that everybody writes every day about nothing special"
    rows = [(i, f"{common} number {'abcdefghij'[i % 10]}") for i in range(60)]
    rows += [(100 + i, f"Zanzibar Qi K4711 {f'{common} ' * 40}{'kilo lima mike nova oscar'.split()[i]} {f'{common} ' * 40}boat@sea.org") for i in range(5)]
    rows += [(200 + i, f"Copied {common} ship@sea.org") for i in range(5)]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not set(got[100 + i].split()) & {"Zanzibar", "Qi", "K4711"} and got[100 + i].count(common) == 80 and got[100 + i].endswith("<email>") for i in range(5))
    assert all(got[i] == dict(rows)[i] for i in range(60)) and all(got[200 + i] == f"Copied {common} <email>" for i in range(5))


def test_disclosing_terms_of_rare_entities(spark):
    common = "some plain words that everybody writes every day about nothing special"
    rows = [(i, f"{common} number {'abcdefghij'[i % 10]}") for i in range(200)]
    values = {"Zanzibar": [f"{n}@sea.org" for n in "kilo lima mike".split()], "Qi": ["10.1.2.3", "10.1.2.4", "10.1.2.5"], "Kovac": ["+1 (555) 123-4567", "+1 (555) 123-8901", "+1 (555) 123-2345"]}
    rows += [(1000 + 10 * k + i, f"{name} {common} {'papa quebec romeo'.split()[i]} {v}") for k, (name, vs) in enumerate(values.items()) for i, v in enumerate(vs)]
    rows += [(2000 + i, f"Twice {common} {'sierra tango'.split()[i]} ship@lake.org") for i in range(2)] + [(3000, f"Once {common} uniform boat@river.org")]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(values):
        assert all(name not in got[1000 + 10 * k + i] and common in got[1000 + 10 * k + i] for i in range(3))
    assert all("Twice" not in got[2000 + i] and "<term>" in got[2000 + i] for i in range(2))
    assert got[3000] == f"Once {common} uniform <email>" and all(got[i] == dict(rows)[i] for i in range(200))


def test_language_slots():
    data = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    slot, _ = langid.trigrams(data, np.array([0, len(data)]), 0, 1)
    assert langid.SAMPLE == 500 and langid.SLOTS == 1 << 14 and (1 << 13) <= slot.max() < langid.SLOTS


def test_language(spark, odd, empty):
    words = {"en": "the and of with was", "de": "der und die nicht ein", "fr": "le et les dans une", "es": "el y los para una"}
    rows = [(i, " ".join(words[lang].split()[(i + k) % 5] for k in range(12)), lang) for i in range(160) for lang in [list(words)[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id") < 120)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    got = langid.identified(docs, model).collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.lang_score <= 1 for r in got)
    strange = {r.doc_id: r for r in langid.identified(odd, model).collect()}
    assert [strange[i].lang_pred for i in (3, 4, 6, 7)] == ["und"] * 4 and strange[10].lang_pred != "und" and strange[3].lang_score == 0
    assert langid.train(empty, F.lit(True)) is None and langid.identified(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.identified(empty, model).count() == 0


def test_quality(spark, odd, empty):
    good = "Plain sentences, written with care. They go on for a while and end. "
    rows = [(i, good * (2 + i % 3) if i % 2 else "BUY!! NOW!! $$$ " * (3 + i % 4), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.col("doc_id") < 150)
    assert all((r.quality_score >= 0.5) == (r.doc_id % 2 == 1) for r in quality.scored(docs, model).collect())
    got = quality.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.scored(empty, model).count() == 0
    nothing = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r.quality_score for r in quality.scored(odd, nothing).collect()} == {0.5}


def test_trees_walk_like_plain_code():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float))
    def plain(row):
        total = model.start
        for f, t, v in zip(model.feature, model.limit, model.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(model.score(x), [plain(r) for r in x])


def test_pieces_equal_the_library(spark, odd, empty):
    more = spark.createDataFrame([(100, "-" * 3000), (101, "aerstin" * 60), (102, "  a  b "), (103, "\n\n \n\tx"), (104, "Á😀 一二三 \r\nx")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(r.doc_id), library.encode(r.text or ""), r.text or "") for r in docs.collect())
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in lattice.decode(lattice.encode(docs, PIECES), PIECES).collect())
    assert got == want
    assert lattice.encode(empty, PIECES).count() == 0


def test_small_cache_keeps_ids_right(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 6)
    encoder = tokens.Encoder(BYTES)
    for texts in (["a b c d e", "a b c"], ["a f g h i j k", "b c"], ["a b", "x y z q w e r t"], ["a b c"]):
        assert encoder.encode_each(texts) == [ids_of(BYTES, t) for t in texts]
        assert len(encoder.known) <= 16


def test_many_matches_take_linear_time(spark):
    """A megabyte of matches, valid and not, in seconds; a list of addresses is masked whole."""
    import time
    texts = ["12," * 350_000, "a@b.cd " * 20_000, "1.2.3.4 " * 20_000, "x" * 100_000 + " a@b.cd", "é😀a@b.cd\u0301 +32 475 12 34 56, 1.2.3.4 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in df.select("doc_id", F.size(pii.base_spans(F.col("text"))).alias("n"), F.get(pii.base_spans(F.col("text")), F.lit(0)).alias("first")).collect()}
    assert time.perf_counter() - start < 60
    assert [got[i].n for i in range(5)] == [0, 20_000, 20_000, 1, 3] and (got[3]["first"]["from"], got[3]["first"]["to"]) == (100_001, 100_007)
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == texts[0] and clean[1] == "<email> " * 20_000 and clean[2] == "<ip> " * 20_000 and clean[4] == "é😀<email>\u0301 <phone>, <ip> "


def test_long_terms_are_whole(spark):
    df = spark.createDataFrame([("x" * 500 + " y",)], "text string")
    assert df.select(F.array_sort(pii._terms(F.col("text")))).first()[0] == ["x" * 500, "y"]


def test_texts_of_a_chunk_travel_together():
    batch = pa.RecordBatch.from_pydict({"chunk": [4, -1, 4], "doc_id": [7, None, 5], "text": ["é" * 300, None, "ab"]}).slice(0)
    (got,) = lattice._packed(iter([batch]))
    rows = {c: (ids, list(lattice._texts_of(len(ids), data))) for c, ids, data in zip(*(got.column(i).to_pylist() for i in range(3)))}
    assert rows == {4: ([7, 5], ["é" * 300, "ab"]), -1: ([None], [""])}
    (none,) = lattice._packed(iter([batch.slice(0, 0)]))
    assert none.num_rows == 0
    alike = pa.RecordBatch.from_pydict({"chunk": [1] * 100, "doc_id": list(range(100)), "text": [f"{i} " + "".join(f"w{j} " for j in range(100)) for i in range(100)]})
    (one,) = lattice._packed(iter([alike]))
    assert sum(map(len, one.column("texts").to_pylist())) < 4000  # alone, each takes more than 100 bytes


def test_units_end_where_no_piece_reaches():
    pairs = lattice.load(PIECES).pairs
    texts = ["the,the;the\tthe  thé▁the", None, "", " \n", "thé"]
    batch = pa.RecordBatch.from_pydict({"chunk": [3, 3, 9, 9, 3], "text": texts})
    got = [r for b in lattice._units_of(iter([batch]), 1, pairs) for r in b.to_pylist()]
    assert {r["chunk"]: set(lattice._unpack(r["units"])) for r in got} == {3: {"▁the", "the", "▁▁thé", "▁thé"}, 9: {"▁▁"}}  # none again for what follows a word
    rows, words = lattice.words_of(pa.array(texts))
    assert rows.tolist() == [0, 5, 5, 5, 7, 8] and words.to_pylist() == [" the,the;the", "\t", "the", "  thé", " the", "  ", "\n", " thé"]
    borders, units = lattice.units_of(words.dictionary, pairs)
    cut = [units.to_pylist()[a:b] for a, b in zip(borders[:-1], borders[1:])]
    assert ["".join(x) for x in cut] == [w.replace(" ", lattice.MARK) for w in words.dictionary.to_pylist()] and cut[0] == ["▁the", ",", "the", ";", "the"]


def test_units_of_a_chunk_are_no_python_objects():
    """A chunk holds hundreds of thousands of units; a dictionary of them filled the executor's memory."""
    import tracemalloc
    pairs = lattice.load(PIECES).pairs
    names = ["▁" + "".join("aeinorst"[i >> 3 * k & 7] for k in range(6)) for i in range(200_000)]
    parts = [sorted(names[k::40]) for k in range(40)]
    number = {u: i for i, u in enumerate(names)}
    ids = [zstandard.compress(np.concatenate([np.full(len(p), 2, "<u4"), np.repeat(np.array([number[u] for u in p], "<u4"), 2)]).tobytes()) for p in parts]
    lists = pa.table([pa.array([0] * 40, pa.int64()), pa.array([lattice._pack(p) for p in parts], pa.binary()), pa.array(ids, pa.binary())], schema=lattice.GIVEN)
    docs = pa.Table.from_batches(lattice._packed(iter([pa.RecordBatch.from_pydict({"chunk": [0, 0, 0], "doc_id": [5, None, 6], "text": [names[7][1:] + " " + names[199_999][1:] + "\n", None, "é" + chr(0x10FFFD)]})])))
    tracemalloc.start()
    got = lattice._assemble(docs, lists, {"\n": 13}, list(range(1000, 1256)), np.setdiff1d(pairs, [ord(" ") << 21 | ord("é")])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    bytes_of = [1000 + b for b in ("▁é" + chr(0x10FFFD)).encode()]
    assert [(r["doc_id"], r["n_pieces"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == [(5, 5, [7, 7, 199_999, 199_999, 13]), (None, 0, []), (6, 9, bytes_of)]
    assert peak < 20, peak  # the dictionary alone took 32
