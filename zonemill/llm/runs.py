"""Maximal periodic runs of words by longest common extensions over a difference cover.

Suffixes are sorted only at positions whose remainder by ``V`` lies in ``COVER``. Any two positions reach such a pair
together within ``V`` words, so an extension compares these few words and takes the rest as a range minimum over the
common prefixes of neighbouring sorted suffixes (sparse table). Runs come from a harmonic grid: a run of period q and
``length`` words holds ``length - q`` consecutive positions whose word equals the one q words on, so points as far apart as
the shortest allowed stretch meet every run, about n·log n points in all. Documents are cut into slices of about
1 MB (one document at least), all documents of a slice are worked on together, and suffixes are sorted only for
documents in which an extension passes the words compared at first.

A null text has no words; null and repeated doc_ids are documents like others, rows with a null text or no words
have no runs and an empty collapsed text. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonemill.llm.store import small_batches
from zonemill.llm.text import Slice, buffers, gathered, slices

V = 21
COVER = np.array([0, 1, 4, 14, 16])  # every difference mod 21 is one of two members: a perfect difference set
POINTS = 1 << 20  # grid points looked at together
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
IN_COVER = np.isin(np.arange(V), COVER)
# words from two remainders to the next pair of sampled positions
SHIFT = np.array([[next(d for d in range(V) if IN_COVER[(a + d) % V] and IN_COVER[(b + d) % V]) for b in range(V)] for a in range(V)], np.int64)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 0."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(key) else 0
    return rank


class Extensions:
    """Longest common extensions to the right in words of several documents, each followed by a mark of its own."""

    def __init__(self, words: np.ndarray, place: np.ndarray):
        """``words`` with unique marks between the documents, ``place`` the position within the document."""
        self.words, self.place = words, place % V
        self.rank = None

    def few(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words equal ahead of the next sampled pair, and whether all of those are. ``i < j`` in one document."""
        shift = SHIFT[self.place[i], self.place[j]]
        length = shift.copy()
        at = np.arange(len(i))
        for k in range(V):
            at = at[shift[at] > k]
            if not len(at):
                break
            same = self.words[i[at] + k] == self.words[j[at] + k]
            length[at[~same]] = k
            at = at[same]
        return length, length == shift

    def sort(self) -> None:
        """Sort the sampled suffixes and build the range minima."""
        n = len(self.words)
        rank = _ranks(self.words)
        for step in (1, 2, 4, 8):  # blocks of 16 words
            ahead = np.zeros(n, np.int64)
            ahead[:n - step] = rank[step:] + 1
            rank = _ranks(rank * (n + 1) + ahead)
        sample = np.flatnonzero(IN_COVER[self.place])
        m = len(sample)
        number = np.full(n + 1, -1, np.int64)
        number[sample] = np.arange(m)
        ahead = np.minimum(sample + V - 16, n - 1)
        levels = [_ranks(rank[sample] * (n + 1) + rank[ahead])]  # blocks of V words
        step = V
        while levels[-1].max(initial=0) + 1 < m:
            last = levels[-1]
            following = number[np.minimum(sample + step, n)]
            levels.append(_ranks(last * (m + 1) + np.where(following < 0, 0, last[following] + 1)))
            step *= 2
        order = np.empty(m, np.int64)
        order[levels[-1]] = np.arange(m)
        a, b = sample[order[:-1]], sample[order[1:]]
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][number[a]] == levels[k][number[b]]
            grow = np.where(same, V << k, 0)
            a, b, common = a + grow, b + grow, common + grow
        at = np.arange(len(a))
        for k in range(V):
            at = at[self.words[np.minimum(a[at] + k, n - 1)] == self.words[np.minimum(b[at] + k, n - 1)]]
            if not len(at):
                break
            common[at] += 1
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[sample] = levels[-1]
        table = [common.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(common):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.least = np.full((len(table), max(len(common), 1)), 0, np.int32)
        for k, row in enumerate(table):
            self.least[k, :len(row)] = row

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        length, open_ = self.few(i, j)
        if not open_.any():
            return length
        a, b = self.rank[i[open_] + length[open_]], self.rank[j[open_] + length[open_]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the binary logarithm
        length[open_] += np.minimum(self.least[k, low], self.least[k, high - (np.int64(1) << k)])
        return length


def _laid_out(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with marks around every document, positions within documents from both sides, and where documents begin."""
    docs = len(counts)
    begin = np.concatenate([[0], np.cumsum(counts + 1)]) + 1
    total = int(begin[-1])
    words = np.empty(total, np.int64)
    row = np.repeat(np.arange(docs), counts)
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[row] + inside
    words[at] = ids
    marks = begin - 1
    words[marks] = -1 - np.arange(docs + 1)
    ahead, back = np.zeros(total, np.int64), np.zeros(total, np.int64)
    ahead[at], back[at] = inside, counts[row] - 1 - inside
    ahead[marks[1:]], back[marks[:-1]] = counts, counts
    return words, ahead, back[::-1], begin[:-1]


def _points(counts: np.ndarray, begin: np.ndarray, docs: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Grid points of ``docs``, about ``POINTS`` at a time: document, period, stretch that a run needs, position."""
    number = np.where(counts[docs] >= least, counts[docs] // times, 0)
    doc = np.repeat(docs, number)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + 1
    stretch = np.maximum(least - period, (times - 1) * period)
    points = -(-(counts[doc] - period) // stretch)
    total = np.concatenate([[0], np.cumsum(points)])
    low = 0
    while low < len(doc):
        high = max(low + 1, int(np.searchsorted(total, total[low] + POINTS, "right")) - 1)
        part = np.repeat(np.arange(low, high), points[low:high])
        step = np.arange(total[low], total[high]) - total[part]
        yield doc[part], period[part], stretch[part], begin[doc[part]] + step * stretch[part]
        low = high


def find_runs(ids: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """Runs of all documents: document, start, length, period; ordered by document, start and period.

    ``ids`` are the words of all documents one after the other, ``counts`` their numbers. A run is a stretch of smallest
    period q and at least ``max(least, times * q)`` words that no neighbouring word extends; ``times`` is 2 or more.
    """
    words, ahead, back, begin = _laid_out(ids, counts)

    def pairs(kind, words, i, j):  # to the right from (i, j); to the left as to the right in the reversed words
        right, left = kind
        n = len(words)
        return right(i, j), left(n - j, n - i)

    right, left = Extensions(words, ahead), Extensions(words[::-1], back)
    wanted = np.zeros(len(counts), bool)
    for doc, period, stretch, at in _points(counts, begin, np.arange(len(counts)), least, times):
        same = np.flatnonzero(words[at] == words[at + period])
        (f, more), (b, more_b) = pairs((right.few, left.few), words, at[same], at[same] + period[same])
        wanted[doc[same][more | more_b | (f + b >= stretch[same])]] = True
    docs = np.flatnonzero(wanted)
    if not len(docs):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    ids, counts = ids[np.repeat(wanted, counts)], counts[docs]
    words, ahead, back, begin = _laid_out(ids, counts)
    right, left = Extensions(words, ahead), Extensions(words[::-1], back)
    right.sort()
    left.sort()
    found = []
    for doc, period, stretch, at in _points(counts, begin, np.arange(len(docs)), least, times):
        same = np.flatnonzero(words[at] == words[at + period])
        doc, period, stretch, at = doc[same], period[same], stretch[same], at[same]
        f, b = pairs((right, left), words, at, at + period)
        long = f + b >= stretch
        rows = np.stack([doc, at - b - begin[doc], f + b + period, period])[:, long]
        found.append(np.unique(rows, axis=1))
    doc, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    first = np.ones(len(doc), bool)  # of equal stretches the one of the smallest period; the others are its multiples
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = doc[first], start[first], length[first], period[first]
    order = np.lexsort((period, start, doc))
    return docs[doc[order]], start[order], length[order], period[order]


def _collapsed(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for low, high in slices(offsets):
            part = Slice(data, offsets, low, high)
            plain, borders = gathered(part.raw, part.start, part.end - part.start)
            words = pa.Array.from_buffers(pa.large_binary(), len(part.start), [None, pa.py_buffer(borders), pa.py_buffer(plain)])
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            doc, start, length, period = find_runs(ids, part.counts, least, times)
            first = np.concatenate([[0], np.cumsum(part.counts)])
            # words after a run's first period are dropped
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, first[doc] + start + period, 1)
            np.add.at(change, first[doc] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            row = part.row[kept]
            last = np.ones(len(kept), bool)
            last[:-1] = row[1:] != row[:-1]
            text, place = gathered(np.append(part.raw, np.uint8(32)), part.start[kept], part.end[kept] - part.start[kept] + ~last)
            text[place[1:][~last] - 1] = 32
            ends = place[np.searchsorted(row, np.arange(part.rows + 1))]
            number = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.rows))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(number), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
            collapsed = pa.Array.from_buffers(pa.large_string(), part.rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(part.counts, pa.int64()), runs, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the words outside of runs and
    those of each run's first period, joined by one space. ``least`` words and ``times`` periods make a run."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(lambda b: _collapsed(b, least, times), RUNS)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic tails planted: for h = crc32(doc_id as text), g = h div 10, texts of n > 0 words with h mod 10 = 0
    get word a + (i-a) mod p in place of each word i >= a, where a = g mod n and p = 1 + (n-a) div (3 + g mod 8)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    text = F.expr("array_join(concat(slice(words, 1, a), transform(sequence(a, n - 1), i -> words[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def report(runs: DataFrame) -> DataFrame:
    """Digests of ``periodic_runs``: number of runs, the run of greatest length/period (ties: smallest start, then period), hashes."""
    best = F.aggregate("runs", F.expr("cast(null as struct<start: bigint, length: bigint, period: bigint>)"),
                       lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
