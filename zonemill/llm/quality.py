"""Quality of texts: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows (``SAMPLE``), level by level from gradient
histograms, and flattened into arrays in heap order; a batch of documents walks through all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonemill.llm import text as kernel
from zonemill.llm.store import extended, small_batches
from zonemill.llm.worker import lean

SAMPLE = 12_000  # labelled rows that a model is fitted on, at most (about)
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAF = 12  # rows of a leaf, at least
PENALTY = 1.0


def _class_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


CLASSES = {
    "letter": _class_table((65, 90), (97, 122), (128, 255)), "upper": _class_table((65, 90)), "digit": _class_table((48, 57)),
    "stop": _class_table((33, 33), (44, 44), (46, 46), (58, 59), (63, 63)), "sign": _class_table((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 126)),
    "line": _class_table((10, 10)), "high": _class_table((128, 255)),
}
STATISTICS = [*CLASSES, "bytes", "words", "word_mean", "word_sd", "distinct_words", "distinct_shingles", "top_repeat", "end_sign", "no_letter", "upper_words", "distinct_lines", "line_mean"]


def _per_row(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[borders[1:]] - total[borders[:-1]]).astype(np.float64)


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a row, and how often its commonest one occurs."""
    if not len(value):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    top = np.zeros(rows)
    np.maximum.at(top, r[at], runs)
    return np.bincount(r[at], minlength=rows).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> np.ndarray:
    """One row of ``STATISTICS`` per document; documents without words have zeros."""
    s = kernel.Slice(data, offsets, low, high)
    size = np.maximum(np.diff(s.offsets), 1).astype(float)
    words = np.maximum(s.counts, 1).astype(float)
    out = np.zeros((s.rows, len(STATISTICS)))
    masks = {k: t[s.raw] for k, t in CLASSES.items()}
    for i, name in enumerate(CLASSES):
        out[:, i] = _per_row(masks[name], s.offsets) / size
    letters = np.maximum(out[:, 0] * size, 1)
    out[:, 1] *= size / letters
    length = (s.end - s.start).astype(float)
    hashes = s.hashes()
    k = len(CLASSES)
    first = np.concatenate([[0], np.cumsum(s.counts)])
    out[:, k] = np.log1p(np.diff(s.offsets))
    out[:, k + 1] = np.log1p(s.counts)
    mean = _per_row(length, first) / words
    out[:, k + 2] = mean
    out[:, k + 3] = np.sqrt(np.maximum(_per_row(length**2, first) / words - mean**2, 0))
    distinct, top = _distinct(s.row, hashes, s.rows)
    out[:, k + 4], out[:, k + 6] = distinct / words, top / words
    shingles = np.diff(s.shingles()[1])
    out[:, k + 5] = shingles / np.maximum(s.counts - 4, 1)
    letter = np.concatenate([[0], np.cumsum(masks["letter"])])
    upper = np.concatenate([[0], np.cumsum(masks["upper"])])
    inside = letter[s.end] - letter[s.start]
    out[:, k + 7] = _per_row(masks["sign"][s.end - 1] if len(s.end) else length, first) / words
    out[:, k + 8] = _per_row(inside == 0, first) / words
    out[:, k + 9] = _per_row((inside > 1) & (upper[s.end] - upper[s.start] == inside), first) / words
    # a line is known by the sum of its mixed word hashes
    if len(s.start):
        line = np.concatenate([[0], np.cumsum(masks["line"])])[s.start]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (s.row[1:] != s.row[:-1])
        at = np.flatnonzero(new)
        lines = np.bincount(s.row[at], minlength=s.rows)
        kinds, _ = _distinct(s.row[at], np.add.reduceat(kernel.mix(hashes + np.uint64(7)), at), s.rows)
        out[:, k + 10] = kinds / np.maximum(lines, 1)
        out[:, k + 11] = np.log1p(size / np.maximum(lines, 1))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.buffers(batch.column("text"))
        for low, high in kernel.slices(offsets):
            x = statistics(data, offsets, low, high)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


@dataclass
class Trees:
    """Trees in heap order: children of node i are 2i + 1 and 2i + 2; leaves lie at ``DEPTH``."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic gradient boosting on binned columns; without rows of both labels the model is the share of label 1."""
    inner = 2**DEPTH - 1
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])  # bin b: at most edge b
    total = np.full(len(y), start)
    features, limits, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-9)
            for f in range(len(bins)):
                key = (node - first) * BINS + bins[f]
                sums = [np.cumsum(np.bincount(key, w, wide * BINS).reshape(wide, BINS), axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + PENALTY) + (gt - gl)**2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                gain = np.where((nl >= LEAF) & (nt - nl >= LEAF), gain, 0)[:, :len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                top = gain[np.arange(wide), at]
                for n in np.flatnonzero(top > best):
                    best[n], feature[first + n], limit[first + n] = top[n], f, edges[f][at[n]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + PENALTY)
        total += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(start, np.array(features), np.array(limits), np.array(values))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Trees:
    """Fit on about ``sample`` labelled rows of both kinds, chosen by a hash of doc_id among those where ``learn`` holds."""
    known = labels.where(learn & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    part = F.lit(False)
    for label, n in sizes.items():
        share = min(1.0, sample / 2 / n)
        part = part | ((F.col("label") == label) & (F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= min(int(share * 2**63), 2**63 - 1)))
    chosen = known.where(part)  # about ``sample`` rows of two numbers: small for certain
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("double")).mapInArrow(lean(_measured), "label double, x array<double>").toPandas()
    # the order of rows must not change the model
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(STATISTICS))
    y = rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def _scored(batches: Iterator[pa.RecordBatch], model: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.buffers(batch.column("text"))
        scores = [model.score(statistics(data, offsets, low, high)) for low, high in kernel.slices(offsets)]
        score = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
        keep = [i for i, name in enumerate(batch.schema.names) if name != "quality_score"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), score], [*(batch.schema.names[i] for i in keep), "quality_score"])


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher is better). Null and empty texts are scored by zero statistics."""
    schema = extended(docs, quality_score="double")
    return small_batches(docs).mapInArrow(lean(lambda b: _scored(b, model)), schema)
