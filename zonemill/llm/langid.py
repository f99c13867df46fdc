"""Language of texts: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the lower-cased text, with everything but letters taken as a space, as shares of all
trigrams of the text. The machines are fitted on the driver from a bounded sample (``SAMPLE`` documents a language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonemill.llm import text as kernel
from zonemill.llm.store import extended, small_batches
from zonemill.llm.worker import lean

SAMPLE = 500  # documents a language that the machines are fitted on, at most
SLOTS = 1 << 14
COST = 10.0
LETTER = regex.compile(r"\p{L}")
# families of languages by ISO 639-1 code: fixed values; other codes are families of their own
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af", "romance": "fr es pt it ro ca gl", "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz", "semitic": "ar he mt", "indic": "hi ur bn mr ne pa gu",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_SHAPE = np.full(256, 32, np.uint8)
_SHAPE[97:123] = np.arange(97, 123)
_SHAPE[65:91] = np.arange(97, 123)
_SHAPE[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all trigrams of rows ``low`` to ``high`` (two spaces lie between texts) and row borders; none is empty."""
    raw = data[offsets[low]:offsets[high]].tobytes()
    at = offsets[low:high + 1] - offsets[low]
    joined = b"  " + b"  ".join(raw[i:j] for i, j in zip(at[:-1], at[1:])) + b"  "
    b = _SHAPE[np.frombuffer(joined, np.uint8)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
    # a text of n bytes has n + 2 trigrams, whose middle is one of its bytes or a space beside it
    return slot, at + 2 * np.arange(len(at))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.buffers(batch.column("text"))
        for low, high in kernel.slices(offsets):
            slot, borders = trigrams(data, offsets, low, high)
            cells = [np.unique(slot[i:j], return_counts=True) for i, j in zip(borders[:-1], borders[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(low, high - low), pa.array([c[0].astype("<i4").tobytes() for c in cells], pa.binary()), pa.array([c[1].astype("<i4").tobytes() for c in cells], pa.binary())], ["lang", "slots", "counts"])


def machine(gram: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Dual coordinate descent for a linear SVM with bias, from inner products; returns the weight of every row."""
    a, f = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            new = min(max(a[i] + (1 - y[i] * f[i]) / gram[i, i], 0.0), COST)
            step = new - a[i]
            if abs(step) > 1e-9:
                f += step * y[i] * gram[i]
                a[i], moved = new, max(moved, abs(step))
        if moved < 1e-4:
            break
    return a * y


@dataclass
class Machines:
    """Columns of ``weights``: first the families (one against the others), then the pairs within each."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        sure = 1 / (1 + np.exp(-np.clip(2 * margins, -30, 30)))
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1) if n > 1 else np.zeros(len(margins), np.int64)
        score = sure[np.arange(len(margins)), family] if n > 1 else np.ones(len(margins))
        names = np.empty(len(margins), object)
        for k, name in enumerate(self.families):
            mine = np.flatnonzero(family == k)
            members = [x for x in self.languages if FAMILY.get(x, x) == name]
            votes, worst = np.zeros((len(mine), len(members))), np.ones((len(mine), len(members)))
            for j, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = sure[mine, n + j]
                    for x, q in ((a, p), (b, 1 - p)):
                        i = members.index(x)
                        votes[:, i] += (q >= 0.5) + q * 1e-3
                        worst[:, i] = np.minimum(worst[:, i], q)
            best = votes.argmax(axis=1)
            names[mine] = np.array(members, object)[best]
            score[mine] *= worst[np.arange(len(mine)), best]
        return names.tolist(), score


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Machines | None:
    """Fit on at most ``sample`` documents of each language (by a hash of doc_id) among those where ``learn`` holds; None without any."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    chosen = None
    for name in languages:  # ids first: texts of the sample only are fetched
        part = known.where(F.col("lang") == name).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = [r["doc_id"] for r in chosen.collect()]
    rows = known.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted({i for i in ids if i is not None})] or [(None,)], "doc_id long")), "doc_id", "left_semi")
    rows = rows.select("lang", "text").mapInArrow(lean(_sparse), "lang string, slots binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["slots"], r["counts"]))
    if not rows:
        return None
    x = np.zeros((len(rows), SLOTS), np.float32)
    for i, r in enumerate(rows):
        count = np.frombuffer(r["counts"], "<i4")
        x[i, np.frombuffer(r["slots"], "<i4")] = count / count.sum()
    scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-7)
    x *= scale
    size = np.sqrt(np.einsum("ij,ij->", x, x) / len(x))
    x /= size
    gram = (x @ x.T).astype(np.float64) + 1.0  # with a constant column for the bias
    labels = np.array([r["lang"] for r in rows])
    kin = np.array([FAMILY.get(v, v) for v in labels])
    families = sorted({str(k) for k in kin})
    pairs = [(a, b) for i, a in enumerate(languages) for b in languages[i + 1:] if FAMILY.get(a, a) == FAMILY.get(b, b)]
    columns, bias = [], []
    tasks = [(np.arange(len(rows)), np.where(kin == f, 1.0, -1.0)) for f in families]
    tasks += [(s := np.flatnonzero((labels == a) | (labels == b)), np.where(labels[s] == a, 1.0, -1.0)) for a, b in pairs]
    for subset, y in tasks:
        dual = machine(gram[np.ix_(subset, subset)], y) if len(set(y)) > 1 else np.zeros(len(y))
        weight = np.zeros(SLOTS)
        for low in range(0, len(subset), 256):  # a copy of all rows in double precision would be the largest thing here
            weight += dual[low:low + 256] @ x[subset[low:low + 256]]
        columns.append(weight * scale / size)
        bias.append(dual.sum())
    return Machines(languages, families, pairs, np.array(columns, np.float32).T.copy(), np.array(bias))


def _identified(batches: Iterator[pa.RecordBatch], model: Machines | None) -> Iterator[pa.RecordBatch]:
    ascii_letters = np.zeros(256, bool)
    ascii_letters[[*range(65, 91), *range(97, 123)]] = True
    for batch in batches:
        column = batch.column("text")
        data, offsets = kernel.buffers(column)
        names: list[str] = []
        scores: list[np.ndarray] = []
        for low, high in kernel.slices(offsets):
            if model is None:
                names += ["und"] * (high - low)
                scores.append(np.zeros(high - low))
                continue
            slot, borders = trigrams(data, offsets, low, high)
            margins = np.stack([np.add.reduceat(w[slot], borders[:-1], dtype=np.float64) for w in model.weights.T], axis=1) / np.diff(borders)[:, None] + model.bias
            found, score = model.predict(margins)
            at = offsets[low:high + 1]
            total = np.concatenate([[0], np.cumsum(ascii_letters[data[at[0]:at[-1]]])])
            for i in np.flatnonzero(total[at[1:] - at[0]] == total[at[:-1] - at[0]]):
                if not LETTER.search(column[low + int(i)].as_py() or ""):
                    found[i], score[i] = "und", 0.0
            names += found
            scores.append(score)
        keep = [i for i, name in enumerate(batch.schema.names) if name not in ("lang_pred", "lang_score")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*(batch.schema.names[i] for i in keep), "lang_pred", "lang_score"])


def identified(docs: DataFrame, model: Machines | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; ``und`` with score 0 for null texts, texts without letters, or without a model."""
    schema = extended(docs, lang_pred="string", lang_score="double")
    return small_batches(docs).mapInArrow(lean(lambda b: _identified(b, model)), schema)
