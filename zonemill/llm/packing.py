"""Mixture-controlled packing of documents into token sequences.

Every source is a queue of documents. Windows of ``window`` tokens are filled by deficit round-robin: with each window a
source is credited its share of the window, serves whole tokens up to its credit and carries the rest (its deficit, under
one token) to the next. An exhausted source leaves its share to the others. After k windows a source has therefore served
``floor`` of its credit so far, an exact closed form of the totals per source; so every document finds its windows from
its place in its queue alone, and deficits carry over windows and partitions without a sequential pass. In a window
documents stay together source by source; the stream of windows is cut every ``length`` tokens, gaps never occur, and only
the very last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonemill.llm.store import small_batches, stored
from zonemill.llm.tokens import encoder, parts, with_end
from zonemill.llm.worker import lean

BASES = 100_000  # rows of (task, queue) that are broadcast
TOKENISED = "task int, queue string, before long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window long, ids binary"


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Ids of every document and its place in its source's queue within this task."""
    task, served = TaskContext.get().partitionId(), {}
    for batch in batches:
        for part in parts(batch):
            ids, borders = with_end(*encoder(path).encode(part.column("text")), end)
            sizes, before = np.diff(borders), []
            for queue, n in zip(part.column("queue").to_pylist(), sizes.tolist()):
                before.append(served.get(queue, 0))
                served[queue] = before[-1] + n
            coded = pa.array([_narrow(ids[i:j]) for i, j in zip(borders[:-1], borders[1:])], pa.binary())
            yield pa.RecordBatch.from_pydict({"task": pa.array([task] * len(sizes), pa.int32()), "queue": part.column("queue"), "before": pa.array(before, pa.int64()), "doc_id": part.column("doc_id"), "doc_tokens": pa.array(sizes, pa.int64()), "ids": coded})


def _narrow(ids: np.ndarray) -> bytes:
    """Ids of small vocabularies in two bytes; the leading byte says which."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


class Mixture:
    """What each queue has served after k windows."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, window: int):
        weights = weights or {}
        self.names = sorted(totals)
        self.place = {name: i for i, name in enumerate(self.names)}
        self.totals = [totals[n] for n in self.names]
        self.window, self.total = window, sum(self.totals)
        self.weights = [Fraction(weights[n]) if n in weights else Fraction(t, max(self.total, 1)) for n, t in zip(self.names, self.totals)]
        if any(w <= 0 for w in self.weights):
            raise ValueError("weights have to be positive: every document is packed")
        # phases: from served tokens and credit time on, the queues that are left share by weight
        self.phases, served, time = [], Fraction(0), Fraction(0)
        left = sorted(range(len(self.names)), key=lambda i: Fraction(self.totals[i]) / self.weights[i])
        active = sum(self.weights, Fraction(0))
        for i in left:
            self.phases.append((served, time, active))
            until = Fraction(self.totals[i]) / self.weights[i]
            served, time, active = served + (until - time) * active, until, active - self.weights[i]
        self.served = lru_cache(maxsize=4096)(self._served)

    def _served(self, k: int) -> tuple[list[int], int]:
        goal = k * self.window
        if goal >= self.total:
            return self.totals, self.total
        served, time, active = next(p for p in reversed(self.phases) if p[0] <= goal)
        now = time + (goal - served) / active
        out = [min(t, int(w * now)) for w, t in zip(self.weights, self.totals)]
        return out, sum(out)

    def window_of(self, queue: int, token: int) -> int:
        """The window that serves this token of a queue: bisection on the served counts."""
        low, high = 0, -(-self.total // self.window)
        share = self.totals[queue]
        guess = token * high // max(share, 1)  # exact where targets are the natural shares
        for k in (guess, guess - 1, guess + 1):
            if 0 <= k < high and self.served(k)[0][queue] <= token < self.served(k + 1)[0][queue]:
                return k
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.served(mid)[0][queue] <= token else (low, mid)
        return low

    def spans(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Tokens ``first`` to ``first + n`` of a queue → (window, start within them, length, place in the packed stream)."""
        done = 0
        while done < n:
            k = self.window_of(queue, first + done)
            (low, base), (high, _) = self.served(k), self.served(k + 1)
            turn = k % len(self.names)  # the round starts with another queue in each window
            ahead = range(turn, queue) if queue >= turn else [*range(turn, len(self.names)), *range(queue)]
            place = base + sum(high[i] - low[i] for i in ahead) + first + done - low[queue]
            size = min(n - done, high[queue] - first - done)
            yield k, done, size, place
            done += size


def _cut(batches: Iterator[pa.RecordBatch], mixture: tuple, length: int) -> Iterator[pa.RecordBatch]:
    plan = Mixture(*mixture)
    for batch in batches:
        rows = []
        for queue, before, base, doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("queue", "before", "base", "doc_id", "doc_tokens", "ids"))):
            ids = _wide(data)
            for window, start, size, place in plan.spans(plan.place[queue], base + before, n):
                while size:
                    take = min(size, length - place % length)
                    rows.append((doc, start, take, n, place // length, place % length, window, ids[start:start + take].tobytes()))
                    start, size, place = start + take, size - take, place + take
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "ids"])


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 4096, window: int = 64 * 4096, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, every window near the target proportions of the sources.

    ``weights`` gives target proportions of some sources; the others, by default all, get their share of the tokens. The
    mixture has one entry per source and is held by the driver. Ids are little-endian unsigned 32-bit integers. A null
    text is empty (its piece is the end id alone), a null source is a queue of its own, rows that repeat are packed as
    often as they occur, an empty table gives no pieces. Other columns are ignored.
    """
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("queue")
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text"), queue).mapInArrow(lean(lambda b: _tokenise(b, tokenizer, end), encodes=True), TOKENISED)
    rows = stored(rows, "tokenised")
    shares = rows.groupBy("task", "queue").agg(F.sum("doc_tokens").alias("n"))
    totals = {r["queue"]: r["n"] for r in shares.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    mixture = (totals, {f"={k}": v for k, v in weights.items() if f"={k}" in totals} if weights else None, window)
    ahead = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = shares.select("task", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    # a few numbers per task and queue; where there are too many to send around, the join shuffles
    base = F.broadcast(base) if shares.count() <= BASES else base
    return rows.join(base, ["task", "queue"]).mapInArrow(lean(lambda b: _cut(b, mixture, length)), PIECES)
