"""Token ids in Simple-8b words: up to 60 ids per 64-bit word, the top four bits tell how many.

Ids are cut into blocks of ``BLOCK``; a block starts with a new word and its place is kept, so all blocks of a row are
coded and decoded side by side. Selector 0 is an escape: the next word is one raw 64-bit id. Selector 1 is a run of 120
zeros. A file row holds whole documents: their ids, lengths, the block places and the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonemill.llm.tokens import encoder, parts, with_end

BLOCK = 512
# ids per word and bits per id by selector: fixed values of the format
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SELECTOR = {int(COUNTS[s]): s for s in range(2, 16)}
FEWER = [max([s for s in range(2, 16) if COUNTS[s] > k], default=1) + 1 for k in range(int(COUNTS[2]) + 1)]  # levels that can still be joined by more ids
FILES = "shard int, part long, before long, doc_ids array<long>, lengths array<long>, blocks array<long>, words binary"


def _levels(ids: np.ndarray) -> np.ndarray:
    return (np.searchsorted(np.uint64(1) << BITS[2:].astype(np.uint64), ids, "right") + 2).astype(np.int8)


LEVELS = _levels(np.arange(1 << 16, dtype=np.uint64))


def _choices(level: np.ndarray, zeros: np.ndarray | None, spot: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The selector of the word that begins at each spot: the one of most ids that all fit. A word ends at ``stop``."""
    choice = np.zeros(len(spot), np.int8)  # escape, if nothing else fits
    highest = np.zeros(len(spot), np.int8)
    lane, left = np.arange(len(spot)), stop - spot
    for k in range(int(COUNTS[2:].max()) + 1):
        over = left[lane] <= k
        if over.any():  # all the rest fits
            ended = lane[over]
            choice[ended] = np.where(highest[ended] < 16, np.maximum(highest[ended], 2), 0)
            lane = lane[~over]
        if not len(lane) or k == COUNTS[2]:
            break
        highest[lane] = np.maximum(highest[lane], level[spot[lane] + k])
        selector = SELECTOR.get(k + 1)
        if selector is not None:
            fits = lane[highest[lane] <= selector]
            choice[fits] = selector
        lane = lane[highest[lane] < FEWER[k + 1]]
    if zeros is not None:  # a short rest is no run
        run = np.flatnonzero(left >= COUNTS[1])
        choice[run[zeros[spot[run] + COUNTS[1]] == zeros[spot[run]]]] = 1
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit ids → words, and the place of every block's first word."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # the first selector whose ids are wide enough; 16 for none
    level = LEVELS[ids] if ids.max() < len(LEVELS) else _levels(ids)
    nothing = ids != 0
    zeros = np.concatenate([np.zeros(1, np.int64), np.cumsum(nothing)]) if n - np.count_nonzero(nothing) >= COUNTS[1] else None
    # all blocks walk from word to word together
    spot = np.arange(0, n, BLOCK)
    end = np.minimum(spot + BLOCK, n)
    lane = np.arange(len(spot))
    starts, lanes, choices = [], [], []
    while len(spot):
        choice = _choices(level, zeros, spot, end[lane])
        starts.append(spot)
        lanes.append(lane)
        choices.append(choice)
        spot = spot + COUNTS[choice]
        on = spot < end[lane]
        spot, lane = spot[on], lane[on]
    start, lane, picked = np.concatenate(starts), np.concatenate(lanes), np.concatenate(choices)
    order = np.argsort(start, kind="stable")
    start, stop, picked = start[order], end[lane[order]], picked[order]
    size = np.where(picked == 0, 2, 1)
    place = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(place[-1], np.uint64)
    for selector in np.unique(picked):
        mine = np.flatnonzero(picked == selector)
        if selector == 0:
            words[place[mine] + 1] = ids[start[mine]]
            continue
        bits, first, ends = int(BITS[selector]), start[mine], stop[mine]
        word = np.full(len(mine), np.uint64(int(selector) << 60))
        short = np.flatnonzero(first + COUNTS[selector] > ends)  # the last words of blocks
        if selector > 1:
            rest, rest_first, rest_ends = word[short], first[short], ends[short]
            for k in range(COUNTS[selector]):
                word |= ids.take(first + k, mode="clip") << np.uint64(k * bits)
                inside = rest_first + k < rest_ends
                rest |= np.where(inside, ids.take(rest_first + k, mode="clip"), np.uint64(0)) << np.uint64(k * bits)
            word[short] = rest
        words[place[mine]] = word
    firsts = np.searchsorted(start, np.arange(0, n, BLOCK))
    return words, place[firsts]


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of these words."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    real = np.ones(len(words), bool)
    if (selector == 0).any():  # raw words follow escapes: walk through the blocks that may have one
        for b, low in enumerate(blocks):
            high = blocks[b + 1] if b + 1 < len(blocks) else len(words)
            k = low
            while k < high:
                if selector[k] == 0:
                    real[k + 1] = False
                    k += 1
                k += 1
    counts = np.where(real, COUNTS[selector], 0)
    total = np.concatenate([[0], np.cumsum(counts)])
    block = np.searchsorted(blocks, np.arange(len(words)), "right") - 1
    place = total[:-1] - total[blocks][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for kind in np.unique(selector[real]):
        mine = np.flatnonzero(real & (selector == kind))
        if kind == 0:
            out[place[mine]] = words[mine + 1]
        elif kind > 1:
            bits = int(BITS[kind])
            mask = np.uint64((1 << bits) - 1)
            for k in range(COUNTS[kind]):
                inside = place[mine] + k < end[mine]
                out[place[mine][inside] + k] = (words[mine][inside] >> np.uint64(k * bits)) & mask
    return out


def _rows(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    shard, part, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        for rows in parts(batch, 1 << 22):
            ids, borders = with_end(*encoder(path).encode(rows.column("text")), end)
            words, blocks = encode(ids)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int64()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([np.diff(borders)], pa.list_(pa.int64())), "blocks": pa.array([blocks], pa.list_(pa.int64())), "words": pa.array([words.astype("<u8").tobytes()], pa.binary())})
            part, before = part + 1, before + len(ids)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Encode whole texts in ascending doc_id order and write them; shard by shard the files continue that order.

    A null text is empty (its end id alone), null doc_ids come first, rows of one doc_id come in the order of their
    texts, an empty table writes no rows. Other columns are ignored.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda b: _rows(b, tokenizer, end), FILES).write.mode("overwrite").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, docs, lengths, blocks, words, shard in zip(*(batch.column(c).to_pylist() for c in ("before", "doc_ids", "lengths", "blocks", "words", "shard"))):
            borders = np.concatenate([[0], np.cumsum(lengths)])
            ids = decode(np.frombuffer(words, "<u8"), np.array(blocks, np.int64), int(borders[-1])).astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(docs), pa.int32()), "doc_id": pa.array(docs, pa.int64()), "start": pa.array(before + borders[:-1], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids": pa.array([ids[4 * i:4 * j] for i, j in zip(borders[:-1], borders[1:])], pa.binary())})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian, 32 bits)."""
    files = spark.read.schema(FILES).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = files.mapInArrow(_documents, "shard int, doc_id long, start long, n_tokens long, ids binary")
    # one row for each file of the table, whose list the driver holds anyway
    return docs.join(F.broadcast(base), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
