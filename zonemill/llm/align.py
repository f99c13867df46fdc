"""Alignment of two tokenisations of one text by pointer jumping, and links between their ids counted over the corpus.

Tokens of A (byte-level BPE over space+text) and B (SentencePiece over text, which adds the space) cover the same bytes.
Every token points to the farthest-right token that overlaps it; successors are doubled until nothing changes, so every token
knows the last token of its component, the token of B that ends where one of A ends. These number the groups.

Id pairs that share a group are counted in two steps: tasks count documents over slices of about ``SLICE`` bytes of text and keep
each document's pairs as places in the slice's list of pairs; the lists (one row per slice and pair, however frequent
the pair) are summed and joined by pair, and go back to their slices, where they meet the documents again.

Texts that are null or empty, or whose joined token bytes differ from space+text, have no tokens: zeros and empty groups.
Null and repeated doc_ids are documents like others. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonemill.llm.store import small_batches, stored
from zonemill.llm.text import buffers, gathered
from zonemill.llm.tokens import byte_level, encoder, parts

SLICE = 8 << 20  # bytes of text whose pairs are listed together
WORK = 1 << 20  # bytes of text aligned together
LINKS = 1 << 20  # links expanded together
WIDE = 1 << 12  # links of a group from which on its distinct ids are paired instead of its tokens
ALIGNED = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<long>, keys array<long>, documents array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pool:
    """Byte strings by number, one after the other."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.data, self.start[ids], self.length[ids])


@lru_cache(maxsize=2)
def _pools(a: str, b: str) -> tuple[Pool, Pool, Pool]:
    one, two = byte_level(encoder(a)), encoder(b).pieces
    return Pool(one), Pool(two), Pool([b"%d," % i for i in range(max(len(one), len(two)))])


def _spaced(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Space+text of every row that has a text, empty for the others: as an array, its bytes and offsets."""
    data, offsets = buffers(column)
    sizes = np.diff(offsets)
    has = sizes > 0
    begin = np.concatenate([[0], np.cumsum(sizes + has)])
    out = np.empty(begin[-1], np.uint8)
    space = np.zeros(len(out), bool)
    space[begin[:-1][has]] = True
    out[space] = 32
    out[~space] = data[offsets[0]:offsets[-1]]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(begin), pa.py_buffer(out)]), out, begin


def _covering(ids: np.ndarray, borders: np.ndarray, pool: Pool, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose tokens join to exactly their bytes."""
    ends = np.concatenate([[0], np.cumsum(pool.length[ids])])[borders]
    good = np.diff(ends) == np.diff(offsets)
    rows = np.flatnonzero(good)
    if len(rows) == len(good):
        joined, wanted = pool.joined(ids)[0], data
    else:
        joined = pool.joined(ids[np.repeat(good, np.diff(borders))])[0]
        wanted = data[np.repeat(good, np.diff(offsets))]
    different = np.flatnonzero(joined != wanted)
    begin = np.concatenate([[0], np.cumsum(np.diff(offsets)[rows])])
    good[rows[np.searchsorted(begin, different, "right") - 1]] = False
    return good


def components(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and of B, given where the tokens end on one axis of bytes."""
    a = len(end_a)
    over = np.searchsorted(end_b, end_a)  # the token of B that holds a token's last byte
    under = np.searchsorted(end_a, end_b)
    last = end_a[under] == end_b if a else np.zeros(0, bool)
    far = np.concatenate([a + over, np.where(last, a + np.arange(len(end_b)), under)])
    while True:
        farther = far[far]
        if np.array_equal(farther, far):
            break
        far = farther
    number = np.cumsum(last) - 1
    group = number[far - a]
    return group[:a], group[a:]


def _linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) of all links, ordered, with the number of links: documents, pairs, numbers."""
    size_a, size_b = np.diff(first_a), np.diff(first_b)
    top = int(a.max(initial=0) + 1) * width
    found, number = [], []

    def add(keys: np.ndarray, times: np.ndarray) -> None:
        found.append(keys)
        number.append(times)
        if sum(map(len, found)) > 8 * LINKS:
            merge()

    def merge() -> None:
        keys, place = np.unique(np.concatenate(found), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, place, np.concatenate(number) if number else np.zeros(0, np.int64))
        found[:], number[:] = [keys], [times]

    wide = size_a * size_b >= WIDE
    tokens = np.flatnonzero(~wide[group_a])
    total = np.concatenate([[0], np.cumsum(size_b[group_a[tokens]])])
    low = 0
    while low < len(tokens):
        high = max(low + 1, int(np.searchsorted(total, total[low] + LINKS, "right")) - 1)
        part = tokens[low:high]
        group = group_a[part]
        token = np.repeat(np.arange(len(part)), size_b[group])
        other = first_b[group][token] + np.arange(len(token)) - (total[low:high] - total[low])[token]
        keys, times = np.unique(doc[group][token] * top + a[part][token] * width + b[other], return_counts=True)
        add(keys, times)
        low = high
    for group in np.flatnonzero(wide):
        one, times_one = np.unique(a[first_a[group]:first_a[group + 1]], return_counts=True)
        two, times_two = np.unique(b[first_b[group]:first_b[group + 1]], return_counts=True)
        step = max(1, LINKS // len(two))
        for low in range(0, len(one), step):
            add((doc[group] * top + one[low:low + step, None] * width + two).ravel(), (times_one[low:low + step, None] * times_two).ravel())
    merge()
    return found[0] // top, found[0] % top, number[0]


def _written(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, borders: np.ndarray, digits: Pool) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of every document: bytes and borders. ``borders`` counts the tokens of both kinds by document."""
    at_a, at_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + first_a[1:][group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    out, place = digits.joined(ids)
    out[place[at_a[first_a[1:] - 1] + 1] - 1] = ord("|")
    out[place[at_b[first_b[1:] - 1] + 1] - 1] = ord(";")
    ends = place[borders]
    keep = np.ones(len(out), bool)
    some = np.diff(borders) > 0
    keep[ends[1:][some] - 1] = False
    return out[keep], ends - np.concatenate([[0], np.cumsum(some)])


def _tokens(rows: pa.RecordBatch, path_a: str, path_b: str) -> dict[str, np.ndarray | pa.Array]:
    """Counts, group texts and distinct links of the documents of ``rows``."""
    pool_a, pool_b, digits = _pools(path_a, path_b)
    spaced, data, offsets = _spaced(rows.column("text"))
    a, borders_a = encoder(path_a).encode(spaced)
    b, borders_b = encoder(path_b).encode(rows.column("text"))
    a, b = a.astype(np.int64), b.astype(np.int64)
    good = _covering(a, borders_a, pool_a, data, offsets) & _covering(b, borders_b, pool_b, data, offsets)
    size_a, size_b = np.diff(borders_a) * good, np.diff(borders_b) * good
    if not good.all():
        a, b = a[np.repeat(good, np.diff(borders_a))], b[np.repeat(good, np.diff(borders_b))]
    docs = np.arange(len(good))
    group_a, group_b = components(np.cumsum(pool_a.length[a]), np.cumsum(pool_b.length[b]))
    groups = int(group_b[-1]) + 1 if len(group_b) else 0
    first_a, first_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
    doc = np.repeat(docs, size_a)[first_a[:-1]]
    links = np.diff(first_a) * np.diff(first_b)
    total = np.concatenate([[0], np.cumsum(links)])
    n_groups = np.bincount(doc, minlength=len(docs))
    last = np.concatenate([[0], np.cumsum(n_groups)])
    text, ends = _written(a, b, first_a, first_b, group_a, group_b, np.concatenate([[0], np.cumsum(size_a + size_b)]), digits)
    owner, pair, times = _linked(a, b, group_a, first_a, first_b, doc, len(pool_b.length))
    return {"doc_id": rows.column("doc_id"), "n_a": size_a, "n_b": size_b, "n_groups": n_groups, "n_links": np.diff(total[last]),
            "groups": pa.Array.from_buffers(pa.large_string(), len(docs), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)]),
            "sizes": np.bincount(owner, minlength=len(docs)), "pair": pair, "times": times}


def _listed(held: list[dict], number: int) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of one slice, and the row of its list of pairs."""
    keys, place, documents = np.unique(np.concatenate([h["pair"] for h in held]), return_inverse=True, return_counts=True)
    low = 0
    for h in held:
        n = len(h["n_a"])
        borders = pa.array(np.concatenate([[0], np.cumsum(h["sizes"])]), pa.int32())
        mine = place[low:low + len(h["pair"])]
        low += len(mine)
        none = pa.nulls(n, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number)), h["doc_id"], *(pa.array(h[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), h["groups"].cast(pa.string()),
             pa.ListArray.from_arrays(borders, pa.array(mine, pa.int32())), pa.ListArray.from_arrays(borders, pa.array(h["times"], pa.int64())), none, none], schema=_SCHEMA)
    yield pa.RecordBatch.from_pydict({"slice": [number], **{c: [None] for c in _SCHEMA.names[1:9]}, "keys": [keys], "documents": [documents]}, schema=_SCHEMA)


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("pairs", pa.list_(pa.int32()))] + [(n, pa.list_(pa.int64())) for n in ("times", "keys", "documents")])


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, size: int) -> Iterator[pa.RecordBatch]:
    base, held, bytes_held = TaskContext.get().partitionId() << 33, [], 0
    for batch in batches:
        for rows in parts(batch, min(WORK, size)):
            held.append(_tokens(rows, path_a, path_b))
            bytes_held += rows.column("text").nbytes
            if bytes_held >= size:
                yield from _listed(held, base)
                base, held, bytes_held = base + 1, [], 0
    if held:
        yield from _listed(held, base)


def alignments(docs: DataFrame, path_a: str, path_b: str, size: int = SLICE) -> DataFrame:
    """Documents with the numbers of tokens, groups and links, their ``groups`` as ``a1,a2|b1;a3|b2,b3`` (ids in order) and their distinct
    id pairs (``pairs``: places in the list of the slice, ``times``: links); besides, per slice, a row with that list
    (``keys``: id of A times the size of B's vocabulary, plus id of B; ``documents`` that hold the pair)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(lambda b: _aligned(b, path_a, path_b, size), ALIGNED)


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one slice with the corpus-wide counts of their links."""
    left, right = left.combine_chunks(), right.combine_chunks()
    place = right.column("place").to_numpy()
    count, best = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
    count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
    pairs, times = (pa.concat_arrays(left.column(c).chunks) if left.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("pairs", "times"))
    sizes = np.diff(pairs.offsets.to_numpy())
    at, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
    borders = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([[0], np.cumsum(x[at] * n)])[borders] for x in (best, count)]
    columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, *(pa.array(np.diff(s), pa.int64()) for s in sums), left.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])


def report(aligned: DataFrame, width: int) -> DataFrame:
    """Per document of ``alignments`` the counts, the links to a most frequent partner of their A id (``n_best``), the sum of
    the counts of all links (``count_sum``) and the hash of the groups. ``width``: size of B's vocabulary."""
    hashed = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(aligned.withColumn("groups_sha256", hashed).drop("groups"), "alignments")
    lists = rows.where("keys is not null").select("slice", F.posexplode(F.arrays_zip("keys", "documents")).alias("place", "pair"))
    lists = lists.select("slice", "place", F.col("pair.keys").alias("key"), F.col("pair.documents").alias("documents"))
    counts = stored(lists.groupBy("key").agg(F.sum("documents").alias("count")), "alignment-counts").withColumn("a", F.expr(f"key div {width}"))
    tops = counts.groupBy("a").agg(F.max("count").alias("top"))  # at most one row per entry of A's vocabulary
    counts = counts.join(F.broadcast(tops), "a").select("key", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    known = lists.drop("documents").join(counts, "key").select(F.col("slice").alias("of"), "place", "count", "best")
    docs = rows.where("keys is null").drop("keys", "documents")
    return docs.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(_scored, RESULT)
