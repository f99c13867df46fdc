"""Near-duplicate documents: chosen-path similarity join over minwise tokens (Christiani, Pagh, Sivertsen 2018).

Equal shingle sets are one class from the start. Every tree sends a class down to nodes chosen by its minwise tokens;
a node with few classes is compared exhaustively, a large one chooses further tokens by its own hash, 1/similarity of
them on average, so that a pair at the threshold keeps its expected number of common nodes. Independent trees make a
miss at the threshold less likely than 0.15**trees where nodes are small at once.

Signatures first leave out what has no likely partner in its node. The rest is compared on whole shingle sets, all pairs of
a node by products of its incidence matrix, and a node reports a spanning forest of its links: linear in its classes, and
enough for the groups. A node that stays large to the last level is compared in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonemill.llm import text as kernel
from zonemill.llm.components import components
from zonemill.llm.store import stored
from zonemill.llm.worker import lean
from zonemill.session import checkpointed

TOKENS = 64  # minwise functions of a signature
TREES = 10
NODE = 512  # classes that a node compares exhaustively
LEVELS = 3
BLOCK = 512  # classes of a block where a node stays large to the last level
SIGNED = "doc_id long, text_key long, n_shingles long, class binary, roots array<long>, sig binary"
_FACTORS = kernel.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        data, offsets = kernel.buffers(batch.column("text"))
        for low, high in kernel.slices(offsets):
            values, first = kernel.Slice(data, offsets, low, high).shingles(width)
            n = np.diff(first)
            full = n > 0
            rows, at = int(full.sum()), first[:-1][full]
            tokens = np.zeros((rows, TOKENS), np.uint64)
            digest = np.zeros((rows, 2), np.uint64)
            if rows:
                for k in range(TOKENS):
                    tokens[:, k] = np.minimum.reduceat(values * _FACTORS[k], at)
                for k in range(2):
                    digest[:, k] = np.add.reduceat(kernel.mix(values + np.uint64(k + 1)), at)
            roots = kernel.mix(tokens[:, :TREES] + np.arange(1, TREES + 1, dtype=np.uint64)).view(np.int64)
            low16 = (kernel.mix(tokens) & np.uint64(0xFFFF)).astype("<u2")
            where = np.cumsum(full) - 1
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.slice(low, high - low), "text_key": batch.column("text_key").slice(low, high - low), "n_shingles": pa.array(n, pa.int64()),
                "class": pa.array([digest[w].tobytes() if f else None for f, w in zip(full, where)], pa.binary()),
                "roots": pa.array([roots[w] if f else None for f, w in zip(full, where)], pa.list_(pa.int64())),
                "sig": pa.array([low16[w].tobytes() if f else None for f, w in zip(full, where)], pa.binary())})


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per document: a hash of its text, size of its shingle set, a digest of the set (null if empty), minwise tokens."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text")).mapInArrow(lean(lambda b: _signed(b, width)), SIGNED)


def _children(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Rows of large nodes → rows of the nodes below: one token of the node's choice, and with probability share - 1 another."""
    limit = np.uint64(min(max(share - 1.0, 0.0), 1.0) * 2.0**63)
    for batch in batches:
        node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(node):
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, TOKENS)
        for k in range(2):
            pick = kernel.mix(node + np.uint64(2 * k + 1))
            rows = np.flatnonzero((kernel.mix(node + np.uint64(77)) >> np.uint64(1)) < limit) if k else np.arange(len(node))
            token = (pick % np.uint64(TOKENS)).astype(np.int64)[rows]
            below = kernel.mix(node[rows] * np.uint64(0xD1342543DE82EF95) + (token.astype(np.uint64) << np.uint64(16)) + sig[rows, token] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), *(batch.column(c).take(pa.array(rows)) for c in ("class", "n", "sig"))], ["node", "class", "n", "sig"])


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures and sizes leave room for the threshold: five standard deviations below it."""
    p = percent / 100
    least = int(np.floor(TOKENS * p - 5 * np.sqrt(TOKENS * p * (1 - p))))
    return ((a == b).sum(axis=-1) >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node → the rows that have a partner in their node whose signature leaves room for the threshold.

    A node has a bounded number of rows (``NODE``, or two blocks); it may reach over batches.
    """
    for node, (classes, n, sig, side) in _nodes(batches, ("class", "n", "sig", "side")):
        sig, n, side = np.frombuffer(b"".join(sig), "<u2").reshape(-1, TOKENS), np.array(n), np.array(side)
        keep = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            j = np.arange(i + 1, len(n))
            j = j[(side[j] != side[i]) | (side[i] < 0)]
            j = j[_alike(sig[j], sig[i], n[j], n[i], percent)] if len(j) else j
            keep[j] = True
            keep[i] |= len(j) > 0
        at = np.flatnonzero(keep)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(at), pa.int64()), pa.array([classes[k] for k in at], pa.binary())], ["node", "class"])


def _nodes(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[list]]]:
    """Consecutive rows of one node, of two rows or more, column by column."""
    node, held = None, [[] for _ in columns]
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        if not len(nodes):
            continue
        borders = np.concatenate([[0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]])
        values = [batch.column(c).to_pylist() for c in columns]
        for low, high in zip(borders[:-1], borders[1:]):
            if nodes[low] != node:
                if len(held[0]) > 1:
                    yield node, held
                node, held = int(nodes[low]), [[] for _ in columns]
            for h, v in zip(held, values):
                h += v[low:high]
    if len(held[0]) > 1:
        yield node, held


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the incidence matrix in blocks of columns."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(value)) > 1  # the others are in one set only
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(sets), min(4096, int(shared.sum()) - low)), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        common += block @ block.T
    return common


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node → links that span what hangs together in the node, confirmed on whole shingle sets."""
    for _, (classes, sets) in _nodes(batches, ("class", "set")):
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        size = np.array([len(x) for x in sets])
        common = _common(sets)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        left, right, new = [], [], np.ones(len(sets), bool)
        while new.any():
            front = [int(np.flatnonzero(new)[0])]
            new[front] = False
            while front:
                i = front.pop()
                for j in np.flatnonzero(linked[i] & new):
                    left.append(classes[i])
                    right.append(classes[j])
                    new[j] = False
                    front.append(int(j))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _digest(values: np.ndarray) -> bytes:
    return b"".join(kernel.mix(values + np.uint64(k + 1)).sum(dtype=np.uint64).tobytes() for k in range(2))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.buffers(batch.column("text"))
        for low, high in kernel.slices(offsets):
            values, first = kernel.Slice(data, offsets, low, high).shingles(width)
            sets = [values[i:j] for i, j in zip(first[:-1], first[1:])]
            classes = batch.column("class").slice(low, high - low)
            keep = pa.array([_digest(x) == c for x, c in zip(sets, classes.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([classes.filter(keep), pa.array([x.tobytes() for x in sets], pa.binary()).filter(keep)], ["class", "set"])


def _shingles(docs: DataFrame, classes: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """Whole shingle sets of the classes in ``near``; of repeated doc_ids the text is found by its own digest."""
    wanted = classes.join(near.select("class").distinct(), "class", "left_semi").select("class", F.col("first_id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text")).join(wanted, "doc_id").select("class", "text")
    return stored(texts.mapInArrow(lean(lambda b: _sets(b, width)), "class binary, set binary").dropDuplicates(["class"]), "shingles")


def _blocks(rows: DataFrame) -> DataFrame:
    """A node that is large to the last level, as pairs of blocks of about ``BLOCK`` classes."""
    cut = F.ceil(F.col("count") / BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), cut)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    pair = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise((F.col("block") < F.col("other")).cast("int"))
    return rows.select(pair.alias("node"), "class", "n", "sig", side.alias("side"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, keyed: bool = False) -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id``, ``kept``: groups of ``percent`` % similar shingle sets.

    Similar means 100·|A∩B| ≥ percent·|A∪B|. Texts without words are linked with nothing and are their own group. Rows
    without a doc_id are never linked (``component_id`` null, kept). Of repeated doc_ids each row counts with its own
    text. The input needs ``doc_id`` and ``text``; other columns are ignored. An empty table gives an empty table.
    With ``keyed`` the row's ``text_key`` (``xxhash64`` of its text) comes too.
    """
    signed = stored(signatures(docs, width), "signatures")
    classes = (signed.where("class is not null and doc_id is not null").groupBy("class")
               .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("roots").alias("roots"), F.first("sig").alias("sig")))
    classes = stored(classes, "classes")

    keys = classes.select(F.explode("roots").alias("node"), "class")
    live = keys.join(keys.groupBy("node").count().where("count > 1"), "node")
    rows = live.join(classes.select("class", "n", "sig"), "class")
    leaves = []
    for level in range(LEVELS):
        rows = checkpointed(rows.select("node", "class", "n", "sig", "count"))
        leaves.append(rows.where(F.col("count") <= NODE).select("node", "class", "n", "sig", F.lit(-1).alias("side")))
        if level == LEVELS - 1:
            leaves.append(_blocks(rows.where(F.col("count") > NODE)))
            break
        below = rows.where(F.col("count") > NODE).select("node", "class", "n", "sig").mapInArrow(
            lean(lambda b: _children(b, 100 / percent)), "node long, class binary, n long, sig binary")
        rows = below.join(below.groupBy("node").count().where("count > 1"), "node")
    every = leaves[0]
    for part in leaves[1:]:
        every = every.unionByName(part)
    near = checkpointed(every.repartition("node").sortWithinPartitions("node").mapInArrow(lean(lambda b: _candidates(b, percent)), "node long, class binary"))

    # the same classes met in several trees are compared once
    met = near.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(30,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("x"))
    once = met.groupBy("n", "s", "x").agg(F.min("node").alias("node")).select("node")
    sets = _shingles(docs, classes, near, width)
    links = (near.join(once, "node").join(sets, "class").repartition("node").sortWithinPartitions("node")
             .mapInArrow(lean(lambda b: _forest(b, percent)), "a binary, b binary").distinct())
    roots = components(links)

    labels = classes.select("class", "first_id").join(roots.withColumnRenamed("a", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = labels.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(least, "root").select("class", "component_id")
    own = F.coalesce("component_id", "doc_id")
    names = ["doc_id", *(["text_key"] if keyed else []), "n_shingles"]
    return (signed.select(*names, F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(labels, "class", "left")
            .select(*names, own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")))
