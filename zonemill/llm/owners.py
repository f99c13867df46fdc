"""Exact duplicates: equal texts find their owner in compressed radix (Patricia) tries over full byte strings.

Texts are equal when identical after replacing each run of white space by one space. Every task first inserts its own
texts, so that of copies within a task only one goes on. Those are dealt by length and content hash; each part inserts the
full byte strings into tries, one per length, whose terminal nodes keep the smallest doc_id, the number of rows and
the representatives met. A part whose tries outgrow their budget writes its heaviest subtrees out and shuts them;
what belongs there is dealt anew to more parts until nothing is left. No equality rests on a hash.

Missing values: a null text counts as empty; a null doc_id is larger than any other, a group of nulls only has a null
owner. Of rows that repeat the smallest doc_id in one group, one is kept. Columns other than doc_id and text are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonemill.llm.store import small_batches, stored

SPACES = r"[\x20\x09-\x0D]+"
LOCAL = 32 << 20  # bytes in the trie of one task before its rows are written
BUDGET = 192 << 20  # bytes in the tries of one part before subtrees are written out
TARGET = 64 << 20  # bytes of text dealt to one part
NODE = 300  # bytes of a node beside its label
LOCAL_ROWS = "rep long, doc_id long, first boolean, sha binary, n_bytes long, hash long, text binary, count long"
OWNERS = "rep long, keep_id long, keep_rep long, group_size long, reps array<long>, n_bytes long, hash long, text binary, low long, low_rep long, count long"


class Node:
    __slots__ = ("label", "children", "owner", "shut")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.shut = label, {}, None, False


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, which differ: halving with whole-slice comparisons."""
    low, high = 0, min(len(label), len(text) - at)
    if label[:high] == text[at:at + high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """Compressed radix tries, one per text length, so that every text ends in a leaf and depth stays small."""

    def __init__(self) -> None:
        self.roots: dict[int, Node] = {}
        self.held, self.first = 0, None

    def _new(self, label: bytes) -> Node:
        self.held += len(label) + NODE
        return Node(label)

    def leaf(self, text: bytes) -> Node | None:
        """The terminal node of ``text``, made if there is none; None where its subtree is shut."""
        if self.first is None:
            self.first = text
        node = self.roots.get(len(text))
        if node is None:
            node = self.roots[len(text)] = self._new(b"")
        at = 0
        while at < len(text) and not node.shut:
            child = node.children.get(text[at])
            if child is None:
                child = self._new(text[at:])
            elif not text.startswith(child.label, at):
                cut = _common(child.label, text, at)
                upper = self._new(child.label[:cut])
                child.label = child.label[cut:]
                self.held -= cut
                upper.children[child.label[0]] = child
                child = upper
            node.children[text[at]] = child
            at += len(child.label)
            node = child
        return None if node.shut else node

    @staticmethod
    def leaves(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """Texts and terminal nodes below ``node``; ``prefix`` is the path above it."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.owner is not None:
                yield prefix, node
            stack.extend((child, prefix) for child in node.children.values())

    @staticmethod
    def _weigh(root: Node) -> dict[Node, int]:
        order, weight = [root], {}
        for node in order:
            order.extend(node.children.values())
        for node in reversed(order):
            weight[node] = len(node.label) + NODE + sum(weight[c] for c in node.children.values())
        return weight

    def evict(self, limit: int) -> Iterator[tuple[bytes, Node]]:
        """Shut the heaviest subtrees until at most ``limit`` bytes are held; their texts and nodes come out.

        The first text stays whatever its size, so that every round of dealing settles something.
        """
        path, prefix = [self.roots[len(self.first)]], b""
        open_ = [(b"", r) for r in self.roots.values() if r is not path[0]]
        while path[-1].children:
            step = self.first[len(prefix) + len(path[-1].label)]
            prefix += path[-1].label
            open_ += [(prefix, c) for first, c in path[-1].children.items() if first != step]
            path.append(path[-1].children[step])
        weighed = [(self._weigh(node), prefix, node) for prefix, node in open_ if not node.shut]
        for weight, prefix, top in sorted(weighed, key=lambda x: -x[0][x[2]]):
            while self.held > limit and not top.shut:
                node, above, way = top, prefix, [top]
                # the smallest subtree that brings the tries under the limit, or all of this one
                while below := [c for c in node.children.values() if not c.shut]:
                    heavy = max(below, key=weight.__getitem__)
                    if weight[heavy] < self.held - limit:
                        break
                    above, node = above + node.label, heavy
                    way.append(node)
                yield from self.leaves(node, above)
                freed = weight[node] - len(node.label[:1]) - NODE  # one byte of the label tells what is shut
                node.label, node.children, node.owner, node.shut = node.label[:1], {}, None, True
                self.held -= freed
                for n in way:
                    weight[n] -= freed


def _smaller(a: tuple[int | None, int], b: tuple[int | None, int]) -> bool:
    """(doc_id, representative) order; a null doc_id is largest."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _local(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their representative; the row of its smallest doc_id carries the text and the count."""
    base = TaskContext.get().partitionId() << 33
    made = 0

    def written(trie: Trie, columns: list[list], nodes: list[Node]) -> pa.RecordBatch:
        doc, sha, size, hashed, node = columns
        text_of = {id(n): t for root in trie.roots.values() for t, n in trie.leaves(root, b"")}
        first = [n.owner[1] == i for i, n in enumerate(node)]
        return pa.RecordBatch.from_arrays([
            pa.array([n.owner[2] for n in node], pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.bool_()), pa.array(sha, pa.binary()),
            pa.array(size, pa.int64()), pa.array(hashed, pa.int64()), pa.array([text_of[id(n)] if f else None for n, f in zip(node, first)], pa.binary()),
            pa.array([n.owner[3] if f else None for n, f in zip(node, first)], pa.int64())], names=["rep", "doc_id", "first", "sha", "n_bytes", "hash", "text", "count"])

    trie, columns = Trie(), [[], [], [], [], []]
    for batch in batches:
        for text, doc, sha, size, hashed in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "sha", "n_bytes", "hash"))):
            node, row = trie.leaf(text), len(columns[0])
            if node.owner is None:
                node.owner = [doc, row, base + made, 0]  # smallest id, its row, representative, rows
                made += 1
            elif _smaller((doc, row), (node.owner[0], node.owner[1])):
                node.owner[:2] = doc, row
            node.owner[3] += 1
            for column, value in zip(columns, (doc, sha, size, hashed, node)):
                column.append(value)
            if trie.held + 200 * row > limit:
                yield written(trie, columns, columns[4])
                trie, columns = Trie(), [[], [], [], [], []]
    if columns[0]:
        yield written(trie, columns, columns[4])


def _owners(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Representatives of one part → owners, one row each; texts of shut subtrees come out as they are, for the next round."""
    trie = Trie()
    names = ("reps", "n_bytes", "hash", "text", "low", "low_rep", "count")
    types = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def out(done: list[tuple], left: list[tuple]) -> pa.RecordBatch:
        n, m = len(done), len(left)
        owned = list(zip(*done)) if done else [[], [], [], []]
        rest = list(zip(*left)) if left else [[] for _ in names]
        arrays = [pa.array([*o, *[None] * m], pa.int64()) for o in owned]
        arrays += [pa.array([*[None] * n, *r], t) for r, t in zip(rest, types)]
        return pa.RecordBatch.from_arrays(arrays, names=["rep", "keep_id", "keep_rep", "group_size", *names])

    for batch in batches:
        left, size = [], 0
        for reps, n_bytes, hashed, text, low, low_rep, count in zip(*(batch.column(c).to_pylist() for c in names)):
            node = trie.leaf(text)
            if node is None:
                left.append((reps, n_bytes, hashed, text, low, low_rep, count))
                size += n_bytes
            elif node.owner is None:
                node.owner = [low, low_rep, count, list(reps), hashed]
            else:
                if _smaller((low, low_rep), (node.owner[0], node.owner[1])):
                    node.owner[:2] = low, low_rep
                node.owner[2] += count
                node.owner[3].extend(reps)
                trie.held += 8 * len(reps)
            if trie.held > budget:
                for value, shut in trie.evict(budget // 2):
                    low, low_rep, count, reps, hashed = shut.owner
                    left.append((reps, len(value), hashed, value, low, low_rep, count))
                    size += len(value)
                    if size > 1 << 24:
                        yield out([], left)
                        left, size = [], 0
        if left:
            yield out([], left)
    done: list[tuple] = []
    for root in trie.roots.values():
        for _, node in trie.leaves(root, b""):
            low, low_rep, count, reps, _ = node.owner
            done.extend((rep, low, low_rep, count) for rep in reps)
            if len(done) > 1 << 16:
                yield out(done, [])
                done = []
    if done:
        yield out(done, [])


def exact_duplicates(docs: DataFrame, local: int = LOCAL, budget: int = BUDGET, target: int = TARGET) -> DataFrame:
    """Per row ``doc_id``, ``keep_id`` (smallest doc_id of its group), ``group_size``, ``kept`` and ``text_sha256``.

    ``local`` and ``budget`` bound the bytes held by a task in the first and in the later steps, ``target`` is
    the text dealt to one part; results do not depend on them.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("hash"))
    rows = stored(small_batches(rows).mapInArrow(lambda b: _local(b, local), LOCAL_ROWS), "exact-rows")
    left = rows.where("count is not null").select(F.array("rep").alias("reps"), "n_bytes", "hash", "text", F.col("doc_id").alias("low"), F.col("rep").alias("low_rep"), "count")
    owners, rounds = None, 0
    while True:
        total = left.agg(F.sum("n_bytes")).first()[0]
        if total is None:
            break
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // target))
        dealt = left.repartition(parts, "n_bytes", "hash", F.lit(rounds))
        found = stored(dealt.mapInArrow(lambda b: _owners(b, budget), OWNERS), "exact-owners")
        done = found.where("rep is not null").select("rep", "keep_id", "keep_rep", "group_size")
        owners = done if owners is None else owners.unionByName(done)
        left, rounds = found.where("rep is null").select("reps", "n_bytes", "hash", "text", "low", "low_rep", "count"), rounds + 1
    if owners is None:
        owners = spark.createDataFrame([], "rep long, keep_id long, keep_rep long, group_size long")
    kept = F.col("first") & (F.col("rep") == F.col("keep_rep"))
    return rows.select("rep", "doc_id", "first", "sha").join(owners, "rep").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
