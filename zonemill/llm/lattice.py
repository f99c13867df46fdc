"""SentencePiece BPE as a relational lattice.

Texts are cut into units at places no piece reaches over: ahead of a run of space marks, and between two characters that
stand side by side in no piece. Every distinct unit is exploded into its substrings of bounded length, these are equi-joined with the piece table, the edges are gathered
by unit (they come one unit after the other, so no sorting by unit is needed) and folded with a Spark higher-order aggregate
into the one path that the model takes. Its ids are those of the lattice's edges.

The model is BPE, so the best path is not the one of largest summed score: pieces are merged in the order of their
scores, the leftmost first. The fold does that in one pass: it visits the edges in order of score and place and keeps an
edge if it joins exactly two of the segments that are left. An edge that fails at its turn cannot come later, as long
as no piece becomes available later than its own score says; the few that do are known from the model (``late``) and are
visited when their later part is made. What single characters remain without a piece become byte pieces.

Units come back to the documents by chunks of documents: a chunk needs each of its units once, and lists of them travel
compressed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonemill.llm.store import extended, small_batches, stored
from zonemill.llm.text import buffers, gathered, slices
from zonemill.llm.worker import give_back, lean

MARK = "▁"
CHUNK = 8192  # documents (range of doc_ids) that share a dictionary
PART = 1 << 22  # bytes of texts that are put together at once
LISTED = 1 << 25  # bytes of distinct words that a task holds before it lists their units
SHORT = 62  # characters of a unit whose borders fit into one long


@dataclass
class Model:
    pieces: list[tuple[str, int, int, int, int]]  # piece, id, turn, shift of the turn's place, depth
    bytes_from: list[int]
    shown: list[bytes]
    longest: int
    pairs: np.ndarray  # of characters side by side in a piece: the first shifted by 21 bits, and the second; ascending


def _late(piece: str, ranks: dict[str, int]) -> tuple[int, int, int] | None:
    """When a piece comes up in its own text: (turn, shift, depth); None if its text is never merged to one."""
    at = list(range(len(piece) + 1))
    turn = (-1, 0, 0)
    while len(at) > 2:
        options = [(ranks[t], i) for i in range(len(at) - 2) if (t := piece[at[i]:at[i + 2]]) in ranks]
        if not options:
            return None
        rank, i = min(options)
        own = (rank, at[i], 0)
        # made by an earlier turn's merge: it follows that merge at once
        turn = own if own[:2] > turn[:2] else (turn[0], turn[1], turn[2] + 1)
        del at[i + 1]
    return turn


def load(path: str) -> Model:
    """Pieces of a BPE model with byte fallback, whose normalisation only escapes spaces."""
    spm = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(spm.get_piece_size())
    plain = {spm.id_to_piece(i): i for i in ids if not (spm.is_control(i) or spm.is_unknown(i) or spm.is_byte(i) or spm.is_unused(i))}
    scores = {s: k for k, s in enumerate(sorted({spm.get_score(i) for i in plain.values()}, reverse=True))}
    ranks = {p: scores[spm.get_score(i)] for p, i in plain.items() if len(p) > 1}
    if any(MARK in p.lstrip(MARK) or re.search("[\n\t]", p) and len(p) > 1 for p in plain):
        raise ValueError("a piece reaches over the borders of units")
    rows = []
    for piece, i in plain.items():
        turn = _late(piece, ranks) if len(piece) > 1 else (len(scores), 0, 0)
        if turn is not None:
            rows.append((piece, i, *turn))
    bytes_from = [spm.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    known = set(plain.values())
    shown = [spm.id_to_piece(i).replace(MARK, " ").encode() if i in known else b"" for i in ids]
    for b, i in enumerate(bytes_from):
        shown[i] = bytes([b])
    if max(map(len, plain)) > 31 or max(r[1] for r in rows) >= CODE or max(r[4] for r in rows) > 255:
        raise ValueError("an edge does not fit")
    pairs = {ord(a) << 21 | ord(b) for p in plain for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:])}
    return Model(rows, bytes_from, shown, max(len(p) for p in plain), np.array(sorted(pairs), np.int64))


def _strings(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes from each place to the next; they are not copied."""
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A text's words: a run of spaces with what follows it; line ends and tabs stand alone. Where the words of each row begin
    (one border more than rows), and the words, distinct ones in a dictionary. Space marks are spaces here, and a text that
    is not empty gets a leading one."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    lead = pc.if_else(pc.equal(texts, pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, at = buffers(pc.binary_join_element_wise(lead, texts, pa.scalar("", pa.large_string())))
    data, at = data[at[0]:at[-1]], at - at[0]
    space, alone = data == 32, (data == 10) | (data == 9)
    first = space | alone
    first[1:] &= ~(space[1:] & space[:-1])
    first[1:] |= alone[:-1]
    first[at[:-1][at[:-1] < at[1:]]] = True
    place = np.flatnonzero(first)
    return np.searchsorted(place, at), _strings(data, np.append(place, len(data))).dictionary_encode()


def units_of(words: pa.Array, pairs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words cut between characters that no piece has side by side: where the units of each begin, and the units, with
    space marks."""
    data, at = buffers(words)
    data, at = data[at[0]:at[-1]], at - at[0]
    place = np.flatnonzero(data & 0xC0 != 0x80)  # of characters
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.zeros(len(data) + 1, bool)
    pair = code[:-1] << 21 | code[1:]
    near = np.searchsorted(pairs, pair)
    first[place[1:]] = np.append(pairs, -1)[near] != pair
    first[at] = True
    first[-1] = False
    place = np.flatnonzero(first)
    return np.searchsorted(place, at), pc.replace_substring(_strings(data, np.append(place, len(data))), " ", MARK)


# ---- the lattice ----
# An edge is two longs: when it comes up, and what it is (place, length, id).
FROM, SIZE, CODE = 27, 22, 1 << 21  # bits below the place and the length; ids from CODE on are characters without a piece

def edges(words: DataFrame, model: Model) -> DataFrame:
    """(number, unit, turn, edge), unit after unit: every substring that is a piece; single characters always, those come first."""
    spark = words.sparkSession
    table = spark.createDataFrame(model.pieces, "piece string, id int, late int, shift int, depth int")  # as large as the model: fixed
    words = words.select("unit", F.monotonically_increasing_id().alias("number"), F.length("unit").alias("n"))
    starts = words.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("from"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("from")))).alias("size"))
    spans = spans.select("number", "unit", "from", "size", F.col("unit").substr(F.col("from") + 1, F.col("size")).alias("piece"))
    found = spans.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    turn = F.coalesce("late", F.lit(1 << 20)).cast("long") * (1 << 40) + (F.col("from") + F.coalesce("shift", F.lit(0))).cast("long") * 256 + F.coalesce("depth", F.lit(0))
    value = F.coalesce("id", F.ascii("piece") + CODE)
    edge = F.col("from").cast("long") * (1 << FROM) + F.col("size") * (1 << SIZE) + value
    return found.select("number", F.when((F.col("from") == 0) & (F.col("size") == 1), F.col("unit")).alias("unit"), turn.alias("turn"), edge.alias("edge"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, edges in the order of their turns). The edges of a unit follow one another; its name stands at the first."""
    rest: pa.RecordBatch | None = None

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        first = np.flatnonzero(rows.column("unit").is_valid().to_numpy(zero_copy_only=False))
        number = rows.column("number").to_numpy()
        group = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        if len(first) != group[-1] + 1 or (number[first[1:]] == number[first[1:] - 1]).any() or first[0]:
            raise RuntimeError("the edges of a unit do not follow one another")
        order = np.lexsort((rows.column("turn").to_numpy(), group))
        borders = pa.array(np.append(first, len(group)), pa.int32())
        return pa.RecordBatch.from_arrays([rows.column("unit").drop_null(), pa.ListArray.from_arrays(borders, rows.column("edge").take(pa.array(order)))], ["unit", "edges"])
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        starts = np.flatnonzero(rows.column("unit").is_valid().to_numpy(zero_copy_only=False))
        if starts[-1]:
            yield out(rows.slice(0, starts[-1]))
        rest = rows.slice(starts[-1])
    if rest is not None:
        yield out(rest)


def _bit(at):
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def borders(lattice: DataFrame) -> DataFrame:
    """(unit, edges, mask): the fold. Bit p of ``mask`` is set where a segment begins or ends; null for units over ``SHORT``."""
    n = F.length("unit")
    whole = _bit(n + 1) - 1

    def step(mask, e):
        start = F.shiftright(e, FROM).cast("int")
        size = F.shiftright(e, SIZE).bitwiseAND(F.lit(31)).cast("int")
        inner = (_bit(start + size) - 1).bitwiseXOR(_bit(start + 1) - 1)
        ends = _bit(start).bitwiseOR(_bit(start + size))
        joins_two = (mask.bitwiseAND(ends) == ends) & (F.bit_count(mask.bitwiseAND(inner)) == 1)
        return F.when(joins_two, mask.bitwiseAND(F.bitwise_not(inner))).otherwise(mask)
    longer = F.filter("edges", lambda e: F.shiftright(e, SIZE).bitwiseAND(F.lit(31)) > 1)
    return lattice.select("unit", "edges", F.when(n <= SHORT, F.aggregate(longer, whole, step)).alias("mask"))


def _kept(edge: np.ndarray) -> np.ndarray:
    """The same fold for a unit whose borders do not fit into a long: which of its edges are segments at the end."""
    start, size = (edge >> FROM).tolist(), (edge >> SIZE & 31).tolist()
    at = bytearray(b"\x01") * (max(a + n for a, n in zip(start, size)) + 1)
    for low, n in zip(start, size):
        if n > 1 and at[low] and at[low + n] and sum(at[low + 1:low + n]) == 1:
            at[low + 1:low + n] = bytes(n - 1)
    return np.array([bool(at[low] and at[low + n] and not any(at[low + 1:low + n])) for low, n in zip(start, size)])


def _piece_ids(batches: Iterator[pa.RecordBatch], bytes_from: list[int]) -> Iterator[pa.RecordBatch]:
    """(unit, ids): the ids of the edges between neighbouring borders, in order; characters without a piece as bytes."""
    for batch in batches:
        lists, masks = batch.column("edges"), batch.column("mask")
        offsets = lists.offsets.to_numpy()
        edge = lists.values.to_numpy()[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        group = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        mask = masks.fill_null(0).to_numpy().astype(np.uint64)[group]
        start, size = edge >> FROM, edge >> SIZE & 31
        low, high = (np.uint64(1) << np.minimum(x, 63).astype(np.uint64) for x in (start, start + size))
        own = (mask & low > 0) & (mask & high > 0) & (mask & ((high - np.uint64(1)) ^ ((low << np.uint64(1)) - np.uint64(1))) == 0)
        for i in np.flatnonzero(masks.is_null().to_numpy(zero_copy_only=False)):
            own[offsets[i]:offsets[i + 1]] = _kept(edge[offsets[i]:offsets[i + 1]])
        group, start, value = group[own], start[own], edge[own] & (2 * CODE - 1)
        order = np.lexsort((start, group))
        group, value = group[order], value[order]
        bare = np.flatnonzero(value >= CODE)
        if len(bare):
            own_bytes = [[bytes_from[b] for b in chr(c).encode()] for c in (value[bare] - CODE).tolist()]
            times = np.ones(len(value), np.int64)
            times[bare] = [len(x) for x in own_bytes]
            first = np.cumsum(times) - times
            group, value = np.repeat(group, times), np.repeat(value, times)
            for i, x in zip(first[bare].tolist(), own_bytes):
                value[i:i + len(x)] = x
        ends = np.searchsorted(group, np.arange(batch.num_rows + 1)) * 4
        ids = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(value.astype("<u4"))])
        yield pa.RecordBatch.from_arrays([batch.column("unit"), ids.cast(pa.binary())], ["unit", "ids"])


def segmented(words: DataFrame, model: Model) -> DataFrame:
    """Distinct units → (unit, ids)."""
    bytes_from = model.bytes_from
    lattice = edges(words, model).mapInArrow(lean(_gathered), "unit string, edges array<long>")
    return borders(lattice).mapInArrow(lean(lambda b: _piece_ids(b, bytes_from)), "unit string, ids binary")


# ---- documents ----
# Units travel as compressed lists, one for a chunk of documents and a bucket of units. Units of one character need no
# lattice; the others hold no line end, which separates them in a list.

def _pack(units: list[str]) -> bytes:
    return zstandard.compress("\n".join(sorted(units)).encode(), 3)


def _unpack(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split("\n")


def _by_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of every chunk."""
    chunk = batch.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    first = np.flatnonzero(np.diff(chunk[order], prepend=chunk[order[:1]] - 1))
    return zip(chunk[order[first]].tolist(), np.split(order, first[1:]) if len(order) else [])


def _units_of(batches: Iterator[pa.RecordBatch], buckets: int, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The distinct units of every chunk, as far as this task sees it, by bucket."""
    seen: dict[int, list[pa.Array]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for chunk, words in seen.items():
            _, units = units_of(pa.concat_arrays(words).unique(), pairs)
            lists: dict[int, list[str]] = {}
            for unit in units.unique().to_pylist():
                if len(unit) > 1:
                    lists.setdefault(zlib.crc32(unit.encode()) % buckets, []).append(unit)
            columns = [pa.array([chunk] * len(lists), pa.int64()), pa.array(list(lists), pa.int64()), pa.array([_pack(x) for x in lists.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "units"])
        seen.clear()
    for batch in batches:
        texts = batch.column("text")
        for chunk, rows in _by_chunk(batch):
            own = texts.take(pa.array(rows))
            for low, high in slices(buffers(own)[1], PART):
                words = words_of(own.slice(low, high - low))[1].dictionary
                seen.setdefault(chunk, []).append(words)
                size += words.nbytes
        if size > LISTED:
            yield from out()
            size = 0
    yield from out()


def _distinct(lists: pa.Table) -> pa.Table:
    found = pa.table({"unit": pa.array(sorted(set().union(*(_unpack(x.as_py()) for x in lists.column("units")))), pa.string())})
    give_back()
    return found


GIVEN = pa.schema([("chunk", pa.int64()), ("units", pa.binary()), ("ids", pa.binary())])


def _attach(lists: pa.Table, words: pa.Table) -> pa.Table:
    """Lists of units with the ids of their units, one after the other behind their numbers."""
    known = dict(zip(words.column("unit").to_pylist(), words.column("ids").to_pylist()))
    out = []
    for data in lists.column("units").to_pylist():
        own = [known[u] for u in _unpack(data)]
        sizes = np.array([len(x) // 4 for x in own], "<u4")
        out.append(zstandard.compress(sizes.tobytes() + b"".join(own), 3))
    del known
    give_back()
    return pa.table([lists.column("chunk"), lists.column("units"), pa.array(out, pa.binary())], schema=GIVEN)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a chunk within a batch compressed together, behind their lengths in bytes."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        numbers, lists, texts = [], [], []
        ids = batch.column("doc_id")
        for chunk, own in _by_chunk(batch):
            numbers.append(chunk)
            lists.append(ids.take(pa.array(own)).to_pylist())
            sizes = (offsets[own + 1] - offsets[own]).astype("<i8").tobytes()
            texts.append(press.compress(sizes + b"".join(data[offsets[i]:offsets[i + 1]].tobytes() for i in own)))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(texts, pa.binary())], ["chunk", "doc_ids", "texts"])


def _texts_of(n: int, data: bytes) -> Iterator[str]:
    flat = zstandard.decompress(data)
    ends = (np.cumsum(np.frombuffer(flat, "<i8", n)) + 8 * n).tolist()
    return (flat[a:b].decode() for a, b in zip([8 * n, *ends[:-1]], ends))


CODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary())])


class _Known:
    """Units with their ids. Units of one character are not in the lists; their ids come from the model's table."""

    def __init__(self, lists: pa.Table, piece_ids: dict[str, int], bytes_from: list[int]):
        self.piece_ids, self.bytes_from = piece_ids, bytes_from
        names, sizes, flat = [], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for data, packed in zip(lists.column("units"), lists.column("ids")):
            names.append(pa.array(_unpack(data.as_py()), pa.large_string()))
            numbers = np.frombuffer(zstandard.decompress(packed.as_py()), "<u4")
            sizes.append(numbers[:len(names[-1])].astype(np.int64))
            flat.append(numbers[len(names[-1]):])
        self.names = pa.chunked_array(names, pa.large_string())
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.first = np.cumsum(self.sizes) - self.sizes

    def ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and where each unit's begin (one border more than units)."""
        distinct = units.dictionary_encode()
        at = pc.index_in(distinct.dictionary, self.names).fill_null(-1).to_numpy()
        bare = np.flatnonzero(at < 0)
        own = []
        for unit in distinct.dictionary.take(pa.array(bare)).to_pylist():
            if len(unit) > 1:
                raise KeyError(unit)
            known = self.piece_ids.get(unit)
            own.append([known] if known is not None else [self.bytes_from[b] for b in unit.encode()])
        more = np.array([len(x) for x in own], np.int64)
        first, size = (x[np.maximum(at, 0)] if len(x) else np.zeros(len(at), np.int64) for x in (self.first, self.sizes))
        first[bare], size[bare] = len(self.flat) + np.cumsum(more) - more, more
        number = distinct.indices.to_numpy()
        return gathered(np.append(self.flat, np.array([i for x in own for i in x], "<u4")), first[number], size[number])


def _assemble(docs: pa.Table, lists: pa.Table, piece_ids: dict[str, int], bytes_from: list[int], pairs: np.ndarray) -> pa.Table:
    known = _Known(lists, piece_ids, bytes_from)
    out = []
    for numbers, data in zip(docs.column("doc_ids"), docs.column("texts")):
        texts, numbers = pa.array(_texts_of(len(numbers), data.as_py()), pa.large_string()), numbers.values.cast(pa.int64())
        for low, high in slices(buffers(texts)[1], PART):
            rows, words = words_of(texts.slice(low, high - low))
            borders, units = units_of(words.dictionary, pairs)
            flat, place = known.ids(units)
            first, word = place[borders], words.indices.to_numpy()
            flat, place = gathered(flat, first[word], np.diff(first)[word])
            ends = place[rows]
            ids = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(ends * 4), pa.py_buffer(flat.astype("<u4"))])
            out.append(pa.RecordBatch.from_arrays([numbers.slice(low, high - low), pa.array(np.diff(ends), pa.int64()), ids.cast(pa.binary())], schema=CODED))
    del known
    give_back()
    return pa.Table.from_batches(out, CODED)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids`` (little-endian unsigned 32-bit integers) of whole texts.

    Null and empty texts have no pieces. Rows that repeat are encoded as often as they occur; a null doc_id is kept; an
    empty table gives an empty table. Other columns are ignored.
    """
    model = load(path)
    piece_ids = {p: i for p, i, *_ in model.pieces}
    bytes_from, pairs = model.bytes_from, model.pairs
    rows = small_batches(docs).select(F.coalesce(F.floor(F.col("doc_id") / CHUNK).cast("long"), -1 - F.pmod(F.xxhash64("text"), F.lit(64))).alias("chunk"), F.col("doc_id").cast("long"), F.col("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.select("chunk", "text").mapInArrow(lean(lambda b: _units_of(b, buckets, pairs)), "chunk long, bucket long, units binary")
    lists = stored(lists, "units")
    words = segmented(lists.groupBy("bucket").applyInArrow(_distinct, "unit string"), model)
    words = words.withColumn("bucket", F.crc32(F.col("unit").cast("binary")) % buckets)
    given = lists.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_attach, "chunk long, units binary, ids binary")
    packed = rows.mapInArrow(lean(_packed), "chunk long, doc_ids array<long>, texts binary")
    return (packed.groupBy("chunk").cogroup(given.groupBy("chunk"))
            .applyInArrow(lambda d, w: _assemble(d, w, piece_ids, bytes_from, pairs), "doc_id long, n_pieces long, ids binary"))


def _texts(batches: Iterator[pa.RecordBatch], shown: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
        out = []
        for data in batch.column("ids").to_pylist():
            text = b"".join(map(shown.__getitem__, np.frombuffer(data or b"", "<u4").tolist()))
            out.append(text.removeprefix(b" ").decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text of ``ids`` (space marks are spaces, the leading one goes, byte pieces are bytes)."""
    shown = load(path).shown
    return coded.mapInArrow(lean(lambda b: _texts(b, shown)), extended(coded, decoded="string"))
