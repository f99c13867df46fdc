"""Token ids of whole texts, word by word through a bounded cache.

Both public BPE vocabularies of the tokenizers library cut between a character that is no white space and a space or line end after it, so the ids of a text
are those of its words (each with its space) one after the other. Words are split and numbered by Arrow kernels, only
distinct ones are encoded, many in one text with a mark between them, and ids are put together by array indexing. Texts
for which the rule may not hold (white space before a space, the mark itself) are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from tokenizers import Tokenizer

MARK = "\0"
# white space of Unicode before a space
ODD = r"[\s\x0b\x85\pZ\x{180e}] |\x00"
# ... before a line end: such texts are not cut at line ends
ODD_LINE = r"[\s\x0b\x85\pZ\x{180e}]\n"
CACHED = 600_000  # words that a worker remembers
CACHED_CHARACTERS = 24_000_000
TOGETHER = 128  # words encoded in one text


class Encoder:
    """Texts → ids as one array of unsigned 32-bit integers, and the borders of the texts."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.blind = self._plain(" a\nb") == self._plain("a b")  # white space leaves no trace in the ids
        self.mark = self._plain(f" {MARK}")
        self._forget()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size, self.characters = 0, 0
        self.pool = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int32)

    def _trim(self) -> None:
        """Keep the words that came up more than once, at most half of the limit, and halve their counts."""
        hits, least = self.hits[:len(self.known)], 2
        while np.count_nonzero(hits >= least) > CACHED // 2:
            least *= 2
        index = np.flatnonzero(hits >= least)
        words = list(self.known)
        size = self.first[index + 1] - self.first[index]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.first[index] - place[:-1], size) + np.arange(place[-1])]
        hits = hits[index] // 2
        self._forget()
        self._learn([words[i] for i in index], ids, size)
        self.hits[:len(hits)] = hits

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of new words, one after the other in ``ids``, to the pool."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.characters += len("".join(words))
        count, total = len(self.known), self.size + len(ids)
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        if count + 1 > len(self.first):
            more = max(count, len(self.first))
            self.first = np.concatenate([self.first, np.zeros(more, np.int64)])
            self.hits = np.concatenate([self.hits, np.zeros(more, np.int32)])
        self.pool[self.size:total] = ids
        self.first[count - len(words) + 1:count + 1] = self.size + np.cumsum(sizes)
        self.size = total

    def _encode_words(self, words: list[str]) -> None:
        """Ids of new words: those that begin with a space (or any, where spaces leave no trace) many in one text."""
        if self.blind:
            joined, alone = words, []
        else:
            joined, alone = [w for w in words if w.startswith((" ", "\n"))], [w for w in words if not w.startswith((" ", "\n"))]
        glue = f" {MARK} " if self.blind else f" {MARK}"
        for low in range(0, len(joined), TOGETHER * 64):
            part = joined[low:low + TOGETHER * 64]
            rows = self._batch([glue.join(part[i:i + TOGETHER]) + glue for i in range(0, len(part), TOGETHER)])
            ids = np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows)))
            ends = np.flatnonzero(ids == self.mark[-1])
            own = np.ones(len(ids), bool)
            for k in range(len(self.mark)):
                own[ends - k] = False
            self._learn(part, ids[own], np.diff(ends, prepend=-1) - len(self.mark))
        for low in range(0, len(alone), 4096):
            part = alone[low:low + 4096]
            rows = self._batch(part)
            self._learn(part, np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows))), np.array(list(map(len, rows))))

    def _split(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Which texts are encoded whole, and the words of the others."""
        odd = pc.match_substring(texts, MARK) if self.blind else pc.match_substring_regex(texts, ODD)
        regular = pc.if_else(odd, "", texts)
        if self.blind:
            return odd, pc.split_pattern(pc.replace_substring(regular, "\n", " "), " ")
        lines = pc.replace_substring(regular, "\n", f"{MARK}\n")
        regular = pc.if_else(pc.match_substring_regex(regular, ODD_LINE), regular, lines)
        return odd, pc.split_pattern(pc.replace_substring(regular, " ", f"{MARK} "), MARK)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one border more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd, words = self._split(texts)
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > CACHED or self.characters > CACHED_CHARACTERS:
            self._trim()
            if self.characters > CACHED_CHARACTERS // 2:
                self._forget()  # few but very long words
            known = self.known
            new = [w for w in distinct if w not in known]
        self._encode_words(new)
        own = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        self.hits[own] += 1
        word = own[numbered.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        begin, size = self.first[word], self.first[word + 1] - self.first[word]
        place = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin - place[:-1], size) + np.arange(place[-1])]
        borders = place[words.offsets.to_numpy()]
        if not pc.any(odd).as_py():
            return ids, borders
        parts, sizes = [ids[a:b] for a, b in zip(borders[:-1], borders[1:])], np.diff(borders)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        for i, x in zip(at, self._batch(texts.take(pa.array(at)).to_pylist())):
            parts[i], sizes[i] = np.array(x, np.uint32), len(x)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def encode_each(self, texts: list[str | None]) -> list[list[int]]:
        ids, borders = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])]


class PieceEncoder(Encoder):
    """The same for a SentencePiece model that adds a space ahead and changes nothing else in a text.

    If no piece has a space after another character, no merge crosses the border between a character and a space after
    it; a line end that no piece holds is a border as well. Models that don't meet this encode every text whole.
    """

    def __init__(self, path: str):
        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.tokenizer
        self.pieces = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode() for i in range(len(model))]
        plain = [p for i, p in enumerate(self.pieces) if not model.is_byte(i)]
        trial = "  a  \uff21\u00a0 "
        self.cut = not any(b" " in p.lstrip(b" ") or b"\n" in p for p in plain) and b"".join(self.pieces[i] for i in model.encode(trial)) == f" {trial}".encode()
        self._forget()

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1)

    def _split(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        odd = pc.match_substring_regex(texts, r"^[ \n]|  | \n| $|\x00|\x{2581}") if self.cut else pc.greater(pc.binary_length(texts), 0)
        regular = pc.if_else(odd, "", texts)
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        regular = pc.binary_join_element_wise(pc.if_else(pc.equal(regular, empty), empty, space), regular, empty)
        lines = pc.replace_substring(regular, "\n", f"{MARK}\n")
        return odd, pc.split_pattern(pc.replace_substring(lines, " ", f"{MARK} "), MARK)

    def _encode_words(self, words: list[str]) -> None:
        for low in range(0, len(words), 8192):
            part = words[low:low + 8192]
            # the model adds the space ahead itself; ahead of a line end it stands alone
            rows = [ids[1:] if w.startswith("\n") else ids for w, ids in zip(part, self._batch([w.removeprefix(" ") for w in part]))]
            self._learn(part, np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows))), np.array(list(map(len, rows))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return PieceEncoder(path) if path.endswith(".model") else Encoder(path)


def byte_level(encoder: Encoder) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary, by id. Printable Latin-1 stands for itself, the other bytes
    for the characters from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def with_end(ids: np.ndarray, borders: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by ``end``."""
    n = len(borders) - 1
    more = borders + np.arange(n + 1)
    out = np.full(more[-1], end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[more[1:] - 1] = False
    out[keep] = ids
    return out, more


def parts(batch: pa.RecordBatch, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about ``size`` bytes together, one row at least."""
    length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    low = 0
    while low < batch.num_rows:
        high = min(batch.num_rows, max(low + 1, int(np.searchsorted(total, total[low] + size, "right")) - 1))
        yield batch.slice(low, high - low)
        low = high
