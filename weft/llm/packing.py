"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Lengths fall into reciprocal-capacity classes: class k holds documents of more than ``capacity / (k + 1)`` and at most ``capacity / k`` ids, and each of its
bins takes exactly k of them, whole. Each worker fills the bins of every class on its own, so nothing is shuffled. What a full bin still lacks
is a gap; gaps are filled with pieces of documents that are cut for this: the remainders of documents longer than a sequence, and
documents of over half a sequence, which would leave the largest gaps themselves, as long as gaps wait for so much. So most documents
stay whole and no sequence is padded. What is open at the end of a worker's partition goes first-fit into bins, the emptiest are dissolved into the
others' gaps, and the last one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take_memory, text_batches

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bins with a gap that a worker keeps waiting; beyond, the next document is cut whatever its length.
WAITING = 256
#: Pre-tokens whose ids a worker remembers; the memory is emptied when full.
CACHE_WORDS = 400_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "size_class int"
)

# Characters whose normal form, case and class are alike for every Unicode version: ASCII and Latin-1 letters.
_UNSAFE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
# The tokenizer's own pre-token pattern, for lower-cased text of those characters.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to the library's for the whole text.

    The tokenizer merges within pre-tokens only, so ids of a pre-token can be remembered. Texts with characters beyond ASCII
    and Latin-1 letters, or with a special token's string, go to the library as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.limit = cache_words

    def _ids(self, pre: list[str]) -> list[bytes]:
        """Ids of each pre-token, from one call: white space parts them and has no ids of its own."""
        e = self.tok.encode(" ".join(pre), add_special_tokens=False)
        ids, ends = np.array(e.ids, "<u4").tobytes(), np.cumsum(np.bincount(e.word_ids, minlength=len(pre))).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def __call__(self, text: str) -> bytes:
        if _UNSAFE.search(text) or _SPECIAL.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pre = _PRE.findall(text.lower())
        try:
            return b"".join(map(self.cache.__getitem__, pre))
        except KeyError:
            new = [p for p in set(pre) if p not in self.cache]
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = list(set(pre))
        self.cache.update(zip(new, self._ids(new), strict=True))
        return b"".join(map(self.cache.__getitem__, pre))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Piece:
    """Ids of one document from ``start`` on; ``size_class`` 0 if it was cut to fill gaps."""

    __slots__ = ("doc_id", "start", "ids", "total", "size_class")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, total: int, size_class: int):
        self.doc_id, self.start, self.ids, self.total, self.size_class = doc_id, start, ids, total, size_class

    def __len__(self) -> int:
        return len(self.ids) // 4

    def take(self, n: int) -> Piece:
        """The first ``n`` ids, which this piece then lacks; all of them if there are no more."""
        if n >= len(self):
            head = Piece(self.doc_id, self.start, self.ids, self.total, self.size_class)
            self.ids = b""
            return head
        head = Piece(self.doc_id, self.start, self.ids[: 4 * n], self.total, 0)
        self.start, self.ids, self.size_class = self.start + n, self.ids[4 * n :], 0
        return head


class HarmonicPacker:
    """Bins of one worker. ``add`` and ``close`` give finished rows; what is held is bounded by the number of classes and ``WAITING``."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, waiting: int = WAITING):
        self.capacity, self.most = capacity, waiting
        self.next_id = first_id
        self.open: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int, list[Piece]]] = []  # heap by the largest gap: (-gap, number, pieces)
        self.room = 0  # sum of the gaps
        self.made = 0

    def _rows(self, pieces: list[Piece]) -> Iterator[tuple]:
        """One sequence."""
        seq, offset = self.next_id, 0
        self.next_id += 1
        for p in pieces:
            yield (p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.total, seq, offset, p.size_class)
            offset += len(p)

    def _wait(self, gap: int, pieces: list[Piece]) -> None:
        heapq.heappush(self.gaps, (-gap, self.made, pieces))
        self.made += 1
        self.room += gap

    def _fill(self, piece: Piece) -> Iterator[tuple]:
        """Cut a piece into the largest gaps, until it or they end."""
        while len(piece) and self.gaps:
            gap, _, pieces = heapq.heappop(self.gaps)
            self.room += gap
            pieces.append(piece.take(-gap))
            left = -gap - len(pieces[-1])
            if left:
                self._wait(left, pieces)
            else:
                yield from self._rows(pieces)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        piece = Piece(doc_id, 0, ids, len(ids) // 4, 0)
        whole = len(piece) <= self.capacity
        while len(piece) >= self.capacity:
            head = piece.take(self.capacity)
            head.size_class = 1
            yield from self._rows([head])
        n = len(piece)
        if not n:
            return
        large = not whole or 2 * n > self.capacity
        if large and n <= self.room or len(self.gaps) >= self.most:
            yield from self._fill(piece)
            n = len(piece)
            if not n:
                return
        k = self.capacity // n
        piece.size_class = k
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            del self.open[k]
            gap = self.capacity - sum(map(len, own))
            if gap:
                self._wait(gap, own)
            else:
                yield from self._rows(own)

    def close(self) -> Iterator[tuple]:
        rest = sorted((p for own in self.open.values() for p in own), key=len, reverse=True)
        bins = [[self.capacity + gap, pieces] for gap, _, pieces in sorted(self.gaps)]  # [ids, pieces]
        self.open, self.gaps, self.room = {}, [], 0
        for p in rest:
            own = next((b for b in bins if b[0] + len(p) <= self.capacity), None)
            if own is None:
                own = [0, []]
                bins.append(own)
            own[0] += len(p)
            own[1].append(p)
        bins.sort(key=lambda b: -b[0])
        full = sum(b[0] for b in bins) // self.capacity  # so many sequences; the other bins' pieces fill these
        for held, pieces in bins[:full]:
            if held < self.capacity:
                self._wait(self.capacity - held, pieces)
            else:
                yield from self._rows(pieces)
        tail: list[Piece] = []
        for _, pieces in bins[full:]:
            for p in pieces:
                yield from self._fill(p)
                if len(p):
                    tail.append(p)
        left = sum(map(len, tail))
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            own = []
            while room:
                own.append(tail[0].take(room))
                room -= len(own[-1])
                if not len(tail[0]):
                    tail.pop(0)
            yield from self._rows(own)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack every document of ``docs``; one row per piece, see ``SCHEMA``.

    A null or empty text is the end id alone. A null id stays null; rows with one id are separate documents. Texts of any length
    are cut into full sequences, whose remainder is packed as a document of its length. An empty table gives no rows. Other columns, whatever their names, are ignored.
    ``size_class`` is the reciprocal class of a piece, 0 where it was cut to fill gaps.
    ``sequence_id`` holds the partition in its upper bits, so workers never meet and a retried task gives the same rows.
    """

    def worker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("packing", encoder.cache_clear)
        encode, tail = encoder(tokenizer), end_id.to_bytes(4, "little")
        packer = HarmonicPacker(TaskContext.get().partitionId() << 33, capacity)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend(packer.add(doc_id, encode(text.as_py() or "") + tail))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield batch(rows)

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(worker, SCHEMA)
