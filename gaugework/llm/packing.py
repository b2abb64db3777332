"""Packing token documents into fixed-length sequences by minimum bin slack.

Every partition packs its own documents, so nothing is shuffled. A document's whole windows become sequences of their
own. What remains of it, shorter than a window, waits in a pool of remainders; each sequence starts with the longest of
them, and a subset-sum table of bitsets over the pool's lengths finds the multiset that fills the rest of the window
closest to its capacity, with the counts of each length traced back. A slack that no multiset fills is filled by
cutting one remainder. Only the tail of a partition is left, and it goes to sequences whose lengths are powers of two,
which need no padding.

State is bounded: the pool holds at most POOL remainders, each shorter than a window.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.shipping import ship
from gaugework.llm.bpe import byte_letters, little_endian
from gaugework.llm.memo import own

WINDOW = 2048
POOL = 2048
END_ID = 1
MEMO = 150_000

_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS = "0-9²³¹¼½¾"
#: The words of the vocabulary in lower-cased Latin text.
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
#: What isn't Latin text that is composed already, lower-cased letter by letter, and has the same white space in every library.
NOT_PLAIN = re.compile("[^\t-\r -~\xa0-įı-ňŊ-ſ]|<\\|")


class Piece(NamedTuple):
    key: object
    start: int
    length: int
    crc: int
    total: int
    data: bytes


class Words:
    """The ids of a text as the tokenizers library gives them; words of Latin text come from a bounded memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.memo: dict[str, bytes] = {}

    def _learn(self, missing: list[str]) -> None:
        """Put words into the memo. They are in the library's normal form, so each goes to its merges alone, as byte letters."""
        for word in missing:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            self.memo[word] = array("I", [token.id for token in self.merge(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed native 32-bit ids."""
        if NOT_PLAIN.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = PLAIN_WORDS.findall(text.lower())
        packed = [*map(self.memo.get, found)]
        if None in packed:
            self._learn([*dict.fromkeys(w for w, ids in zip(found, packed, strict=True) if ids is None)])
            packed = map(self.memo.__getitem__, found)
        return b"".join(packed)


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def fill(lengths: list[int], count: Callable[[int], int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum not over ``capacity`` of a multiset of lengths, and how often each length is taken.

    ``lengths`` rises, and ``count`` says how many there are of each. Bit s of a table says that sum s can be reached;
    one table is kept for each bundle of 1, 2, 4 ... equal lengths, and the sums are traced back through them.
    """
    tables, bundles, mask = [1], [], (1 << capacity + 1) - 1
    for k in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[k]
        left, size = min(count(length), capacity // length), 1
        while left:
            n = min(size, left)
            tables.append(tables[-1] | tables[-1] << n * length & mask)
            bundles.append((length, n))
            left -= n
            size *= 2
        if tables[-1] >> capacity & 1:
            break
    best = target = tables[-1].bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for k in range(len(bundles), 0, -1):
        if not target:
            break
        if not tables[k - 1] >> target & 1:
            length, n = bundles[k - 1]
            taken[length] += n
            target -= n * length
    return best, dict(taken)


class Packer:
    """Packs the documents of one partition; ``first`` is the id of its first sequence."""

    def __init__(self, first: int = 0, window: int = WINDOW, pool: int = POOL):
        self.next, self.window, self.pool = first, window, pool
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []
        self.waiting = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((p.key, p.start, p.length, p.crc, p.total, self.next, offset))
            offset += p.length
        self.next += 1

    def add(self, key: object, packed: bytes) -> None:
        """A document's ids as little-endian 32-bit integers, its end id among them."""
        total = len(packed) // 4
        for start in range(0, total, self.window):
            data = packed[4 * start : 4 * min(start + self.window, total)]
            self._put(Piece(key, start, len(data) // 4, zlib.crc32(data), total, data))
        while self.waiting >= self.pool:
            self.sequence()

    def _put(self, p: Piece) -> None:
        if p.length == self.window:
            self.emit([p])
        else:
            if p.length in self.by_length:
                self.by_length[p.length].append(p)
            else:
                self.by_length[p.length] = [p]
                insort(self.lengths, p.length)
            self.waiting += 1

    def _take(self, length: int) -> Piece:
        found = self.by_length[length]
        p = found.pop()
        if not found:
            del self.by_length[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.waiting -= 1
        return p

    def _cut(self, p: Piece, length: int) -> Piece:
        """The first ``length`` ids of ``p``; the rest goes back to the pool."""
        head, rest = p.data[: 4 * length], p.data[4 * length :]
        self._put(Piece(p.key, p.start + length, p.length - length, zlib.crc32(rest), p.total, rest))
        return Piece(p.key, p.start, length, zlib.crc32(head), p.total, head)

    def sequence(self) -> None:
        """Fill one window from the pool, which must hold something."""
        longest = self._take(self.lengths[-1])
        slack = self.window - longest.length
        best, taken = fill(self.lengths, lambda n: len(self.by_length[n]), slack)
        pieces = [longest, *(self._take(n) for n in sorted(taken, reverse=True) for _ in range(taken[n]))]
        if (slack := slack - best) and self.lengths:  # every remainder that is left is longer than the slack
            pieces.append(self._cut(self._take(self.lengths[-1]), slack))
        self.emit(pieces) if sum(p.length for p in pieces) == self.window else self._tail(pieces)

    def _tail(self, pieces: list[Piece]) -> None:
        """The last pieces, fewer ids than a window: sequences of falling powers of two."""
        while pieces:
            size = 1 << sum(p.length for p in pieces).bit_length() - 1
            taken: list[Piece] = []
            while size:
                p = pieces.pop(0)
                if p.length > size:
                    head, rest = p.data[: 4 * size], p.data[4 * size :]
                    pieces.insert(0, Piece(p.key, p.start + size, p.length - size, zlib.crc32(rest), p.total, rest))
                    p = Piece(p.key, p.start, size, zlib.crc32(head), p.total, head)
                taken.append(p)
                size -= p.length
            self.emit(taken)

    def finish(self) -> None:
        while self.waiting:
            self.sequence()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are documents of their own. An empty table gives no rows.
    A sequence id is the number of the partition times 2**40 plus a count, so a task that runs again gives the same.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40, window, pool)
        encoder = words(vocabulary)
        encoder.memo = own(("packing", vocabulary))
        end = little_endian(array("I", [END_ID]).tobytes())
        schema = None

        def drained() -> pa.RecordBatch:
            rows = packer.drain()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

        for whole in batches:
            schema = pa.schema([pa.field(key, whole.schema.field(0).type), *(pa.field(n, pa.int64()) for n in NAMES)])
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    packer.add(k, little_endian(encoder.encode(t or "")) + end)
                yield drained()
        if schema is not None:
            packer.finish()
            yield drained()

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` bigint" for n in NAMES))
