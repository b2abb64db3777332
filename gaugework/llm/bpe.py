"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

**Sufficient lookahead.** Let two inputs share a prefix ``w``. Before any merge their symbols agree up to the end of
``w``. The point ``d`` up to which they agree moves left only when a merge ``(u, v)`` joins the last agreed symbol ``u``
with a ``v`` that begins at ``d`` in one input alone; then it moves by ``len(u)``, and what begins at the new ``d`` has
``u`` on its left spine. A later such merge ``(u', v')`` therefore has ``u`` on the left spine of ``v'`` and a higher
rank. The longest such chain, found in one pass over the merges in rank order, bounds how far text can act back on
earlier tokens: a token that ends at least that many bytes before the end of what has been read is final.

**Encoding** reads a text in chunks. Where one class of characters ends and another begins no token of the byte-level
pre-tokenizer spans the place (but for white space and apostrophes before letters), so words come out as soon as they
can't change, and a word of any length comes out in pieces. Each word goes through the transducer, which holds no more
than one window of bytes; what it emits for short words is kept in a bounded memo. Ids go on to the consumer chunk by
chunk, so besides the text itself nothing grows with its length.

**Decoding** feeds the bytes of ids to an incremental decoder, whose state is the bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
import pandas as pd
from pyspark.sql import DataFrame

from gaugework.functions.shipping import ship
from gaugework.llm.common import map_rows
from gaugework.llm.memo import own

# Fixed value: the word pattern of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SHIFT = 20
MASK = (1 << SHIFT) - 1
NEVER = 1 << 62
MEMO = 400_000
MEMO_WORD = 64
#: Characters of a text that are encoded at a time, and of a run of one class that is held before it comes out in pieces.
CHUNK, RUN = 1 << 15, 1 << 10
SPACE, LETTER, DIGIT, OTHER = r"\p{White_Space}", r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]"
#: Places that no token spans, searched from the end.
CUT = rf"(?r)(?:{LETTER}(?!{LETTER})|{DIGIT}(?!{DIGIT})|{OTHER}(?={DIGIT}|{SPACE}))(?=.)"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The sufficient lookahead of a merge list in bytes."""
    longest: dict[bytes, int] = {}
    left: dict[bytes, bytes] = {}
    most = 0
    for u, v in merges:
        spine: bytes | None = v
        chain = 0
        while spine is not None:
            chain = max(chain, longest.get(spine, 0))
            spine = left.get(spine)
        chain += len(u)
        longest[u] = max(longest.get(u, 0), chain)
        left.setdefault(u + v, u)
        most = max(most, chain)
    return most


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(raw(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.pairs = {vocab[u] << SHIFT | vocab[v]: rank << SHIFT | vocab[u + v] for rank, (u, v) in enumerate(merges)}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.lookahead = lookahead(merges)
        self.window = 2 * self.lookahead + 384
        self.words, self.cut = regex.compile(WORDS), regex.compile(CUT, regex.DOTALL)
        self.runs = {c: regex.compile(f"{c}*") for c in (SPACE, LETTER, DIGIT, OTHER)}
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one window completely: lowest rank first, leftmost among equals."""
        get = self.pairs.get
        if len(ids) > 48:
            return self._merge_long(ids)
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            new = best & MASK
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << SHIFT | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As merge, with a heap over a linked list."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << SHIFT | ids[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank & MASK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << SHIFT | ids[k], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << SHIFT | ids[i], NEVER)) != NEVER:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word that arrives in chunks of any size; holds a window of bytes and a chunk at most."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) >= self.window:
                ids = self.merge([self.byte_ids[b] for b in held[: self.window]])
                done, stable = 0, self.window - self.lookahead
                for i in ids:
                    n = len(self.bytes_of[i])
                    if done + n > stable:
                        break
                    done += n
                    yield i
                held = held[done:]
        if held:
            yield from self.merge([self.byte_ids[b] for b in held])

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        found = array("I", self.transduce((raw,))).tobytes()
        if len(word) <= MEMO_WORD:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def segments(self, chunks: Iterable[str]) -> Iterator[tuple[str, str | None]]:
        """The text between special tokens in pieces, and with the last piece before each the token that follows."""
        if not self.splitter:
            yield from ((c, None) for c in chunks)
            return
        held, longest = "", max(map(len, self.special))
        for chunk in chunks:
            held += chunk
            while m := self.splitter.search(held):
                yield held[: m.start()], m.group()
                held = held[m.end() :]
            keep = next((n for n in range(min(longest - 1, len(held)), 0, -1) if any(s.startswith(held[-n:]) for s in self.special)), 0)
            if len(held) > keep:
                yield held[: len(held) - keep], None
                held = held[len(held) - keep :]
        yield held, None

    def pieces(self, chunks: Iterable[str]) -> Iterator[list[str] | tuple[str, bool]]:
        """Words of a text without special tokens as it arrives: lists of whole words, and pieces of long ones with whether the word ends."""
        held, inside = "", None
        for chunk in chunks:
            held += chunk
            if inside:
                n = self.runs[inside].match(held).end()
                if n == len(held):  # of white space the last stands back: it may begin the next word
                    n -= inside == SPACE
                    yield held[:n], False
                    held = held[n:]
                    continue
                n -= inside == SPACE
                yield held[:n], True
                held, inside = held[n:], None
            if m := self.cut.search(held):
                yield self.words.findall(held[: m.end()])
                held = held[m.end() :]
            if len(held) > RUN:
                *whole, last = self.words.findall(held)
                if len(last) <= 16:  # an apostrophe near the end may still become one word with what follows
                    while whole and len(last) < 3:
                        last = whole.pop() + last
                    yield whole
                    held = last
                    continue
                inside = next(c for c, run in self.runs.items() if run.fullmatch(last[-1]))
                n = len(last) - (inside == SPACE)
                yield whole
                yield last[:n], False
                held = last[n:]
        if inside:
            n = self.runs[inside].match(held).end() if held else 0
            yield held[:n], True
            held = held[n:]
        yield self.words.findall(held)

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """The ids of a text that arrives in chunks, as packed native 32-bit integers; holds a chunk and a window."""
        known, word = self.memo.get, self._word
        parts, special = self.segments(chunks), ""

        def until_special() -> Iterator[str]:
            nonlocal special
            special = ""
            for text, token in parts:
                yield text
                if token is not None:
                    special = token
                    return

        while True:
            found = self.pieces(until_special())
            for item in found:
                if isinstance(item, list):
                    yield b"".join([known(w) or word(w) for w in item])
                    continue

                def long(first=item) -> Iterator[bytes]:
                    yield first[0].encode()
                    ended = first[1]
                    while not ended:
                        more, ended = next(found)
                        yield more.encode()

                out = array("I")
                for i in self.transduce(long()):
                    out.append(i)
                    if len(out) == CHUNK:
                        yield out.tobytes()
                        out = array("I")
                yield out.tobytes()
            if not special:
                return
            yield array("I", [self.special[special]]).tobytes()

    def encode(self, text: str) -> list[int]:
        out = array("I")
        for packed in self.encode_stream(in_chunks(text)):
            out.frombytes(packed)
        return out.tolist()

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of parts of ids as it becomes certain: bytes of an unfinished character are the only state."""
        state, table, n = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of, len(self.bytes_of)
        for part in parts:
            yield state.decode(b"".join([table[i] if 0 <= i < n else b"" for i in part]))
        yield state.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        return "".join(self.decode_stream(ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)))


def in_chunks(text: str) -> Iterator[str]:
    return (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def little_endian(packed: bytes) -> bytes:
    import sys

    if sys.byteorder == "little":
        return packed
    swapped = array("I", packed)
    swapped.byteswap()
    return swapped.tobytes()


def digest(path: str) -> Callable[[str], tuple]:
    def row(text: str) -> tuple:
        c = codec(path)
        c.memo = own(("bpe", path))
        hashed, decoded, n = hashlib.sha256(), hashlib.sha256(), 0

        def ids() -> Iterator[array]:
            nonlocal n
            for packed in c.encode_stream(in_chunks(text)):
                hashed.update(little_endian(packed))
                n += len(packed) // 4
                yield array("I", packed)

        for part in c.decode_stream(ids()):
            decoded.update(part.encode())
        return n, hashed.hexdigest(), decoded.hexdigest()

    return row


def roundtrip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and decoded text of every document as digests: n_tokens, ids_sha256, decoded_sha256.

    ``vocabulary`` is the path of the tokenizer file, which every executor must have. A null text is an empty one and
    has no tokens; rows are handled one by one, so repeated rows give repeated results; an empty table gives no rows.
    """
    return map_rows(docs, [key], text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest(vocabulary), ["n_tokens", "ids_sha256", "decoded_sha256"])


def encode_column(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves: key, ids array<int>."""
    return map_rows(docs, [key], text, "ids array<int>", lambda t: (codec(vocabulary).encode(t),), ["ids"])


def decode_column(ids: DataFrame, vocabulary: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """The text of an id array: key, text. A null array is an empty one."""
    from pyspark.sql import functions as F

    ship(ids.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: codec(vocabulary).decode([] if x is None else x))

    return ids.select(key, text(column).alias("text"))
