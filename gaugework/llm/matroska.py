"""Matroska media columns: a writer for lossless 8-bit samples and a parser that gives packet tables.

A payload is stored as 8-bit PCM frames in SimpleBlocks. Equal-sized frames share a block with fixed-size lacing,
unequal ones with EBML or Xiph lacing, a single frame has none. The parser reads any nesting of variable-length
elements, known or unknown sizes, the four lacing modes and the cue index, and gives one row per packet with track,
timestamp, flags and the byte range of its frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from gaugework.functions.shipping import ship
from gaugework.llm.common import map_rows

# Fixed values of the container format: element identifiers.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

RATE = 8000
FRAME = 512
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 8
FRAME_MS = FRAME * 1000 // RATE


class Packet(NamedTuple):
    track: int
    timestamp: int
    keyframe: bool
    lacing: int
    cluster: int
    start: int
    length: int


@dataclass
class Container:
    doc_type: str
    scale: int
    duration: float
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]


def vint(value: int, width: int = 0) -> bytes:
    """A data size: a length marker, then the value; all ones are reserved for an unknown size."""
    n = width or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def lace(frames: list[bytes], mode: int) -> bytes:
    """The lacing header of a block and its frames."""
    if mode == NO_LACE:
        return frames[0]
    head = bytearray([len(frames) - 1])
    if mode == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif mode == EBML_LACE:
        head += vint(len(frames[0]))
        for before, f in zip(frames, frames[1:-1], strict=False):
            delta = len(f) - len(before)
            n = next(k for k in range(1, 9) if abs(delta) < (1 << (7 * k - 1)) - 1)
            head += vint(delta + (1 << (7 * n - 1)) - 1, n)
    return bytes(head) + b"".join(frames)


def block(frames: list[bytes], relative: int, mode: int | None = None, track: int = 1) -> bytes:
    if mode is None:
        mode = NO_LACE if len(frames) == 1 else FIXED if len({len(f) for f in frames}) == 1 else EBML_LACE if len(frames) % 2 else XIPH
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", relative, 0x80 | mode << 1) + lace(frames, mode))


def _fixed_head() -> bytes:
    return element(
        EBML,
        number(EBML_VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2),
    )


def _fixed_tracks() -> bytes:
    audio = real(SAMPLING, float(RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(AUDIO, audio)
    return element(TRACKS, element(TRACK_ENTRY, entry))


HEAD, TRACK_TABLE = _fixed_head(), _fixed_tracks()


def write(payload: bytes) -> bytes:
    """``payload`` as a Matroska file with clusters, laced blocks and cues."""
    body = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / RATE)), TRACK_TABLE]
    at, cues, per_cluster = sum(map(len, body)), [], FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(payload), per_cluster):
        time = first // FRAME * FRAME_MS
        blocks = [number(CLUSTER_TIME, time)]
        for start in range(first, min(first + per_cluster, len(payload)), FRAME * FRAMES_PER_BLOCK):
            end = min(start + FRAME * FRAMES_PER_BLOCK, len(payload))
            blocks.append(block([payload[i : min(i + FRAME, end)] for i in range(start, end, FRAME)], (start - first) // FRAME * FRAME_MS))
        whole = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(whole)
        body.append(whole)
    body.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and width of the variable-length number at ``at``; a size of all ones is -1 (unknown)."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off number at byte {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return raw, n
    value = raw ^ 1 << 7 * n
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def frame_sizes(data: bytes, at: int, end: int, mode: int) -> tuple[int, list[int]]:
    """Where the frames of a block begin, and their sizes."""
    if mode == NO_LACE:
        return at, [end - at]
    n, sizes = data[at] + 1, []
    at += 1
    if mode == FIXED:
        if (end - at) % n:
            raise ValueError("fixed-size lacing doesn't divide its block")
        return at, [(end - at) // n] * n
    if mode == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            value, width = read_vint(data, at)
            if value < 0:
                raise ValueError("a laced size of unknown length")
            sizes.append(sizes[-1] + value - (1 << (7 * width - 1)) + 1 if k else value)
            at += width
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed their block")
    return at, sizes


#: Elements that may stand directly in a segment; one of them ends a cluster of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}


def parse(data: bytes) -> Container:
    """Header, tracks, packet table and cue index of a Matroska file. Bytes that aren't one raise ValueError."""
    out = Container("", 1_000_000, 0.0, [], [], [], [])
    segment = cluster = 0
    base = 0
    stack: list[tuple[int, int]] = [(0, len(data))]
    at, cue = 0, [0, 0, 0]
    try:
        while at < len(data):
            while len(stack) > 1 and at >= stack[-1][1]:
                if stack.pop()[0] == CUE_POSITIONS:
                    out.cues.append((cue[0], cue[1], segment + cue[2]))
            began = at
            ident, n = read_vint(data, at, keep_marker=True)
            at += n
            size, n = read_vint(data, at)
            at += n
            if ident in TOP_LEVEL:
                while len(stack) > 2 and stack[-1][0] == CLUSTER and stack[-1][1] == len(data):
                    stack.pop()
            end = stack[-1][1] if size < 0 else at + size
            if end > stack[-1][1]:
                raise ValueError(f"element {ident:x} at byte {began} is longer than what holds it")
            if ident in MASTERS:
                stack.append((ident, end))
                if ident == SEGMENT:
                    segment = at
                elif ident == CLUSTER:
                    cluster, base = began, 0
                    out.clusters.append(began)
                elif ident == TRACK_ENTRY:
                    out.tracks.append({})
                continue
            body = data[at:end] if ident not in (SIMPLE_BLOCK, BLOCK) else b""
            value = int.from_bytes(body[:8], "big")
            if ident in (SIMPLE_BLOCK, BLOCK):
                track, n = read_vint(data, at)
                relative, flags = struct.unpack_from(">hB", data, at + n)
                mode = flags >> 1 & 3
                start, sizes = frame_sizes(data, at + n + 3, end, mode)
                step = next((t.get("default_ns", 0) for t in out.tracks if t.get("number") == track), 0) // max(1, out.scale)
                for k, length in enumerate(sizes):
                    out.packets.append(Packet(track, base + relative + k * step, bool(flags & 0x80) or ident == BLOCK, mode, cluster, start, length))
                    start += length
            elif ident == CLUSTER_TIME:
                base = value
            elif ident == DOC_TYPE:
                out.doc_type = body.decode("ascii", "replace")
            elif ident == TIMESTAMP_SCALE:
                out.scale = value
            elif ident == DURATION:
                out.duration = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
            elif ident == TRACK_NUMBER:
                out.tracks[-1]["number"] = value
            elif ident == CODEC_ID:
                out.tracks[-1]["codec"] = body.decode("ascii", "replace")
            elif ident == DEFAULT_DURATION:
                out.tracks[-1]["default_ns"] = value
            elif ident == BIT_DEPTH:
                out.tracks[-1]["bits"] = value
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(ident)] = value
            at = end
    except (IndexError, struct.error) as e:
        raise ValueError(f"cut off at byte {at}") from e
    while stack:
        if stack.pop()[0] == CUE_POSITIONS:
            out.cues.append((cue[0], cue[1], segment + cue[2]))
    return out


def read_payload(data: bytes, container: Container) -> bytes:
    return b"".join([data[p.start : p.start + p.length] for p in container.packets])


def pad(raw: bytes, multiple: int = 64) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple."""
    return raw + b"\0" * (-len(raw) % multiple if raw else multiple)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_clusters", "duration_ms"]
SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint, n_clusters bigint, duration_ms double"


def describe(text: str) -> tuple:
    """Store a text losslessly, read the stored bytes back and describe what came back."""
    raw = text.encode()
    media = write(pad(raw))
    c = parse(media)
    back = read_payload(media, c)
    lacing = [sum(p.lacing == k for p in c.packets) for k in (NO_LACE, XIPH, FIXED, EBML_LACE)]
    indexed = sum(at in c.clusters for _, _, at in c.cues)
    mean = sum(back) / len(back)
    feature = f"codec={c.tracks[0]['codec']};bits={c.tracks[0]['bits']};packets={len(c.packets)};clusters={len(c.clusters)};cues={indexed};lacing={','.join(map(str, lacing))};last_ms={c.packets[-1].timestamp};mean={mean:.6f};zeros={back.count(0)}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(c.packets), len(c.clusters), c.duration


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document. A null or empty text is 64 bytes 0; equal texts give equal values; an empty table, no rows.

    Every row is handled for itself, so repeated rows and ties give repeated results.
    """
    return map_rows(docs, [key], text, SCHEMA, describe, NAMES)


def packet_table(media: DataFrame, key: str, content: str) -> DataFrame:
    """The packets of each Matroska file of a binary column, with byte ranges; null or broken files give no rows."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(k, i, *p) for i, p in enumerate(parse(data).packets)] if data else []
                except ValueError:
                    continue
            names = [key, "packet", *Packet._fields]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([pa.field(key, batch.schema.field(0).type), *(pa.field(n, pa.bool_() if n == "keyframe" else pa.int64()) for n in names[1:])]))

    ship(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    rest = ", ".join(f"{n} {'boolean' if n == 'keyframe' else 'bigint'}" for n in Packet._fields)
    return media.select(key, content).mapInArrow(run, f"`{key}` {kind}, packet bigint, {rest}")
