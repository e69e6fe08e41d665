"""Media columns in Matroska: a writer and a parser of EBML elements, clusters, lacing and cues.

The parser turns a file into a packet table: track, timestamp and byte range of every frame, read from the element tree
without copying payload. The frames of a laced block follow each other by the track's default duration; without one they
share the block's time. It takes all four lacing modes, simple blocks and block groups, unknown sizes, and elements
that it does not know; a damaged or cut file gives the packets before the damage and ``complete`` = false.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK, AUDIO, GROUP, CUE_POINT, CUE_AT = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK, AUDIO, GROUP, CUE_POINT, CUE_AT}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
SCALE, STAMP, SIMPLE, BLOCK, FRAME_NS = 0x2AD7B1, 0xE7, 0xA3, 0xA1, 0x23E383
UNIT, RATE, LACED, BLOCKS = 576, 8000, 8, 32
MOST_DEPTH = 16


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """The shortest variable-length integer for ``n``, or one of ``width`` bytes; all ones means unknown and is avoided."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: int) -> bytes:
    """Lacing header and frames: mode 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if mode == 0:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if mode == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif mode == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def write(payload: bytes, unit: int = UNIT, rate: int = RATE, mode: int = 2) -> bytes:
    """8-bit samples of one channel as a Matroska file: frames of ``unit`` samples, laced, in clusters with cues."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    millis = lambda sample: sample * 1000 // rate
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4489, struct.pack(">d", len(payload) * 1000 / rate)) + element(0x4D80, b"quern") + element(0x5741, b"quern"))
    audio = element(AUDIO, element(0xB5, struct.pack(">d", rate)) + uint(0x9F, 1) + uint(0x6264, 8))
    tracks = element(TRACKS, element(TRACK, uint(0xD7, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + uint(FRAME_NS, unit * 1_000_000_000 // rate) + element(0x86, b"A_PCM/INT/LIT") + audio))
    body, cues, step = [info, tracks], [], unit * LACED
    at = len(info) + len(tracks)
    for first in range(0, len(payload), step * BLOCKS):
        began = millis(first)
        parts = [uint(STAMP, began)]
        for b in range(first, min(first + step * BLOCKS, len(payload)), step):
            frames = [payload[k : k + unit] for k in range(b, min(b + step, len(payload)), unit)]
            m = mode if len(frames) > 1 else 0
            parts.append(element(SIMPLE, vint(1) + struct.pack(">h", millis(b) - began) + bytes([0x80 | m_bits(m)]) + lace(frames, m)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(0xB3, began) + element(CUE_AT, uint(0xF7, 1) + uint(0xF1, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(body + [element(CUES, b"".join(cues))]))


def m_bits(mode: int) -> int:
    """Lacing mode to the block's flag bits: 01 Xiph, 10 fixed, 11 EBML, in bits 2 and 1."""
    return mode << 1


@dataclass
class Parsed:
    """``packets``: (track, timestamp in ns, first byte, size, keyframe, lacing mode, cluster); ``cues``: (time in ns, track, byte of the cluster)."""

    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    clusters: int = 0
    scale: int = 1_000_000
    complete: bool = True


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("bad variable-length integer")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            n = -1  # unknown
    return n, at + width


def _block(data: bytes, at: int, end: int, began: int, out: Parsed, simple: bool) -> None:
    track, at = _vint(data, at)
    stamp, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    mode = flags >> 1 & 3
    if mode == 0:
        sizes = [end - at]
    else:
        n = data[at] + 1
        at += 1
        sizes = []
        if mode == 1:
            while len(sizes) < n - 1:
                s = 0
                while data[at] == 255:
                    s, at = s + 255, at + 1
                sizes.append(s + data[at])
                at += 1
        elif mode == 3:
            for k in range(n - 1):
                was = at
                s, at = _vint(data, at)
                sizes.append(s if k == 0 else sizes[-1] + s - ((1 << 7 * (at - was) - 1) - 1))
        else:
            sizes = [(end - at) // n] * (n - 1)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or mode == 2 and len({*sizes}) > 1:
        raise ValueError("bad lacing")
    time = (began + stamp) * out.scale
    step = next((t.get("frame_ns", 0) for t in out.tracks if t.get("number") == track), 0)
    for s in sizes:
        out.packets.append((track, time, at, s, bool(flags & 0x80) if simple else True, mode, out.clusters - 1))
        at, time = at + s, time + step


def parse(data: bytes) -> Parsed:
    out = Parsed()
    state = {"began": 0, "segment": 0, "track": {}, "cue": [0, 0, 0]}
    strings = {0x86: "codec"}
    numbers = {0xD7: "number", 0x83: "kind", 0x9F: "channels", 0x6264: "bits", FRAME_NS: "frame_ns"}

    def walk(at: int, end: int, inside: int, depth: int) -> int:
        while at < end:
            was = at
            kind, at = _vint(data, at, keep=True)
            if inside == CLUSTER and kind in TOP:
                return was  # a cluster of unknown size ends here
            size, at = _vint(data, at)
            stop = end if size < 0 else at + size
            if stop > end:
                out.complete = False
                if kind not in MASTERS:
                    return end
                stop = end
            if kind in MASTERS:
                if depth >= MOST_DEPTH:
                    raise ValueError("nested too deep")
                if kind == SEGMENT:
                    state["segment"] = at
                elif kind == CLUSTER:
                    out.clusters += 1
                    state["began"] = 0
                elif kind == TRACK:
                    state["track"] = {}
                    out.tracks.append(state["track"])
                elif kind == CUE_POINT:
                    state["cue"] = [0, 0, 0]
                reached = walk(at, stop, kind, depth + 1)
                if kind == CUE_AT:
                    t, track, where = state["cue"]
                    out.cues.append((t * out.scale, track, state["segment"] + where))
                if size < 0:
                    stop = reached
            elif kind == SIMPLE or kind == BLOCK:
                _block(data, at, stop, state["began"], out, kind == SIMPLE)
            elif kind in strings:
                state["track"][strings[kind]] = data[at:stop].decode("utf-8", "replace")
            elif kind == 0xB5:
                state["track"]["rate"] = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0]
            elif size <= 8:
                n = int.from_bytes(data[at:stop], "big")
                if kind == STAMP:
                    state["began"] = n
                elif kind == SCALE:
                    out.scale = n
                elif kind in numbers:
                    state["track"][numbers[kind]] = n
                elif kind in (0xB3, 0xF7, 0xF1):
                    state["cue"][(0xB3, 0xF7, 0xF1).index(kind)] = n
            at = stop
        return at

    try:
        walk(0, len(data), 0, 0)
    except (ValueError, IndexError, struct.error):
        out.complete = False
    return out


def read_back(data: bytes) -> tuple[bytes, Parsed]:
    """The samples of the first track, gathered over the packets' byte ranges."""
    p = parse(data)
    return b"".join([data[at : at + size] for track, _, at, size, *_ in p.packets if track == 1]), p


def features(samples: bytes, p: Parsed) -> str:
    """Counts from the packet table, and level and zero-crossing rate of the samples (8-bit, silence at 128), as text."""
    x = np.frombuffer(samples, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    stamps = [t[1] for t in p.packets]
    t = p.tracks[0]
    return (
        f"codec={t['codec']};rate={t['rate']:.0f};bits={t['bits']};packets={len(stamps)};clusters={p.clusters};cues={len(p.cues)};"
        f"last_ms={stamps[-1] // 1_000_000};sum={total};square={square};crossings={crossings}"
    )


def packet_table(media: DataFrame, key: str = "doc_id", data: str = "media") -> DataFrame:
    """One row per packet of the binary column ``data``: key, track, timestamp_ns, first_byte, n_bytes, keyframe, lacing, cluster, complete.

    Null and empty values have no packets; a damaged file gives those before the damage.
    """
    names = ["key", "track", "timestamp_ns", "first_byte", "n_bytes", "keyframe", "lacing", "cluster", "complete"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches):
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = parse(d or b"")
                rows = [(k, *x, p.complete) for x in p.packets]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    schema = "key string, track long, timestamp_ns long, first_byte long, n_bytes long, keyframe boolean, lacing int, cluster int, complete boolean"
    return media.select(F.col(key).cast("string").alias("key"), F.col(data).alias("data")).mapInArrow(run, schema)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def media_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): every text's UTF-8 bytes, padded, as a Matroska file; null counts as empty."""

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).cast(pa.binary()).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([write(pad(t or b""))], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, media binary")


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text is stored as Matroska and read back within its task, so the files themselves are never shuffled. Null and
    empty texts have a payload of one unit of bytes 255; a null id stays null; an empty table gives an empty result.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(data: bytes) -> tuple:
        media = write(pad(data))
        payload, p = read_back(media)
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, p)

    def run(batches):
        for b in batches:
            rows = [one(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.string() if i in (2, 5, 6) else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
