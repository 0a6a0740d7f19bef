"""Media columns: Matroska files as packet tables.

``parse`` walks the variable-length EBML elements of a file (known and unknown sizes), its clusters, simple and
grouped blocks, the three lacings and the cues. ``mux`` writes a file that holds 8-bit PCM samples. ``packets``
is the operator: a binary column in, one row a packet out.

Defined cases: a null or empty column gives no packet; bytes that aren't Matroska, or end early, give the packets
read so far and the fault in ``error``; equal bytes give equal rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that may follow a cluster of unknown size and so end it.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE_HZ, FRAME, LACED, FRAMES_IN_CLUSTER = 8000, 512, 8, 64


def size_field(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones mean unknown, so that value takes a longer form."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_field(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def signed_size(n: int) -> bytes:
    """The difference of two frame sizes: the range of each width is centred on zero."""
    width = 1
    while abs(n) >= (1 << 7 * width - 1) - 1:
        width += 1
    return ((1 << 7 * width) | n + (1 << 7 * width - 1) - 1).to_bytes(width, "big")


def block_body(track: int, relative: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    """Frames as the body of a block. lacing: 0 none, 1 Xiph, 2 fixed size, 3 EBML; by default the shortest that fits."""
    if lacing is None:
        lacing = 0 if len(frames) == 1 else 2 if len({len(f) for f in frames}) == 1 else 3
    head = size_field(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    sizes = [len(f) for f in frames]
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:
        head += size_field(sizes[0]) + b"".join(signed_size(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit PCM, laced simple blocks and a cue for each cluster."""
    info = element(INFO, number(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio
    body = [info, element(TRACKS, element(TRACK, track))]
    at, cues, per = sum(map(len, body)), [], FRAME * FRAMES_IN_CLUSTER
    for start in range(0, len(samples), per):
        time = start * 1000 // RATE_HZ
        parts = [number(TIMESTAMP, time)]
        end = min(len(samples), start + per)
        for b in range(start, end, FRAME * LACED):
            frames = [samples[f : min(f + FRAME, end)] for f in range(b, min(b + FRAME * LACED, end), FRAME)]
            parts.append(element(SIMPLE, block_body(1, b * 1000 // RATE_HZ - time, frames)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, number(CUE_TIME, time) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    doc = number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2)
    return element(EBML, doc) + element(SEGMENT, b"".join(body))


class Damaged(ValueError):
    pass


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp, offset, size, key, lacing, cluster)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    error: str | None = None


def read_vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int | None, int]:
    """The integer at a place and the place after it; None is an unknown size."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"integer at {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, at: int, end: int):
    """(id, start of body, end of body, start of element) of each element in a body whose sizes are known."""
    while at < end:
        start = at
        ident, at = read_vint(data, at, end, True)
        size, at = read_vint(data, at, end, False)
        if size is None or at + size > end:
            raise Damaged(f"element {ident:x} at {start} is cut off")
        yield ident, at, at + size, start
        at += size


def uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def read_block(data: bytes, a: int, b: int, media: Media, time: int, key: bool | None, cluster: int) -> None:
    track, at = read_vint(data, a, b, False)
    if at + 3 > b:
        raise Damaged(f"block at {a} is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    sizes = []
    if lacing:
        if at >= b:
            raise Damaged(f"lacing at {at} is cut off")
        count, at = data[at] + 1, at + 1
        if lacing == 1:
            for _ in range(count - 1):
                n = 0
                while True:
                    if at >= b:
                        raise Damaged(f"lacing at {at} is cut off")
                    n, at, more = n + data[at], at + 1, data[at] == 255
                    if not more:
                        break
                sizes.append(n)
        elif lacing == 3 and count > 1:
            n, at = read_vint(data, at, b, False)
            sizes.append(n)
            for _ in range(count - 2):
                start = at
                raw, at = read_vint(data, at, b, False)
                width = at - start
                raw = (1 << 7 * width) - 1 if raw is None else raw
                sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
        elif lacing == 2:
            if (b - at) % count:
                raise Damaged(f"fixed lacing at {a} doesn't divide")
            sizes = [(b - at) // count] * (count - 1)
    last = b - at - sum(sizes)
    if last < 0 or any(n is None or n < 0 for n in sizes):
        raise Damaged(f"frames of the block at {a} pass its end")
    step = media.tracks.get(track, {}).get("duration", 0)
    for i, n in enumerate([*sizes, last]):
        media.packets.append((track, (time + relative) * media.scale + i * step, at, n, bool(flags & 0x80) if key is None else key, lacing, cluster))
        at += n


def read_cluster(data: bytes, a: int, b: int | None, end: int, media: Media, start: int) -> int:
    """Returns where the cluster ends; one of unknown size ends before the next top-level element."""
    media.clusters.append(start)
    index, time, at, stop = len(media.clusters) - 1, 0, a, end if b is None else b
    while at < stop:
        here = at
        ident, at = read_vint(data, at, stop, True)
        if b is None and ident in TOP_LEVEL:
            return here
        size, at = read_vint(data, at, stop, False)
        if size is None or at + size > stop:
            raise Damaged(f"element {ident:x} at {here} is cut off")
        if ident == TIMESTAMP:
            time = uint(data, at, at + size)
        elif ident == SIMPLE:
            read_block(data, at, at + size, media, time, None, index)
        elif ident == GROUP:
            inner = {i: (x, y) for i, x, y, _ in children(data, at, at + size)}
            if BLOCK in inner:
                read_block(data, *inner[BLOCK], media, time, REFERENCE not in inner, index)
        at += size
    return stop


def read_track(data: bytes, a: int, b: int, media: Media) -> None:
    track: dict = {}
    for ident, x, y, _ in children(data, a, b):
        if ident == NUMBER:
            track["number"] = uint(data, x, y)
        elif ident == KIND:
            track["kind"] = uint(data, x, y)
        elif ident == CODEC:
            track["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif ident == 0x23E383:
            track["duration"] = uint(data, x, y)
    media.tracks[track.get("number", 0)] = track


def parse(data: bytes) -> Media:
    media, at, end = Media(), 0, len(data)
    try:
        ident, x = read_vint(data, 0, end, True)
        if ident != EBML:
            raise Damaged("no EBML header")
        size, x = read_vint(data, x, end, False)
        at = x + (size or 0)
        ident, at = read_vint(data, at, end, True)
        if ident != SEGMENT:
            raise Damaged("no segment")
        size, base = read_vint(data, at, end, False)
        stop = end if size is None else min(end, base + size)
        at = base
        while at < stop:
            here = at
            ident, at = read_vint(data, at, stop, True)
            size, at = read_vint(data, at, stop, False)
            b = None if size is None else min(stop, at + size)
            if ident == CLUSTER:
                at = read_cluster(data, at, b, stop, media, here - base)
                continue
            if b is None:
                raise Damaged(f"element {ident:x} at {here} has no size")
            if ident == INFO:
                for i, x, y, _ in children(data, at, b):
                    media.scale = uint(data, x, y) if i == SCALE else media.scale
            elif ident == TRACKS:
                for i, x, y, _ in children(data, at, b):
                    if i == TRACK:
                        read_track(data, x, y, media)
            elif ident == CUES:
                for i, x, y, _ in children(data, at, b):
                    if i != CUE:
                        continue
                    time = 0
                    for j, u, v, _ in children(data, x, y):
                        if j == CUE_TIME:
                            time = uint(data, u, v)
                        elif j == CUE_AT:
                            inner = {k: uint(data, p, q) for k, p, q, _ in children(data, u, v)}
                            media.cues.append((time * media.scale, inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
            if size is not None and at + size > stop:
                raise Damaged(f"element {ident:x} at {here} is cut off")
            at = b
    except Damaged as e:
        media.error = str(e)
    return media


PACKETS = "id long, packet int, track int, codec string, timestamp_ns long, byte_offset long, byte_length long, keyframe boolean, lacing string, cluster int, cluster_offset long, cued boolean, error string"
LACINGS = ("none", "xiph", "fixed", "ebml")


def packets(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row a packet: track, time, byte range in the file, cluster, and whether a cue points at the cluster."""

    def table(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not data:
                continue
            m = parse(data)
            cued = {c for _, _, c in m.cues}
            rows += [(ident, i, t, m.tracks.get(t, {}).get("codec"), ts, at, n, k, LACINGS[lace], c, m.clusters[c], m.clusters[c] in cued, m.error) for i, (t, ts, at, n, k, lace, c) in enumerate(m.packets)]
            if m.error and not m.packets:
                rows.append((ident, None, None, None, None, None, None, None, None, None, None, None, m.error))
        if not rows:
            return None
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in PACKETS.split(", ")])

    return map_batches(df.select(df[key].cast("long").alias("id"), df[media].cast("binary").alias("media")), table, PACKETS)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes' number, and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def stored(text: str | None) -> bytes:
    return mux(payload_of(text)[1])


def read_back(media: bytes) -> tuple[bytes, Media]:
    m = parse(media)
    if m.error:
        raise ValueError(m.error)
    return b"".join(media[at : at + n] for _, _, at, n, _, _, _ in m.packets), m


def feature_of(payload: bytes, m: Media) -> str:
    """Packet table and signal in a line: counts, last time, sum, energy about the middle and crossings of it."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossed = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    laced = sum(1 for p in m.packets if p[5])
    return f"packets={len(m.packets)};laced={laced};clusters={len(m.clusters)};cues={len(m.cues)};last_ns={m.packets[-1][1]};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossed}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Each document's text stored as Matroska and read back from the stored bytes, one row a document."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column(1):
            n, payload = payload_of(text.as_py())
            media = mux(payload)
            back, m = read_back(media)
            for column, value in zip(out, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back, m)), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), rows, DIGEST)
