"""Media columns: payloads as MPEG transport streams, muxed into a binary column and demuxed from it.

The muxer writes a fixed layout, the demuxer reads any single-programme stream of 188-byte packets: programme
tables with their checksums, continuity counters, duplicate packets, adaptation fields, and elementary packets
with their time stamps and random-access points. Both work on all packets of a stream at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import text_slices, utf8_rows

PACKET, SYNC = 188, 0x47
#: Payload bytes of an access unit, and ticks of the 90 kHz clock that it lasts (8-bit samples at 8 kHz).
UNIT, TICKS = 576, 6480
PMT_PID, DATA_PID, PRIVATE = 0x100, 0x101, 0x06
#: Access units between two programme tables, and between two random-access points.
TABLES_EVERY, RANDOM_EVERY = 64, 8
STAMPS = 1 << 33


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of programme tables: polynomial 04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def mux(payload: bytes) -> bytes:
    """A transport stream of payload, whose length is a multiple of UNIT: an elementary packet of 4 transport packets a unit."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    at = np.arange(n)
    out = np.full((n, 4, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | ((4 * at[:, None] + np.arange(4)) & 15)
    out[:, 0, 3] |= 0x20
    out[:, 3, 3] |= 0x20
    pts = at.astype(np.int64) * TICKS % STAMPS
    out[:, 0, 4], out[:, 0, 5] = 7, np.where(at % RANDOM_EVERY == 0, 0x50, 0x10)
    for k, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + k] = (pts >> shift) & 255
    out[:, 0, 10], out[:, 0, 11] = ((pts & 1) << 7) | 0x7E, 0
    out[:, 0, 12:21] = np.frombuffer(b"\0\0\1\xbd" + (UNIT + 8).to_bytes(2, "big") + b"\x80\x80\x05", np.uint8)
    out[:, 0, 21] = 0x21 | ((pts >> 30) << 1)
    out[:, 0, 22], out[:, 0, 23] = (pts >> 22) & 255, ((pts >> 14) & 254) | 1
    out[:, 0, 24], out[:, 0, 25] = (pts >> 7) & 255, ((pts << 1) & 254) | 1
    out[:, 0, 26:] = units[:, :162]
    out[:, 1, 4:], out[:, 2, 4:] = units[:, 162:346], units[:, 346:530]
    stuffing = PACKET - 5 - 46
    out[:, 3, 4], out[:, 3, 5] = stuffing, 0
    out[:, 3, 5 + stuffing :] = units[:, 530:]
    tables = -(-n // TABLES_EVERY)
    heads = np.tile(np.stack([PAT, PMT]), (tables, 1, 1))
    heads[:, :, 3] |= (np.arange(tables) & 15).astype(np.uint8)[:, None]
    parts = [x for i in range(tables) for x in (heads[i].tobytes(), out[i * TABLES_EVERY : (i + 1) * TABLES_EVERY].tobytes())]
    return b"".join(parts)


@dataclass
class Demuxed:
    """What a stream holds: of each elementary packet its payload, time stamp (-1: none) and whether it can be entered at."""

    pid: int = -1
    stream_type: int = -1
    payload: bytes = b""
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    random_access: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    gaps: int = 0
    duplicates: int = 0
    table_errors: int = 0
    sync_errors: int = 0


def _start(packets: np.ndarray) -> np.ndarray:
    control = packets[:, 3] >> 4 & 3
    return np.where(control & 2, 5 + packets[:, 4].astype(np.int64), 4)


def _sections(packets: np.ndarray) -> Iterator[bytes | None]:
    """Sections that fit a packet; None for one whose checksum fails."""
    for head in {p.tobytes()[:3] + bytes([p[3] & 0xF0]) + p.tobytes()[4:] for p in packets[packets[:, 1] & 0x40 > 0]}:
        at = 5 + head[4] if head[3] & 0x20 else 4
        at += 1 + head[at] if at < PACKET else 0
        size = 3 + (int.from_bytes(head[at + 1 : at + 3], "big") & 0xFFF)
        body = head[at : at + size]
        yield body if len(body) == size and crc32_mpeg(body) == 0 else None


def demux(media: bytes) -> Demuxed:
    """Read the first elementary stream of the first programme. A duplicate packet is dropped; after a gap in the counters, what has come of the elementary packet is dropped too."""
    out = Demuxed()
    packets = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    out.sync_errors = int((~good).sum()) + (len(media) % PACKET > 0)
    packets = packets[good]
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    pmt = -1
    for body in _sections(packets[pids == 0]):
        if body is None:
            out.table_errors += 1
        elif body[0] == 0 and pmt < 0:
            entries = [(int.from_bytes(body[i : i + 2], "big"), int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(body) - 4, 4)]
            pmt = next((pid for number, pid in entries if number), -1)
    for body in _sections(packets[pids == pmt]) if pmt >= 0 else ():
        if body is None:
            out.table_errors += 1
        elif body[0] == 2 and out.pid < 0:
            at = 12 + (int.from_bytes(body[10:12], "big") & 0xFFF)
            if at + 5 <= len(body) - 4:
                out.stream_type, out.pid = body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
    own = packets[pids == out.pid] if out.pid >= 0 else packets[:0]
    own = own[own[:, 3] & 0x10 > 0]
    if not len(own):
        return out
    counter = own[:, 3].astype(np.int64) & 15
    again = np.r_[False, counter[1:] == counter[:-1]]
    if again.any():
        again[again] = (own[again] == own[np.flatnonzero(again) - 1]).all(axis=1)
        out.duplicates = int(again.sum())
        own, counter = own[~again], counter[~again]
    start = _start(own)
    told = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0)
    flags = np.where(told, own[:, 5], 0)
    gap = np.r_[False, (counter[1:] != (counter[:-1] + 1 & 15))]
    out.gaps = int((gap & (flags & 0x80 == 0)).sum())
    opens = own[:, 1] & 0x40 > 0
    number = np.cumsum(opens) - 1
    keep = number >= 0
    broken = np.unique(number[gap & ~opens & keep])
    before = np.unique(number[np.flatnonzero(gap & opens) - 1]) if (gap & opens).any() else np.zeros(0, np.int64)
    keep &= ~np.isin(number, np.r_[broken, before])
    if not keep.any():
        return out
    own, start, number, flags, opens = own[keep], start[keep], number[keep], flags[keep], opens[keep]
    data = own[np.arange(PACKET) >= start[:, None]]
    ends = np.cumsum(np.maximum(PACKET - start, 0))
    first = (ends - np.maximum(PACKET - start, 0))[opens]
    last = np.r_[first[1:], ends[-1]]
    whole = (last - first >= 9) & (data[np.minimum(first + 2, len(data) - 1)] == 1)
    first, last, flags = first[whole], last[whole], flags[opens][whole]
    at = lambda k: data[np.minimum(first + k, len(data) - 1)].astype(np.int64)
    declared = at(4) << 8 | at(5)
    begin = first + 9 + at(8)
    end = np.where(declared > 0, np.minimum(last, first + 6 + declared), last)
    sizes = np.maximum(end - begin, 0)
    stamp = (at(9) >> 1 & 7) << 30 | at(10) << 22 | (at(11) >> 1) << 15 | at(12) << 7 | at(13) >> 1
    index = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    out.payload, out.sizes = data[index].tobytes(), sizes
    out.pts = np.where(at(7) & 0x80 > 0, stamp, -1)
    out.random_access = flags & 0x40 > 0
    return out


def padded(text: bytes) -> bytes:
    """text with bytes 255 up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) of every whole text: its padded UTF-8 bytes as a transport stream. Null is empty; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = utf8_rows(part.column("text"))
                media = pa.array([mux(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(got: Demuxed) -> str:
    known = got.pts[got.pts >= 0]
    span = int((known[-1] - known[0]) % STAMPS) + TICKS if len(known) else 0
    return f"pid={got.pid};units={len(got.sizes)};random={int(got.random_access.sum())};pts={int(known[0]) if len(known) else -1};ticks={span};gaps={got.gaps};duplicates={got.duplicates};errors={got.table_errors + got.sync_errors}"


def media_features(media: DataFrame) -> DataFrame:
    """Read stored streams back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pts, random_access.

    pts has the time stamp of each elementary packet (-1: none), random_access the numbers of those that can be entered
    at. Null media is an empty stream, without packets; repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column("media"):
                raw = stored.as_py() or b""
                got = demux(raw)
                rows.append((len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), features(got), got.pts, np.flatnonzero(got.random_access)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else None
            if made:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>")
