"""Matroska and WebM: tracks and frames, with each kind of lacing, and elements whose size is not known."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Element ids of RFC 9559.
EBML, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, ENTRY, NUMBER, TYPE, CODEC, LANGUAGE, NAME, LENGTH = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x22B59C, 0x536E, 0x23E383
AUDIO, RATE, CHANNELS, BITS = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE, SPAN = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B

HOLDERS = frozenset((SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP))
#: Holders that end one of unknown size.
TOP = frozenset((INFO, TRACKS, CLUSTER, 0x114D9B74, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367))
KINDS = {1: "video", 2: "audio", 17: "subtitle"}
TRACK_ROWS = "path string, track_id long, kind string, codec string, language string, name string, rate double, channels int, bits int, error string"
FRAME_ROWS = "path string, track_id long, frame long, timestamp_ns long, keyframe boolean, offset long, size long"


class MatroskaError(ValueError):
    pass


class CutOff(MatroskaError):
    """The data end within a number."""


def vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int]:
    """(value, bytes) of a number of variable length, with or without its marker; -1 for a size that is not known."""
    if at >= len(data):
        raise CutOff(f"no number at {at}")
    if not data[at]:
        raise MatroskaError(f"no number at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise CutOff(f"a number at {at} is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if marker:
        return value, n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def elements(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(id, body, end) in order, holders before what they hold. A last element that is cut off ends the walk."""
    at = 0
    while at < len(data):
        if not data[at]:
            return
        try:
            kind, n = vint(data, at, marker=True)
            size, m = vint(data, at + n)
        except CutOff:
            return
        body = at + n + m
        end = len(data) if size < 0 else body + size
        if size < 0 and kind not in (SEGMENT, CLUSTER):
            raise MatroskaError("only segments and clusters may have no size")
        if end > len(data) and kind not in HOLDERS:
            return
        yield kind, body, min(end, len(data))
        at = body if kind in HOLDERS else end


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block from what follows its flags."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError("a laced block without a count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:  # Xiph: sums of bytes up to one below 255
        for _ in range(count - 1):
            total = 0
            while at < end and data[at] == 255:
                total, at = total + 255, at + 1
            if at >= end:
                raise MatroskaError("lace sizes are cut off")
            sizes.append(total + data[at])
            at += 1
    elif kind == 3:  # EBML: the first size, then differences about a middle
        for i in range(count - 1):
            value, n = vint(data, at)
            if value < 0:
                value = (1 << 7 * n) - 1
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * n - 1) - 1))
            at += n
    else:
        if (end - at) % count:
            raise MatroskaError("a block does not part into equal frames")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("laces are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> tuple[list[dict], list[dict]]:
    """Tracks and frames. Laced frames follow each other by the track's default duration, where it has one."""
    if data[:4] != EBML.to_bytes(4, "big"):
        raise MatroskaError("no EBML header")
    tracks: list[dict] = []
    blocks: list[tuple[int, int, int, bool, int]] = []
    scale, cluster, referring, span = 1_000_000, 0, -1, 0
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0
    text = lambda a, b: data[a:b].split(b"\0")[0].decode("utf-8", "replace")
    fields = {NUMBER: ("track_id", number), CODEC: ("codec", text), LANGUAGE: ("language", text), NAME: ("name", text), LENGTH: ("default_ns", number), RATE: ("rate", real), CHANNELS: ("channels", number), BITS: ("bits", number)}
    for kind, a, b in elements(data):
        if kind == SCALE:
            scale = number(a, b)
        elif kind == ENTRY:
            tracks.append({"language": "eng"})
        elif kind == TYPE and tracks:
            tracks[-1]["kind"] = KINDS.get(number(a, b), str(number(a, b)))
        elif kind == AUDIO and tracks:
            tracks[-1] = {"rate": 8000.0, "channels": 1} | tracks[-1]
        elif kind in fields and tracks:
            tracks[-1][fields[kind][0]] = fields[kind][1](a, b)
        elif kind == TIMESTAMP:
            cluster = number(a, b)
        elif kind == SIMPLE:
            blocks.append((a, b, cluster, True, 0))
        elif kind == GROUP:
            referring, span = -1, b
        elif kind == BLOCK:
            blocks.append((a, b, cluster, False, 0))
            referring = len(blocks) - 1
        elif kind == REFERENCE and a < span and referring >= 0:
            blocks[referring] = (*blocks[referring][:4], 1)
    own = {t.get("track_id"): t for t in tracks}
    counts: dict[int, int] = {}
    frames = []
    for a, b, base, simple, refers in blocks:
        track, n = vint(data, a)
        if a + n + 3 > b:
            raise MatroskaError("a block is too short")
        delta, flags = struct.unpack_from(">hB", data, a + n)
        step = own.get(track, {}).get("default_ns", 0)
        for i, (at, size) in enumerate(_laced(data, a + n + 3, b, flags >> 1 & 3)):
            no = counts[track] = counts.get(track, -1) + 1
            frames.append({"track_id": track, "frame": no, "timestamp_ns": (base + delta) * scale + i * step, "keyframe": bool(flags & 0x80) if simple else not refers, "offset": at, "size": size})
    return tracks, frames


def _read(spark: SparkSession, path: str, which: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows = parse(bytes(data))[which]
                except MatroskaError as e:
                    rows = [] if which else [{"error": str(e)}]
                yield pd.DataFrame([{"path": p} | r for r in rows], columns=names, dtype=object)

    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mkv,mka,webm}").option("recursiveFileLookup", "true").load(path)
    return source.select("path", "content").mapInPandas(run, schema)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each track; a file that cannot be read is one row that has an error."""
    return _read(spark, path, 0, TRACK_ROWS)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame of files that can be read, numbered from 0 in each track."""
    return _read(spark, path, 1, FRAME_ROWS)
