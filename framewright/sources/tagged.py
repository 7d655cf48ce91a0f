"""Descriptive tags inside files: ID3v2, Vorbis comments (bare, in Ogg, in FLAC), RIFF INFO lists, MP4 item lists, AIFF text, ID3v1 and APEv2 at the end, as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framewright.functions.text import MP4_TAGS
from framewright.sources import mp4, ogg

ROWS = "path string, seq long, tag string, value string"
# Text frames of ID3v2.2, v2.3 and v2.4, and RIFF INFO chunks, by the tag that they carry.
ID3 = {"TT2": "title", "TP1": "artist", "TAL": "album", "TYE": "date", "TRK": "track", "TCO": "genre", "TIT2": "title", "TPE1": "artist", "TALB": "album", "TYER": "date", "TDRC": "date", "TRCK": "track", "TCON": "genre", "TCOM": "composer"}
INFO = {"INAM": "title", "IART": "artist", "IPRD": "album", "ICRD": "date", "ITRK": "track", "IGNR": "genre", "ICMT": "comment"}
# Text chunks of AIFF, and the places of the fields of ID3v1.
AIFF = {"NAME": "title", "AUTH": "artist", "(c) ": "copyright", "ANNO": "comment"}
ID3V1 = [("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("date", 93, 97), ("comment", 97, 127)]
_TEXT = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _text(body: bytes) -> list[str]:
    """Strings of a text frame, parted by zeros."""
    if not body or body[0] >= len(_TEXT):
        return []
    return [x for x in body[1:].decode(_TEXT[body[0]], "replace").split("\0") if x]


def _seven(b: bytes) -> int:
    """A number of seven bits a byte."""
    return sum((x & 127) << 7 * (len(b) - 1 - i) for i, x in enumerate(b))


def id3(data: bytes) -> Iterator[tuple[str, str]]:
    """Text frames of a tag at the file's start, user-defined ones by their description; what is cut off is passed over."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return
    version, flags = data[3], data[5]
    body = data[10 : 10 + _seven(data[6:10])]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, names, head = 0, (3 if version == 2 else 4), (6 if version == 2 else 10)
    if flags & 0x40 and version > 2 and len(body) >= 4:
        at = _seven(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + head <= len(body) and body[at]:
        name, raw = body[at : at + names].decode("latin-1"), body[at + names : at + 2 * names]
        size = _seven(raw) if version == 4 else int.from_bytes(raw, "big")
        part = body[at + head : at + head + size]
        if len(part) < size:
            return
        if version == 4 and body[at + 9] & 3:
            part = part[4:] if body[at + 9] & 1 else part
            part = part.replace(b"\xff\0", b"\xff") if body[at + 9] & 2 else part
        strings = _text(part) if name[0] == "T" else []
        if name in ("TXXX", "TXX"):
            if len(strings) > 1:
                yield from ((strings[0].lower(), v) for v in strings[1:])
        else:
            yield from ((ID3.get(name, name), v) for v in strings)
        at += head + size


def comments(body: bytes) -> Iterator[tuple[str, str]]:
    """Entries of a Vorbis comment block, names in lower case."""
    if len(body) < 8:
        return
    at = 4 + struct.unpack_from("<I", body)[0]
    if at + 4 > len(body):
        return
    count, at = struct.unpack_from("<I", body, at)[0], at + 4
    for _ in range(count):
        if at + 4 > len(body):
            return
        size, at = struct.unpack_from("<I", body, at)[0], at + 4
        if at + size > len(body):
            return
        name, equals, value = body[at : at + size].decode("utf-8", "replace").partition("=")
        if equals:
            yield name.lower(), value
        at += size


def flac(data: bytes) -> Iterator[tuple[str, str]]:
    at = 4
    while data[:4] == b"fLaC" and at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 4:
            yield from comments(data[at + 4 : at + 4 + size])
        if kind & 128:
            return
        at += 4 + size


def info(data: bytes) -> Iterator[tuple[str, str]]:
    """INFO lists of a RIFF file."""
    at = 12
    while data[:4] == b"RIFF" and at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            inner, end = at + 12, min(len(data), at + 8 + size)
            while inner + 8 <= end:
                name, n = data[inner : inner + 4].decode("latin-1"), struct.unpack_from("<I", data, inner + 4)[0]
                value = data[inner + 8 : min(end, inner + 8 + n)].split(b"\0")[0].decode("utf-8", "replace")
                if value:
                    yield INFO.get(name, name), value
                inner += 8 + n + (n & 1)
        at += 8 + size + (size & 1)


def ogg_comments(data: bytes) -> Iterator[tuple[str, str]]:
    """Comments of the second header packet of Vorbis and Opus streams."""
    for _, packet, _ in ogg.packets(data):
        for magic in (b"\x03vorbis", b"OpusTags"):
            if packet.startswith(magic):
                yield from comments(packet[len(magic) :])
                return


def items(data: bytes) -> Iterator[tuple[str, str]]:
    """Text and numbers of the item list of an MP4 file; a genre by number and pictures are left out."""
    inner = lambda box, kind, skip=0: [b for b in mp4.boxes(data, box.body + skip, box.end) if b.kind == kind and not b.path]
    try:
        lists = [x for u in mp4.boxes(data) if u.kind == b"udta" and u.path == (b"moov",) for m in inner(u, b"meta") for x in inner(m, b"ilst", 4)]
        found = [(MP4_TAGS.get(i.kind.hex().upper()), i.kind, data[d.body + 8 : d.end]) for x in lists for i in mp4.boxes(data, x.body, x.end) for d in inner(i, b"data")]
    except mp4.Mp4Error:
        return
    for name, kind, value in found:
        if kind in (b"trkn", b"disk") and len(value) >= 6:
            yield name.lower(), "{}/{}".format(*struct.unpack_from(">HH", value, 2))
        elif name and kind != b"gnre" and (text := value.decode("utf-8", "replace").strip("\0").strip()):
            yield name.lower(), text


def aiff(data: bytes) -> Iterator[tuple[str, str]]:
    """Text chunks of an AIFF file."""
    at = 12
    while data[8:12] in (b"AIFF", b"AIFC") and at + 8 <= len(data):
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from(">I", data, at + 4)[0]
        value = data[at + 8 : at + 8 + size].decode("utf-8", "replace").strip("\0 ")
        if name in AIFF and value:
            yield AIFF[name], value
        at += 8 + size + (size & 1)


def id3v1(data: bytes) -> Iterator[tuple[str, str]]:
    """Fields of the last 128 bytes, and the track where the comment leaves room for it."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return
    numbered = not tag[125] and tag[126]
    for name, first, last in ID3V1:
        value = tag[first : 125 if name == "comment" and numbered else last].decode("latin-1").split("\0")[0].strip()
        if value:
            yield name, value
    if numbered:
        yield "track", str(tag[126])


def apev2(data: bytes) -> Iterator[tuple[str, str]]:
    """Text items of a tag that ends the file, or stands ahead of an ID3v1 tag; from an item that is cut off on, none."""
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return
    version, size, count = struct.unpack_from("<3I", data, end - 24)
    if version not in (1000, 2000) or not 32 <= size <= end:
        return
    body, at = data[end - size : end - 32], 0
    for _ in range(count):
        stop = body.find(b"\0", at + 8)
        if stop < 0:
            return
        length, flags = struct.unpack_from("<2I", body, at)
        name, value = body[at + 8 : stop].decode("utf-8", "replace").lower(), body[stop + 1 : stop + 1 + length]
        if len(value) < length:
            return
        if not flags >> 1 & 3:
            yield from ((name, x.decode("utf-8", "replace")) for x in value.split(b"\0") if x)
        at = stop + 1 + length


def tags_of(data: bytes) -> Iterator[tuple[str, str]]:
    """Tags of the file's own kind, APEv2's, then those of ID3v1 that no other tag gives."""
    by_magic = {b"ID3": id3, b"fLaC": flac, b"RIFF": info, b"OggS": ogg_comments, b"FORM": aiff}
    reader = items if data[4:8] == b"ftyp" else next((f for magic, f in by_magic.items() if data.startswith(magic)), None)
    own = (list(reader(data)) if reader else []) + list(apev2(data))
    yield from own
    named = {name for name, _ in own}
    yield from ((name, value) for name, value in id3v1(data) if name not in named)


def tags_in(files: DataFrame) -> DataFrame:
    """(path, seq, tag, value) in the order of each of the files(path, content); files without tags give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, *t) for p, data in zip(f["path"], f["content"], strict=True) for i, t in enumerate(tags_of(bytes(data)))]
            yield pd.DataFrame(rows, columns=["path", "seq", "tag", "value"], dtype=object)

    return files.mapInPandas(run, ROWS)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, tag, value) in the order of each file; files without tags give no rows."""
    return tags_in(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))
