"""Ogg pages: a row for each page, with its checksum verified, and packets put together across pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGES = "path string, page int, serial long, sequence long, granule long, first boolean, last boolean, continued boolean, checksum_ok boolean, packets int, body_bytes int"


#: A byte with its bits in the other direction.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_ALL = 0xFFFFFFFF


def _mirrored(x: int) -> int:
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def checksum(page: bytes) -> int:
    """CRC-32 of a page whose own checksum field is zero: polynomial 04C11DB7, no reflection, no inversion.

    zlib's CRC has the same polynomial on mirrored bits, with inversions before and after: those of the value it
    goes on from and of its result are undone here.
    """
    return _mirrored(zlib.crc32(page.translate(_MIRROR), _ALL) ^ _ALL)


def page_bytes(serial: int, sequence: int, granule: int, packets: list[bytes], first: bool = False, last: bool = False) -> bytes:
    """A page of whole packets."""
    lacing = bytes(x for p in packets for x in [255] * (len(p) // 255) + [len(p) % 255])
    if len(lacing) > 255:
        raise ValueError("a page has 255 segments at most")
    head = b"OggS\0" + bytes([first * 2 | last * 4]) + struct.pack("<qIII", granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    page = head + b"".join(packets)
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def pages(data: bytes) -> Iterator[dict]:
    """Pages in order; bytes between them are passed over."""
    at, number = data.find(b"OggS"), 0
    while at >= 0 and at + 27 <= len(data):
        flags, granule, serial, sequence, crc, n = data[at + 5], *struct.unpack_from("<qIII", data, at + 6), data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if len(lacing) < n or at + size > len(data):
            return
        page = data[at : at + size]
        yield {"page": number, "serial": serial, "sequence": sequence, "granule": granule, "first": bool(flags & 2), "last": bool(flags & 4), "continued": bool(flags & 1), "checksum_ok": checksum(page[:22] + b"\0\0\0\0" + page[26:]) == crc, "packets": sum(x < 255 for x in lacing), "body_bytes": sum(lacing), "lacing": lacing, "body": page[27 + n :]}
        number, at = number + 1, data.find(b"OggS", at + size)


def packets(data: bytes, serial: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(serial, packet, granule) of whole packets; the granule is -1 but for the last that ends on a page."""
    parts: dict[int, bytes] = {}
    for p in pages(data):
        own = p["serial"]
        if not p["checksum_ok"] or (serial is not None and own != serial):
            parts.pop(own, None)
            continue
        held, at = (parts.pop(own, b"") if p["continued"] else b""), 0
        ends = [i for i, x in enumerate(p["lacing"]) if x < 255]
        for i, x in enumerate(p["lacing"]):
            held += p["body"][at : at + x]
            at += x
            if x < 255:
                yield own, held, p["granule"] if i == ends[-1] else -1
                held = b""
        if held:
            parts[own] = held


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in PAGES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame([{"path": p} | {k: v for k, v in x.items() if k in names} for x in pages(bytes(data))], columns=names, dtype=object)

    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ogg,oga,opus}").option("recursiveFileLookup", "true").load(path)
    return source.select("path", "content").mapInPandas(run, PAGES)
