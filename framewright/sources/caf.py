"""CAF files: the description, and a row for each packet with where it lies, its time and the frames of it that are heard."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TRACKS = "path string, codec string, rate double, channels int, bits int, packet_frames int, packets long, valid_frames long, priming long, remainder long, cookie binary, error string"
PACKETS = "path string, sample_id long, offset long, size long, decode_time long, duration long, trim_start long, trim_end long"
_PACKETS = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in PACKETS.split(", "))])
#: Chunks that a file has at most once.
_ONCE = (b"desc", b"pakt", b"kuki", b"chan", b"data")
#: Packets that are returned together, about, and files whose tables are read together at most.
BATCH, FILES = 1 << 16, 1 << 14
#: Bytes of a number in a packet table at most, and of a packet.
_DIGITS, LARGEST = 10, 1 << 26


class CafError(ValueError):
    pass


def chunks(data: bytes) -> dict[bytes, tuple[int, int]]:
    """Start and end of the chunks of each kind that counts; only samples may be of unknown size, which is up to the file's end."""
    if data[:8] != b"caff\0\1\0\0":
        raise CafError("no header of version 1")
    found, at = {}, 8
    while at < len(data):
        if at + 12 > len(data):
            raise CafError("ends within the header of a chunk")
        kind, size = struct.unpack_from(">4sq", data, at)
        name = kind.decode("latin-1")
        at += 12
        if size == -1 and kind == b"data":
            size = len(data) - at
        if size < 0 or size > len(data) - at:
            raise CafError(f"size {size} of chunk {name} is out of range")
        if kind in _ONCE:
            if kind in found:
                raise CafError(f"more than one chunk {name}")
            found[kind] = (at, at + size)
        at += size
    missing = [k.decode() for k in (b"desc", b"data") if k not in found]
    if missing:
        raise CafError(f"no chunk {missing[0]}")
    return found


def table_sizes(body: bytes) -> np.ndarray:
    """Numbers of seven bits a byte, one after the other, the high bit telling that more follows."""
    raw = np.frombuffer(body, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise CafError("a packet size is cut off")
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts >= _DIGITS).any():
        raise CafError("a packet size is too long")
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(raw))
    # Digits that matter beyond the largest size are told from zeros ahead of a number.
    if ((raw & 127 != 0) & (place > 4)).any():
        raise CafError("a packet size is out of range")
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * np.minimum(place, 4), starts)


def _head(data: bytes) -> dict:
    """What a file tells of its packets, their listed sizes not yet read."""
    found = chunks(data)
    part = lambda kind: data[slice(*found[kind])]
    if len(part(b"desc")) < 32:
        raise CafError("short description")
    rate, codec, _, packet_bytes, packet_frames, channels, bits = struct.unpack_from(">d4s5I", part(b"desc"))
    if not rate > 0 or not channels or not packet_frames:
        raise CafError("no rate, no channels or no frames in a packet")
    start, end = found[b"data"]
    if end - start < 4:
        raise CafError("no edit count")
    table, listed = None, b""
    if b"pakt" in found:
        body = part(b"pakt")
        if len(body) < 24:
            raise CafError("short packet table")
        table, listed = struct.unpack_from(">qqii", body), body[24:]
        if min(table) < 0:
            raise CafError("a count of the packet table is negative")
    track = {"codec": codec.decode("latin-1"), "rate": rate, "channels": channels, "bits": bits, "packet_frames": packet_frames}
    track |= {"cookie": part(b"kuki") if b"kuki" in found else None, "data_offset": start + 4}
    return track | {"packet_bytes": packet_bytes, "total": end - start - 4, "table": table, "listed": listed}


def parse(data: bytes) -> tuple[dict, np.ndarray]:
    """The track of a file and the sizes of its packets."""
    return _parsed(_head(data))


def _parsed(track: dict) -> tuple[dict, np.ndarray]:
    packet_bytes, packet_frames, total, table, listed = (track.pop(k) for k in ("packet_bytes", "packet_frames", "total", "table", "listed"))
    listed = table_sizes(listed)
    if packet_bytes:
        if total % packet_bytes:
            raise CafError("packets do not fill the data")
        sizes = np.full(total // packet_bytes, packet_bytes, np.int64)
        if table and (len(listed) or table[0] != len(sizes)):
            raise CafError("the packet table does not go with packets of one size")
    else:
        if not table:
            raise CafError("no packet table")
        sizes = listed
        if len(sizes) != table[0] or int(sizes.sum()) != total:
            raise CafError("the packet table does not go with the data")
    if len(sizes) and not 0 < sizes.min() <= sizes.max() <= LARGEST:
        raise CafError("a packet size is out of range")
    count, valid, priming, remainder = table or (len(sizes), len(sizes) * packet_frames, 0, 0)
    if table and valid + priming + remainder > count * packet_frames:
        raise CafError("more frames than the packets hold")
    return track | {"packet_frames": packet_frames, "packets": count, "valid_frames": valid, "priming": priming, "remainder": remainder}, sizes


def _places(track: dict[str, np.ndarray], sizes: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the packets of files one after the other, of which each has `counts`; track has a value for each file."""
    each = {c: np.repeat(track[c], counts) for c in ("packet_frames", "priming", "valid_frames", "data_offset")}
    first, frames = np.cumsum(counts) - counts, each["packet_frames"]
    n, before = np.arange(len(sizes), dtype=np.int64) - np.repeat(first, counts), np.concatenate([[0], np.cumsum(sizes)])
    offsets = each["data_offset"] + before[:-1] - np.repeat(before[first], counts)
    low = np.clip(each["priming"] - n * frames, 0, frames)
    high = np.clip(each["priming"] + each["valid_frames"] - n * frames, 0, frames)
    return {"sample_id": n + 1, "offset": offsets, "size": sizes, "decode_time": n * frames, "duration": frames, "trim_start": low, "trim_end": np.maximum(low, high)}


def _packets(track: dict, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of packets."""
    one = {c: np.array([track[c]], np.int64) for c in ("packet_frames", "priming", "valid_frames", "data_offset")}
    return _places(one, sizes, np.array([len(sizes)]))


def packets(data: bytes) -> pd.DataFrame:
    """Packets of a file; trim_start and trim_end bound the frames of each that are heard."""
    return pd.DataFrame(_packets(*parse(data)))


def _batch(paths: list[str], counts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    path = pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(paths)), counts)))
    return pa.RecordBatch.from_arrays([path, *(pa.array(columns[f.name], f.type) for f in _PACKETS if f.name != "path")], schema=_PACKETS)


def _singly(paths: list[str], heads: list[dict]) -> Iterator[pa.RecordBatch]:
    """Packets of files, one file after the other."""
    for p, head in zip(paths, heads, strict=True):
        try:
            columns = _packets(*_parsed(dict(head)))
        except CafError:
            continue
        if n := len(columns["size"]):
            yield _batch([p], np.array([n]), columns)


def _together(paths: list[str], heads: list[dict]) -> Iterator[pa.RecordBatch]:
    """Packets of files whose tables list them, the tables read as one where none has a number that is no size."""
    bodies = [h["listed"] for h in heads]
    try:
        sizes = table_sizes(b"".join(bodies))
    except CafError:
        yield from _singly(paths, heads)
        return
    per = lambda values, ends: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])
    counts = per(np.frombuffer(b"".join(bodies), np.uint8) < 128, np.cumsum([len(b) for b in bodies]))
    ends = np.cumsum(counts)
    table = np.array([h["table"] for h in heads], np.int64)
    good = (counts == table[:, 0]) & (per(sizes, ends) == np.array([h["total"] for h in heads])) & (per((sizes <= 0) | (sizes > LARGEST), ends) == 0)
    good &= np.array([sum(h["table"][1:]) <= h["table"][0] * h["packet_frames"] for h in heads])
    track = {"priming": table[:, 2], "valid_frames": table[:, 1]} | {c: np.array([h[c] for h in heads], np.int64) for c in ("packet_frames", "data_offset")}
    sizes, counts = sizes[np.repeat(good, counts)], counts[good]
    if len(sizes):
        yield _batch([p for p, g in zip(paths, good, strict=True) if g], counts, _places({c: v[good] for c, v in track.items()}, sizes, counts))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.caf").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file; one that cannot be read has its reason in `error`."""
    names = [c.split()[0] for c in TRACKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append({"path": p, "error": None} | parse(bytes(data))[0])
                except CafError as e:
                    rows.append({"path": p, "error": str(e)})
            got = pd.DataFrame(rows, columns=names)
            for c in ("codec", "cookie", "error"):
                got[c] = got[c].astype(object).where(got[c].notna(), None)
            for c in ("channels", "bits", "packet_frames", "packets", "valid_frames", "priming", "remainder"):
                got[c] = got[c].astype("Int64")
            yield got

    return _files(spark, path).mapInPandas(run, TRACKS)


def packets_in(files: DataFrame) -> DataFrame:
    """Packets of the files(path, content) that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, heads, size = [], [], 0
            for p, content in zip(b.column("path"), b.column("content"), strict=True):
                try:
                    head = _head(content.as_py())
                except CafError:
                    continue
                # A table that is cut off would run into the next one.
                if head["packet_bytes"] or not head["table"] or head["listed"][-1:] >= b"\x80":
                    yield from _singly([p.as_py()], [head])
                    continue
                paths.append(p.as_py())
                heads.append(head)
                size += len(head["listed"])
                if size >= BATCH or len(heads) >= FILES:
                    yield from _together(paths, heads)
                    paths, heads, size = [], [], 0
            if heads:
                yield from _together(paths, heads)

    return files.mapInArrow(run, PACKETS)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of the files that can be read."""
    return packets_in(_files(spark, path))
