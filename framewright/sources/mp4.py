"""ISO base media files, whole or in fragments: boxes, tracks and the samples that their tables describe."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.timeline import edit_mapped, edit_starts

#: Boxes that hold boxes.
HOLDERS = frozenset(b"moov trak mdia minf stbl edts mvex moof traf".split())
KINDS = {b"soun": "audio", b"vide": "video", b"subt": "subtitle", b"text": "subtitle"}
DEEPEST, MOST_SAMPLES = 12, 1 << 26
TRACKS = "path string, track_id long, kind string, codec string, timescale long, duration long, rate double, channels int, layout string, error string"
PACKETS = "path string, track_id long, sample_id long, offset long, size long, decode_time long, presentation_time long, duration long, sync boolean"
EDITS = "path string, track_id long, entry_no long, duration long, media_time long, error string"
_EDITS = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in EDITS.split(", "))])
#: Entries of edit lists that are returned together, about.
BATCH = 1 << 16


class Mp4Error(ValueError):
    pass


class Box(NamedTuple):
    kind: bytes
    start: int
    body: int
    end: int
    path: tuple[bytes, ...]


def boxes(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[Box]:
    """Boxes in order, those within a holder after it; a last one of size zero reaches to the end."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Mp4Error("a long size is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Mp4Error(f"box {kind!r} at {at} does not fit")
        yield Box(kind, at, at + head, at + size, path)
        if kind in HOLDERS:
            if len(path) >= DEEPEST:
                raise Mp4Error("boxes are nested too deeply")
            yield from boxes(data, at + head, at + size, (*path, kind))
        at += size


def layout(data: bytes) -> str | None:
    """"fragmented", "progressive", or None where there is no movie."""
    kinds = {b.kind for b in boxes(data)}
    return "fragmented" if kinds & {b"mvex", b"moof"} else "progressive" if b"moov" in kinds else None


def _table(data: bytes, box: Box, columns: int, width: str = "I") -> np.ndarray:
    """Rows of a full box that has a count and entries of equal numbers."""
    n = struct.unpack_from(">I", data, box.body + 4)[0]
    size = struct.calcsize(width)
    if box.body + 8 + n * columns * size > box.end:
        raise Mp4Error(f"table {box.kind!r} is cut off")
    return np.frombuffer(data, f">{'u' if width.isupper() else 'i'}{size}", n * columns, box.body + 8).astype(np.int64).reshape(n, columns)


def _traks(data: bytes, found: list[Box]) -> Iterator[dict[bytes, Box]]:
    for trak in (b for b in found if b.kind == b"trak"):
        yield {b.kind: b for b in found if trak.body <= b.start < trak.end}


def _track(data: bytes, own: dict[bytes, Box]) -> dict:
    for kind in (b"tkhd", b"mdhd", b"hdlr", b"stsd"):
        if kind not in own:
            raise Mp4Error(f"a track without {kind!r}")
    at = own[b"tkhd"].body
    track_id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
    at = own[b"mdhd"].body
    scale, duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
    kind = data[own[b"hdlr"].body + 8 : own[b"hdlr"].body + 12]
    at = own[b"stsd"].body + 8
    codec, rate, channels = None, None, None
    if at + 8 <= own[b"stsd"].end:
        codec = data[at + 4 : at + 8].decode("latin-1")
        if kind == b"soun" and at + 36 <= own[b"stsd"].end:
            channels, rate = struct.unpack_from(">H", data, at + 24)[0], struct.unpack_from(">I", data, at + 32)[0] / 65536
    return {"track_id": track_id, "kind": KINDS.get(kind, kind.decode("latin-1")), "codec": codec, "timescale": scale, "duration": duration, "rate": rate, "channels": channels}


def tracks(data: bytes) -> list[dict]:
    found = list(boxes(data))
    how = layout(data)
    return [_track(data, own) | {"layout": how} for own in _traks(data, found)]


def _progressive(data: bytes, own: dict[bytes, Box]) -> dict[str, np.ndarray] | None:
    if b"stsz" not in own:
        return None
    fixed, n = struct.unpack_from(">II", data, own[b"stsz"].body + 4)
    if not n:
        return None
    if n > MOST_SAMPLES or fixed * n > len(data):
        raise Mp4Error("more samples than the file holds")
    at = own[b"stsz"].body + 12
    if not fixed and at + 4 * n > own[b"stsz"].end:
        raise Mp4Error("sample sizes are cut off")
    size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at).astype(np.int64)
    times = _table(data, own[b"stts"], 2)
    if times[:, 0].sum() != n:
        raise Mp4Error("durations and sizes differ in number")
    duration = np.repeat(times[:, 1], times[:, 0])
    shift = np.zeros(n, np.int64)
    if b"ctts" in own:
        runs = _table(data, own[b"ctts"], 2, "I" if not data[own[b"ctts"].body] else "i")
        if runs[:, 0].sum() != n or (runs[:, 0] < 0).any():
            raise Mp4Error("composition offsets and sizes differ in number")
        shift = np.repeat(runs[:, 1], runs[:, 0])
    chunk = _table(data, own[b"co64"], 1, "Q")[:, 0] if b"co64" in own else _table(data, own[b"stco"], 1)[:, 0]
    runs = _table(data, own[b"stsc"], 3)
    first = runs[:, 0] - 1
    if not len(runs) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(chunk):
        raise Mp4Error("runs of chunks are out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(first, len(chunk))))
    if per.sum() != n:
        raise Mp4Error("chunks and sizes differ in number")
    where = np.repeat(np.arange(len(chunk)), per)
    before = np.cumsum(size) - size
    opening = np.minimum(np.cumsum(per) - per, n - 1)
    offset = chunk[where] + before - before[opening[where]]
    sync = np.ones(n, bool)
    # An empty list marks every sample.
    if b"stss" in own and len(marked := _table(data, own[b"stss"], 1)[:, 0] - 1):
        sync[:] = False
        sync[marked[(marked >= 0) & (marked < n)]] = True
    decode = np.cumsum(duration) - duration
    return {"offset": offset, "size": size, "decode_time": decode, "presentation_time": decode + shift, "duration": duration, "sync": sync}


def _fragments(data: bytes, found: list[Box]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(track, samples) of each run, in file order."""
    defaults = {}
    for b in found:
        if b.kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, b.body + 4)
            defaults[track] = rest
    clock: dict[int, int] = {}
    moof, track, base, after = 0, 0, 0, 0
    duration, size, flags = 0, 0, 0
    for b in found:
        if b.kind == b"moof":
            moof = after = b.start
        elif b.kind == b"tfhd":
            have, track = struct.unpack_from(">II", data, b.body)
            have &= 0xFFFFFF
            duration, size, flags = defaults.get(track, (0, 0, 0))
            at = b.body + 8
            base = moof if have & 0x20000 else after
            if have & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(have & 2)
            if have & 8:
                duration, at = struct.unpack_from(">I", data, at)[0], at + 4
            if have & 0x10:
                size, at = struct.unpack_from(">I", data, at)[0], at + 4
            if have & 0x20:
                flags = struct.unpack_from(">I", data, at)[0]
            after = base
        elif b.kind == b"tfdt":
            clock[track] = struct.unpack_from(">Q" if data[b.body] else ">I", data, b.body + 4)[0]
        elif b.kind == b"trun":
            have, n = struct.unpack_from(">II", data, b.body)
            version, have = have >> 24, have & 0xFFFFFF
            at = b.body + 8
            start, opening = after, None
            if have & 1:
                start, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            if have & 4:
                opening, at = struct.unpack_from(">I", data, at)[0], at + 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if have & bit]
            if n > MOST_SAMPLES or at + 4 * n * len(fields) > b.end:
                raise Mp4Error("a run of samples is cut off")
            raw = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields))
            column = lambda bit, plain: raw[:, fields.index(bit)] if bit in fields else np.full(n, plain, np.int64)  # noqa: B023, E731
            sizes, lengths, marks, shift = column(0x200, size), column(0x100, duration), column(0x400, flags), column(0x800, 0)
            if opening is not None and n and 0x400 not in fields:
                marks[0] = opening
            if version:
                shift = np.where(shift >= 1 << 31, shift - (1 << 32), shift)
            decode = clock.get(track, 0) + np.cumsum(lengths) - lengths
            clock[track] = clock.get(track, 0) + int(lengths.sum())
            after = start + int(sizes.sum())
            yield track, {"offset": start + np.cumsum(sizes) - sizes, "size": sizes, "decode_time": decode, "presentation_time": decode + shift, "duration": lengths, "sync": (marks & 0x10000) == 0}


def packets(data: bytes) -> pd.DataFrame:
    """Samples of all tracks: those of the movie's tables, then those of fragments; numbered from 1 in each track.

    A table that contradicts another, or a sample that lies outside the file, is an error.
    """
    found = list(boxes(data))
    parts: list[pd.DataFrame] = []
    for own in _traks(data, found):
        if (got := _progressive(data, own)) is not None:
            parts.append(pd.DataFrame({"track_id": _track(data, own)["track_id"]} | got))
    parts += [pd.DataFrame({"track_id": track} | got) for track, got in _fragments(data, found)]
    names = [c.split()[0] for c in PACKETS.split(", ")][1:]
    if not parts:
        return pd.DataFrame(columns=names)
    out = pd.concat(parts, ignore_index=True)
    if ((out["offset"] < 0) | (out["offset"] + out["size"] > len(data))).any():
        raise Mp4Error("a sample lies outside the file")
    out["sample_id"] = out.groupby("track_id").cumcount() + 1
    return out[names]


def _edits(data: bytes) -> list[tuple[int, int, int, int]]:
    """Track, number, duration and media_time of the entries of the edit lists."""
    found, out = list(boxes(data)), []
    head = next((b.body for b in found if b.kind == b"mvhd"), None)
    movie = struct.unpack_from(">I", data, head + (20 if data[head] else 12))[0] if head is not None else 0
    for own in _traks(data, found):
        if b"elst" not in own:
            continue
        at, track = own[b"elst"].body, _track(data, own)
        version, n = data[at], struct.unpack_from(">I", data, at + 4)[0]
        if version > 1:
            raise Mp4Error(f"edit list of version {version}")
        entry = struct.Struct(">Qqi" if version else ">Iii")
        if at + 8 + n * entry.size > own[b"elst"].end:
            raise Mp4Error("edit list is cut off")
        rows = list(entry.iter_unpack(data[at + 8 : at + 8 + n * entry.size]))
        if not n:
            continue
        if not movie:
            raise Mp4Error("edit list without a time scale of the movie")
        if any(rate != 1 << 16 for _, _, rate in rows):
            raise Mp4Error("edits at another rate")
        if any(place < -1 for _, place, _ in rows) or all(place == -1 for _, place, _ in rows):
            raise Mp4Error("edits without a place in the track")
        number, scale = track["track_id"], track["timescale"]
        out += [(number, i, (d * scale + movie // 2) // movie, place) for i, (d, place, _) in enumerate(rows, 1)]
    return out


def edits(data: bytes) -> pd.DataFrame:
    """Entries of the edit lists, their durations in the time of the track, rounded; media_time is -1 where nothing is shown."""
    names = ["track_id", "entry_no", "duration", "media_time"]
    got = _edits(data)
    return pd.DataFrame(got, columns=names) if got else pd.DataFrame({c: np.zeros(0, np.int64) for c in names})


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{mp4,m4a,m4v,mov,m4s}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each track; a file that cannot be read is one row that has an error."""
    names = [c.split()[0] for c in TRACKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows = tracks(bytes(data))
                except (Mp4Error, struct.error) as e:
                    rows = [{"error": str(e)}]
                yield pd.DataFrame([{"path": p} | r for r in rows], columns=names, dtype=object)

    return _files(spark, path).mapInPandas(run, TRACKS)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample; a file that cannot be read is one row that has an error."""
    names = [c.split()[0] for c in f"{PACKETS}, error string".split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    got = packets(bytes(data))
                except (Mp4Error, struct.error, KeyError) as e:
                    yield pd.DataFrame([{"path": p, "error": str(e) or type(e).__name__}], columns=names, dtype=object)
                    continue
                for i in range(0, len(got), 1 << 16):
                    part = got.iloc[i : i + (1 << 16)]
                    yield part.assign(path=pd.Series([p] * len(part), part.index, dtype=object), error=pd.Series([None] * len(part), part.index, dtype=object))[names]

    return _files(spark, path).mapInPandas(run, f"{PACKETS}, error string")


def edits_in(files: DataFrame) -> DataFrame:
    """A row for each entry of an edit list of the files(path, content); a file that cannot be read is one row that has an error."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EDITS, strict=True)], schema=_EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for p, content in zip(b.column("path"), b.column("content"), strict=True):
                path = p.as_py()
                try:
                    rows += [(path, *r, None) for r in _edits(content.as_py())]
                except (Mp4Error, struct.error) as e:
                    rows.append((path, None, None, None, None, str(e)))
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return files.mapInArrow(run, EDITS)


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of an edit list; a file that cannot be read is one row that has an error."""
    return edits_in(_files(spark, path))


def read_presented(spark: SparkSession, path: str) -> DataFrame:
    """read_packets with presentation: the time at which the edits of the track show a sample, its own time where there are none."""
    key = F.struct("path", "track_id")
    listed = edit_starts(read_edits(spark, path).where("error is null").withColumn("__track", key), "__track", "entry_no")
    packets_ = read_packets(spark, path).withColumn("__track", key)
    return edit_mapped(packets_, listed, "__track", "presentation_time").drop("__track")
