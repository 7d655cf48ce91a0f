"""Length-prefixed frames: streams of bytes, cut anywhere, put together again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAMES = "stream_id long, frame long, payload binary, error string"
LARGEST = 1 << 20
_FRAMES = pa.schema([("stream_id", pa.int64()), ("frame", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
#: Bytes of a stream that are put together at a time, and bytes and frames that are returned together, about.
SLICE, BATCH = 1 << 20, 1 << 14


def framed(payloads: Column) -> Column:
    """One stream of an array of strings: each with its length in 32 bits, big-endian, before its UTF-8."""
    return F.unhex(F.array_join(F.transform(payloads, lambda p: F.concat(F.lpad(F.hex(F.octet_length(p)), 8, "0"), F.hex(p))), ""))


def chunks(streams: DataFrame, size: int) -> DataFrame:
    """streams(stream_id, data) cut to (stream_id, seq, data) of `size` bytes; an empty stream has no chunks."""
    last = F.floor((F.octet_length("data") - 1) / size).cast("int")
    piece = lambda i: F.struct(i.cast("long").alias("seq"), F.substring("data", i * size + 1, F.lit(size)).alias("data"))
    # Cut before they are dealt to rows, so that no row carries the whole stream.
    rows = streams.where(F.octet_length("data") > 0).select("stream_id", F.explode(F.transform(F.sequence(F.lit(0), last), piece)).alias("piece"))
    return rows.select("stream_id", "piece.seq", "piece.data")


def cut(state: tuple[bytes, int, bool], parts: Iterable[bytes], most: int = LARGEST) -> tuple[tuple[bytes, int, bool], list[tuple]]:
    """Whole frames (number, payload, error) of what is held and what comes; the state that is left.

    A frame of more than `most` bytes ends its stream with an error, so what is held stays below that bound.
    """
    held, number, dead = state
    out: list[tuple] = []
    for part in parts:
        if dead:
            break
        held, at = held + bytes(part), 0
        while len(held) - at >= 4:
            size = int.from_bytes(held[at : at + 4], "big")
            if size > most:
                out.append((number, None, f"a frame of {size} bytes"))
                held, at, dead = b"", 0, True
                break
            if len(held) - at < 4 + size:
                break
            out.append((number, held[at + 4 : at + 4 + size], None))
            at, number = at + 4 + size, number + 1
        held = held[at:]
    return (held, number, dead), out


def frames_of(pieces: DataFrame, most: int = LARGEST) -> DataFrame:
    """pieces(stream_id, seq, data) as frames; bytes of a last frame that is not whole are a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        parts: list[bytes] = []
        now, state, size = (), (b"", 0, False), 0

        def put_together() -> None:
            nonlocal state, size
            state, got = cut(state, [b"".join(parts)], most)
            out.extend((now, *r) for r in got)
            parts.clear()
            size += sum(len(r[1] or b"") for r in got)

        def batch() -> pa.RecordBatch:
            nonlocal size
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FRAMES, strict=True)], schema=_FRAMES)
            out.clear()
            size = 0
            return got

        def end() -> None:
            put_together()
            if state[0]:
                out.append((now, state[1], None, f"{len(state[0])} bytes of a frame that has no end"))

        for b in batches:
            held = 0
            for stream, data in zip(b.column("stream_id").to_pylist(), b.column("data"), strict=True):
                if stream != now:
                    if now != ():
                        end()
                    now, state, held = stream, (b"", 0, False), 0
                parts.append(data.as_py())
                held += len(parts[-1])
                if held >= SLICE:
                    put_together()
                    held = 0
                if size >= SLICE or len(out) >= BATCH:
                    yield batch()
            put_together()
        if now != ():
            end()
        if out:
            yield batch()

    placed = pieces.repartition("stream_id").sortWithinPartitions("stream_id", F.col("seq").asc_nulls_last())
    return placed.select("stream_id", "data").mapInArrow(run, FRAMES)
