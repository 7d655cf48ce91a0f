"""RIFF/WAVE files: headers and samples as rows, and blocks written as files.

A file is a row with its geometry and where its samples lie, or a row for each sample. Files are
listed by Spark's own `binaryFile`, so any store that Spark reads will do; parsing is per file, in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: A size that stands in 64 bits elsewhere.
UNKNOWN = 0xFFFFFFFF
HEADER = "path string, encoding string, channels int, rate int, bits int, data_offset long, data_bytes long, frames long, error string"
SAMPLES = "path string, channel int, frame long, x double"


class WavError(ValueError):
    pass


def parse_header(data: bytes) -> dict:
    """Geometry of a file, RF64 among them; chunks of other kinds are passed over, sizes that exceed the file are cut to it."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise WavError("no RIFF/WAVE header")
    at, fmt, long_size = 12, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if kind == b"ds64" and data[:4] == b"RF64" and size >= 24 and body + 24 <= len(data):
            long_size = struct.unpack_from("<Q", data, body + 8)[0]
        elif kind == b"fmt ":
            if size < 16 or body + 16 > len(data):
                raise WavError("short fmt chunk")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if tag == EXTENSIBLE and size >= 40:
                tag = struct.unpack_from("<H", data, body + 24)[0]
            if tag not in (PCM, FLOAT) or (tag == FLOAT and bits != 32) or (tag == PCM and bits not in (8, 16, 24, 32)):
                raise WavError(f"unsupported format {tag} of {bits} bits")
            if not channels or not rate:
                raise WavError("no channels or no rate")
            fmt = {"encoding": "float" if tag == FLOAT else "int", "channels": channels, "rate": rate, "bits": bits}
        elif kind == b"data":
            if fmt is None:
                raise WavError("data before fmt")
            if size == UNKNOWN and data[:4] == b"RF64":
                if long_size is None:
                    raise WavError("no ds64 chunk before data")
                size = long_size
            size = min(size, len(data) - body)
            return fmt | {"data_offset": body, "data_bytes": size, "frames": size // (fmt["channels"] * fmt["bits"] // 8)}
        at = body + size + (size & 1)
    raise WavError("no data chunk")


def samples_of(data: bytes, head: dict) -> np.ndarray:
    """Samples (frames, channels) within ±1."""
    width, n = head["bits"] // 8, head["frames"] * head["channels"]
    raw = data[head["data_offset"] : head["data_offset"] + n * width]
    if head["encoding"] == "float":
        x = np.frombuffer(raw, "<f4").astype(np.float64)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, head["channels"])


def header_bytes(encoding: str, channels: int, rate: int, bits: int, frames: int) -> bytes:
    """What stands ahead of the samples of a file: RF64 where its sizes go beyond 32 bits, RIFF otherwise."""
    width = bits // 8
    size = frames * channels * width
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, FLOAT if encoding == "float" else PCM, channels, rate, rate * channels * width, channels * width, bits)
    whole = 4 + len(fmt) + 8 + size + (size & 1)
    if whole < UNKNOWN:
        return b"RIFF" + struct.pack("<I", whole) + b"WAVE" + fmt + b"data" + struct.pack("<I", size)
    long = b"ds64" + struct.pack("<IQQQI", 28, whole + 36, size, frames, 0)
    return b"RF64" + struct.pack("<I", UNKNOWN) + b"WAVE" + long + fmt + b"data" + struct.pack("<I", UNKNOWN)


def wav_bytes(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file of integer samples (frames, channels) of 8, 16, 24 or 32 bits."""
    frames, channels = samples.shape
    width, flat = bits // 8, samples.astype(np.int64).ravel()
    body = (flat + 128).astype(np.uint8).tobytes() if bits == 8 else flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return header_bytes("int", channels, rate, bits, frames) + body + b"\0" * (len(body) & 1)


def files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def headers_in(rows: DataFrame) -> DataFrame:
    """A row for each of the files rows(path, content); one that cannot be read has its reason in `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEADER.split(", ")]
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append({"path": p, "error": None} | parse_header(bytes(data)))
                except WavError as e:
                    rows.append({"path": p, "error": str(e)})
            got = pd.DataFrame(rows, columns=names)
            for c in ("encoding", "error"):
                got[c] = got[c].astype(object).where(got[c].notna(), None)
            for c in ("channels", "rate", "bits", "data_offset", "data_bytes", "frames"):
                got[c] = got[c].astype("Int64")
            yield got

    return rows.mapInPandas(run, HEADER)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file; one that cannot be read has its reason in `error`."""
    return headers_in(files(spark, path).select("path", "content"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample of the files that can be read, in parts, so a long file is not one batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    x = samples_of(bytes(data), head := parse_header(bytes(data)))
                except WavError:
                    continue
                for a in range(0, len(x), 65536):
                    part = x[a : a + 65536]
                    yield pd.DataFrame({"path": p, "channel": np.tile(np.arange(head["channels"]), len(part)), "frame": np.repeat(np.arange(a, a + len(part)), head["channels"]), "x": part.ravel()})

    return files(spark, path).select("path", "content").mapInPandas(run, SAMPLES)
