"""AIFF and AIFF-C: the common chunk with its 80-bit rate, where samples lie, and the samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framewright.sources import raw

HEADER = "path string, compression string, channels int, rate double, bits int, frames long, data_offset long, data_bytes long, error string"
# Encodings of the compression types, and the steps and index moves of IMA ADPCM.
ENCODINGS = {"raw ": "u8", "twos": "s16be", "sowt": "s16le", "in24": "s24be", "in32": "s32be", "23ni": "s32le", "FL32": "f32be", "fl32": "f32be", "FL64": "f64be", "fl64": "f64be", "ULAW": "ulaw", "ulaw": "ulaw", "ALAW": "alaw", "alaw": "alaw"}
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
#: Bytes of an IMA block of one channel, and its samples.
BLOCK, BLOCK_SAMPLES = 34, 64


def extended(data: bytes) -> float:
    """An 80-bit IEEE number, big-endian."""
    head, mantissa = struct.unpack(">HQ", data)
    value = mantissa * 2.0 ** ((head & 0x7FFF) - 16383 - 63) if mantissa else 0.0
    return -value if head & 0x8000 else value


def parse(data: bytes) -> dict:
    if len(data) < 12 or data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("no AIFF header")
    at, out = 12, {}
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        body = at + 8
        if kind == b"COMM" and body + 18 <= len(data):
            channels, frames, bits = struct.unpack_from(">hIh", data, body)
            packed = data[8:12] == b"AIFC" and body + 22 <= len(data)
            out |= {"channels": channels, "frames": frames, "bits": bits, "rate": extended(data[body + 8 : body + 18]), "compression": data[body + 18 : body + 22].decode("latin-1") if packed else "NONE"}
        elif kind == b"SSND" and body + 8 <= len(data):
            offset = struct.unpack_from(">I", data, body)[0]
            out |= {"data_offset": body + 8 + offset, "data_bytes": max(0, min(size - 8 - offset, len(data) - body - 8 - offset))}
        at = body + size + (size & 1)
    if "channels" not in out or "data_offset" not in out:
        raise ValueError("no COMM or SSND chunk")
    return out


def ima_blocks(data: bytes) -> np.ndarray:
    """16-bit samples (blocks, 64) of whole IMA blocks, all decoded side by side, each from the state in its own header."""
    rows = np.frombuffer(data[: len(data) // BLOCK * BLOCK], np.uint8).reshape(-1, BLOCK).astype(np.int64)
    head = rows[:, 0] << 8 | rows[:, 1]
    value, index = (head & 0xFF80 ^ 0x8000) - 0x8000, np.minimum(head & 127, len(STEPS) - 1)
    out = np.empty((len(rows), BLOCK_SAMPLES), np.int64)
    for k in range(BLOCK_SAMPLES):
        code = rows[:, 2 + k // 2] >> 4 * (k % 2) & 15
        step = STEPS[index]
        move = (step >> 3) + sum(np.where(code & 4 >> j, step >> j, 0) for j in range(3))
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
        out[:, k] = value
    return out


def samples_of(data: bytes, head: dict) -> np.ndarray:
    """Interleaved samples of whole frames within ±1, as many as the header says at most; floats are as they stand."""
    body, channels = data[head["data_offset"] : head["data_offset"] + head["data_bytes"]], head["channels"]
    if channels < 1:
        raise ValueError("no channels")
    if head["compression"] == "ima4":
        groups = len(body) // (BLOCK * channels)
        x = ima_blocks(body[: groups * BLOCK * channels]).reshape(groups, channels, BLOCK_SAMPLES)
        return x.transpose(0, 2, 1).ravel() / 32768.0
    encoding = ENCODINGS.get(head["compression"])
    if head["compression"] == "NONE":
        encoding = {1: "s8", 2: "s16be", 3: "s24be", 4: "s32be"}.get(-(-head["bits"] // 8))
    if encoding is None:
        raise ValueError(f"unsupported compression {head['compression']} of {head['bits']} bits")
    return raw.decoded(body[: head["frames"] * channels * raw.SIZES[encoding]], encoding)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{aif,aiff,aifc}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in HEADER.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append({"path": p, "error": None} | parse(bytes(data)))
                except ValueError as e:
                    rows.append({"path": p, "error": str(e)})
            got = pd.DataFrame(rows, columns=names)
            for c in ("compression", "error"):
                got[c] = got[c].astype(object).where(got[c].notna(), None)
            for c in ("channels", "bits", "frames", "data_offset", "data_bytes"):
                got[c] = got[c].astype("Int64")
            yield got

    return _files(spark, path).mapInPandas(run, HEADER)


def samples_in(files: DataFrame) -> DataFrame:
    """A row for each sample of the files(path, content) that can be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                try:
                    x = samples_of(bytes(data), head := parse(bytes(data)))
                except ValueError:
                    continue
                yield from raw.sample_rows(p, x, head["channels"])

    return files.mapInPandas(run, raw.SAMPLES)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample of the files that can be read."""
    return samples_in(_files(spark, path))
