"""Samples on the wire: blocks of bytes in either order as arrays of numbers, and back, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: NumPy's type and the bytes of a sample of each wire format; samples of three bytes are taken apart by hand.
WIRE = {"u8": ("u1", 1), "s16le": ("<i2", 2), "s16be": (">i2", 2), "s24le": ("<s24", 3), "s24be": (">s24", 3), "s32le": ("<i4", 4), "s32be": (">i4", 4), "f32le": ("<f4", 4), "f32be": (">f4", 4)}


def unpacked(data: bytes, wire: str) -> np.ndarray:
    """Samples of a block; bytes of a sample that is cut off are left out."""
    kind, size = WIRE[wire]
    whole = data[: len(data) // size * size]
    if size != 3:
        return np.frombuffer(whole, kind)
    part = np.frombuffer(whole, np.uint8).reshape(-1, 3).astype(np.int32)
    low, high = (part[:, 0], part[:, 2]) if kind[0] == "<" else (part[:, 2], part[:, 0])
    value = high << 16 | part[:, 1] << 8 | low
    return np.where(value >= 1 << 23, value - (1 << 24), value)


def packed(values: np.ndarray, wire: str) -> bytes:
    """The low bytes of each sample in a wire format."""
    kind, size = WIRE[wire]
    if size != 3:
        return np.asarray(values).astype(kind).tobytes()
    four = np.asarray(values).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
    return (four if kind[0] == "<" else four[:, ::-1]).tobytes()


def samples(data: Column, wire: str) -> Column:
    """A block of bytes as an array of its samples: double for floats, long for integers; null stays null."""

    @F.pandas_udf("array<double>" if wire[0] == "f" else "array<long>")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else unpacked(bytes(b), wire).astype(float if wire[0] == "f" else np.int64))

    return run(data)


def block(values: Column, wire: str) -> Column:
    """An array of samples as a block of bytes; null stays null."""

    @F.pandas_udf("binary")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda v: None if v is None else packed(np.asarray(v), wire))

    return run(values.cast("array<double>" if wire[0] == "f" else "array<long>"))


def frames_of(data: Column, bits: Column, channels: Column) -> tuple[Column, Column]:
    """Whole frames of a block and the bytes left over; a stream may end on whole frames alone."""
    size = F.ceil(bits / 8) * channels
    return F.floor(F.octet_length(data) / size).cast("long"), (F.octet_length(data) % size).cast("long")
