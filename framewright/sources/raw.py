"""Headerless samples: files of one wire format and a number of channels, as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.wire import WIRE, unpacked

SAMPLES = "path string, channel int, frame long, x double"
#: Samples of a batch.
BATCH = 1 << 18
#: Encodings of files alone, as NumPy's types.
FILES = {"s8": "i1", "f64be": ">f8"}
#: Bytes of a sample by the name of its encoding.
SIZES = {name: size for name, (_, size) in WIRE.items()} | {"s8": 1, "f64be": 8, "ulaw": 1, "alaw": 1}


def ulaw_table() -> np.ndarray:
    """The 16-bit value of each u-law code."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size)


def alaw_table() -> np.ndarray:
    """The 16-bit value of each A-law code."""
    code = np.arange(256) ^ 0x55
    step, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, low + 264 << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size)


def decoded(data: bytes, encoding: str) -> np.ndarray:
    """Whole samples of a block within ±1; floats are as they stand."""
    if encoding in ("ulaw", "alaw"):
        table = ulaw_table() if encoding == "ulaw" else alaw_table()
        return table[np.frombuffer(data, np.uint8)] / 32768.0
    whole = data[: len(data) // SIZES[encoding] * SIZES[encoding]]
    x = (np.frombuffer(whole, FILES[encoding]) if encoding in FILES else unpacked(whole, encoding)).astype(np.float64)
    if encoding[0] == "f":
        return x
    return (x - 128) / 128 if encoding == "u8" else x / float(1 << (8 * SIZES[encoding] - 1))


def sample_rows(path: str, x: np.ndarray, channels: int) -> Iterator[pd.DataFrame]:
    """Rows of interleaved samples, in batches."""
    x = x[: len(x) // channels * channels].reshape(-1, channels)
    step = max(1, BATCH // channels)
    for a in range(0, len(x), step):
        part = x[a : a + step]
        yield pd.DataFrame({"path": path, "channel": np.tile(np.arange(channels), len(part)), "frame": np.repeat(np.arange(a, a + len(part)), channels), "x": part.ravel()})


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _checked(encoding: str, channels: int) -> int:
    """Bytes of a frame."""
    if encoding not in SIZES:
        raise ValueError(f"unknown encoding {encoding}")
    if channels < 1:
        raise ValueError("no channels")
    return SIZES[encoding] * channels


def read_extents(spark: SparkSession, path: str, encoding: str, channels: int, rate: int, pattern: str = "*") -> DataFrame:
    """(path, frames, seconds, tail_bytes, error) of each file, from its length alone; one that ends within a frame says so in error. Empty files give no row, as Spark passes over them."""
    size = _checked(encoding, channels)
    tail = (F.col("length") % size).alias("tail_bytes")
    frames = F.floor(F.col("length") / size).cast("long")
    rows = _files(spark, path, pattern).select("path", frames.alias("frames"), (frames / F.lit(float(rate))).alias("seconds"), tail)
    return rows.withColumn("error", F.when(F.col("tail_bytes") > 0, F.concat(F.col("tail_bytes").cast("string"), F.lit(" bytes after the last whole frame"))))


def read_samples(spark: SparkSession, path: str, encoding: str, channels: int, pattern: str = "*") -> DataFrame:
    """A row for each sample of the whole frames of each file."""
    size = _checked(encoding, channels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                yield from sample_rows(p, decoded(bytes(data[: len(data) // size * size]), encoding), channels)

    return _files(spark, path, pattern).select("path", "content").mapInPandas(run, SAMPLES)
