"""Windowed-sinc rate conversion, in blocks of frames with the neighbours that the kernel reaches.

A block and its margins are what a task holds, so one long stream is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the kernel on either side, and frames of a block.
CROSSINGS, BLOCK = 16, 1 << 16


def kernel(distance: np.ndarray, cutoff: float, reach: float) -> np.ndarray:
    """Hann-windowed sinc at distances in source frames; zero from `reach` on."""
    window = np.where(np.abs(distance) < reach, 0.5 + 0.5 * np.cos(np.pi * distance / reach), 0.0)
    return cutoff * np.sinc(cutoff * distance) * window


def sinc_resampled(samples: DataFrame, key: str, source: int, target: int, crossings: int = CROSSINGS, block: int = BLOCK) -> DataFrame:
    """samples(key, frame, x) at rate `target`: (key, out_frame, x), for every output frame that falls before the last frame's end.

    Frames that are missing count as silence, as does what lies beyond the ends. Going down, the kernel widens so
    that nothing above the lower rate's band is left. A null x is silence; no rows give no rows.
    """
    if source <= 0 or target <= 0:
        raise ValueError("rates are positive")
    step = gcd(source, target)
    up, down = target // step, source // step
    cutoff = min(1.0, target / source)
    reach = crossings / cutoff
    margin = int(np.ceil(reach)) + 1
    if margin > block:
        raise ValueError("a block is shorter than the kernel")
    schema = f"`{key}` {samples.schema[key].dataType.simpleString()}, out_frame long, x double"

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = int(group[1]) * block
        frames, own = rows["frame"].to_numpy(), ~rows["guest"].to_numpy()
        if not own.any():
            return pd.DataFrame({key: [], "out_frame": [], "x": []})
        x = np.zeros(block + 2 * margin)
        x[frames - first + margin] = rows["x"].fillna(0.0).to_numpy()
        end = int(frames[own].max()) + 1
        out = np.arange(-(-first * up // down), -(-end * up // down), dtype=np.int64)
        at, rest = out * down // up, (out * down % up) / up
        total = np.zeros(len(out))
        for k in range(-margin + 1, margin):
            total += x[at - first + margin + k] * kernel(rest - k, cutoff, reach)
        return pd.DataFrame({key: group[0], "out_frame": out, "x": total})

    number = lambda c: F.floor(c / block).cast("long")
    near = F.array_distinct(F.array(number(F.col("frame") - margin), number(F.col("frame")), number(F.col("frame") + margin)))
    spread = samples.select(F.col(key), F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x")).select("*", F.explode(near).alias("__block"))
    spread = spread.where("__block >= 0").withColumn("guest", F.col("__block") != number(F.col("frame")))
    # A margin's frames at the very reach of the array are within it: frames lie in [first - margin, first + block + margin).
    inside = (F.col("frame") >= F.col("__block") * block - margin) & (F.col("frame") < F.col("__block") * block + block + margin)
    return spread.where(inside).groupBy(key, "__block").applyInPandas(run, schema)
