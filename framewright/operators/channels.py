"""Channel layout: interleaving, mono and stereo mixes, trims of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDE = 0.707


def deinterleaved(blocks: DataFrame, block: str, data: str, channels: int) -> DataFrame:
    """(block, channel, frame, x) of interleaved arrays."""
    flat = blocks.select(block, F.posexplode(data).alias("pos", "x"))
    return flat.select(block, (F.col("pos") % channels).alias("channel"), F.expr(f"cast(pos div {channels} as int)").alias("frame"), "x")


def interleaved(planes: DataFrame, block: str, channels: int) -> DataFrame:
    """(block, pos, x): places of an interleaved block; no frame needs its neighbours."""
    return planes.select(block, (F.col("frame") * channels + F.col("channel")).alias("pos"), "x")


def mono_mean(planes: DataFrame, block: str) -> DataFrame:
    return planes.groupBy(block, "frame").agg(F.avg("x").alias("x"))


def stereo_mix(planes: DataFrame, block: str) -> DataFrame:
    """Front, centre and surround channels of up to six as two, divided by their block's peak where that is above 1.

    The low-frequency channel (3) is left out. The peak is of a block, so blocks must stay those that were decoded.
    """
    weight = lambda own, side: F.when(F.col("channel") == own, 1.0).when(F.col("channel").isin(2, side), SIDE).otherwise(0.0)
    mixed = planes.groupBy(block, "frame").agg(F.sum(F.col("x") * weight(0, 4)).alias("l"), F.sum(F.col("x") * weight(1, 5)).alias("r"))
    peak = F.greatest(F.lit(1.0), F.max(F.greatest(F.abs("l"), F.abs("r"))).over(Window.partitionBy(block)))
    return mixed.select(block, "frame", (F.col("l") / peak).alias("l"), (F.col("r") / peak).alias("r"))


def trimmed(blocks: DataFrame, data: str, start: str, count: str) -> DataFrame:
    """Blocks with `count` samples from `start` on, as far as there are."""
    return blocks.withColumn(data, F.slice(data, F.col(start) + 1, F.col(count)))
