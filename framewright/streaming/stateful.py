"""Stateful streams: per-key state of a few numbers, the same results however the input is cut into batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators.framed import FRAMES, LARGEST, cut

WRAP = 1 << 33


def unwrapped_stream(packets: DataFrame) -> DataFrame:
    """packets(stream_id, seq, pts) with unwrapped; state: the last stamp and the rounds of its clock."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rounds = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, pts in zip(rows["seq"].tolist(), rows["pts"].tolist(), strict=True):
            rounds += last - pts > WRAP // 2
            last = pts
            out.append((key[0], seq, pts + rounds * WRAP))
        state.update((last, rounds))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "unwrapped"])

    return packets.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, unwrapped long", "last long, rounds long", "append", GroupStateTimeout.NoTimeout)


def continuity_stream(packets: DataFrame, modulus: int = 16) -> DataFrame:
    """packets(stream_id, seq, counter) with duplicate and gap; state: the last counter."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, counter in zip(rows["seq"].tolist(), rows["counter"].tolist(), strict=True):
            out.append((key[0], seq, last == counter, last >= 0 and last != counter and (last + 1) % modulus != counter))
            last = counter
        state.update((last,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "duplicate", "gap"])

    return packets.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, duplicate boolean, gap boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def frames_stream(chunks: DataFrame, most: int = LARGEST) -> DataFrame:
    """chunks(stream_id, seq, data) as length-prefixed frames (32-bit, big-endian); state: bytes of a frame that has begun.

    A frame of more than `most` bytes ends its stream with a row whose error says so; no state outgrows that bound.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, out = cut(state.get if state.exists else (b"", 0, False), pd.concat(list(frames)).sort_values("seq")["data"], most)
        state.update(left)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["stream_id", "frame", "payload", "error"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, FRAMES, "held binary, number long, dead boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_quality(pairs: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """pairs(ts, stream_id, ref, cand): rmse and largest error of event-time windows, late rows within `delay` counted."""
    e = F.col("ref") - F.col("cand")
    got = pairs.withWatermark("ts", delay).groupBy(F.window("ts", width), "stream_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs"))
    return got.select(F.col("window.start").alias("start"), "stream_id", "n", "rmse", "max_abs")
