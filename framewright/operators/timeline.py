"""Timelines: sample tables, run lengths, edit lists, trims, clocks and runs of contiguous packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WRAP = 1 << 33


def sample_index(samples: DataFrame, track: str, order: list[str], chunk: int) -> DataFrame:
    """Adds sample_id, chunk, decode_time (durations before it in the track) and chunk_offset (sizes before it in the chunk)."""
    w = Window.partitionBy(track).orderBy(*order)
    numbered = samples.withColumn("sample_id", F.row_number().over(w))
    numbered = numbered.withColumn("decode_time", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.withColumn("chunk", F.expr(f"(sample_id - 1) div {chunk}"))
    inside = Window.partitionBy(track, "chunk").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("chunk_offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))


def run_lengths_expanded(runs: DataFrame, key: str, order: str, count: str, value: str) -> DataFrame:
    """(key, sample_id, value): a row for each item of each run, numbered through the key.

    Offsets are sums over runs; only then do runs part into rows, so no window goes over the items.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = runs.where(F.col(count) > 0).withColumn("first", F.coalesce(F.sum(count).over(w), F.lit(0)))
    items = first.select(key, value, "first", F.posexplode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("i", "_"))
    return items.select(key, (F.col("first") + F.col("i") + 1).alias("sample_id"), value)


def edit_starts(edits: DataFrame, track: str, order: str) -> DataFrame:
    """Adds presentation_start to edits: durations before them. Empty edits (media_time -1) move time on and go."""
    w = Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("presentation_start", F.coalesce(F.sum("duration").over(w), F.lit(0))).where("media_time <> -1")


def edit_mapped(times: DataFrame, edits: DataFrame, track: str, time: str) -> DataFrame:
    """Adds presentation to times, by the edit that holds a time, else the first in order that begins after it, else the last.

    The edits of a track, few, travel with it as one array, so times need a join by track alone.
    """
    lists = edits.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("entry_no", "media_time", "duration", "presentation_start"))).alias("edits"))
    both = times.join(lists, track, "left")
    t = F.col(time)
    inside = F.filter("edits", lambda e: (t >= e["media_time"]) & (t < e["media_time"] + e["duration"]))
    after = F.filter("edits", lambda e: t < e["media_time"])
    chosen = F.coalesce(F.get(inside, F.lit(0)), F.get(after, F.lit(0)), F.try_element_at("edits", F.lit(-1)))
    return both.withColumn("e", chosen).withColumn("presentation", F.coalesce(t - F.col("e.media_time") + F.col("e.presentation_start"), t)).drop("e", "edits")


def interval_trimmed(packets: DataFrame) -> DataFrame:
    """packets(start, duration, frames, edit_start, edit_duration, timescale, rate) with source_start and source_count.

    The overlap of packet and edit in decoded frames: its start rounded up, its end down, clamped; packets without one go.
    """
    begin, end = F.greatest("start", "edit_start"), F.least(F.col("start") + F.col("duration"), F.col("edit_start") + F.col("edit_duration"))
    cut = packets.withColumn("b", begin - F.col("start")).withColumn("e", end - F.col("start")).where("e > b and frames > 0")
    cut = cut.withColumn("source_start", F.expr("least(frames, cast((cast(b as decimal(20,0)) * rate + timescale - 1) div timescale as bigint))"))
    cut = cut.withColumn("source_end", F.expr("least(frames, cast(cast(e as decimal(20,0)) * rate div timescale as bigint))"))
    return cut.where("source_end > source_start").withColumn("source_count", F.col("source_end") - F.col("source_start")).drop("b", "e", "source_end")


def pts_unwrapped(packets: DataFrame, key: str, order: str, pts: str, wrap: int = WRAP) -> DataFrame:
    """Adds unwrapped: time stamps of a clock that starts anew; a fall by more than half of it is a new round."""
    w = Window.partitionBy(key).orderBy(order)
    fell = packets.withColumn("fell", (F.lag(pts).over(w) - F.col(pts) > wrap // 2).cast("long"))
    rounds = F.sum(F.coalesce("fell", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return fell.withColumn("unwrapped", F.col(pts) + rounds * wrap).drop("fell")


def coalesced(packets: DataFrame, key: str, order: str, start: str, length: str) -> DataFrame:
    """(key, run, start, length, n): runs of packets each of which begins where the one before it ends."""
    w = Window.partitionBy(key).orderBy(order)
    broken = F.coalesce((F.lag(F.col(start) + F.col(length)).over(w) != F.col(start)).cast("int"), F.lit(0))
    runs = packets.withColumn("broken", broken).withColumn("run", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(start).alias("start"), F.sum(length).alias("length"), F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, key: str, order: list[str], breaks: str) -> DataFrame:
    """Adds session: how many rows so far, this one included, break the stream."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session", F.sum(F.expr(f"cast({breaks} as int)")).over(w))


def rechunked(samples: DataFrame, key: str, size: int) -> DataFrame:
    """(key, block, start_frame, n, total) of blocks of `size` frames; the last may be short."""
    blocks = samples.withColumn("block", F.expr(f"frame div {size}"))
    return blocks.groupBy(key, "block").agg(F.min("frame").alias("start_frame"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def lerp_resampled(samples: DataFrame, key: str, source: int, target: int) -> DataFrame:
    """(key, out_frame, x): samples(frame, x) at another rate by linear interpolation, round(n target / source) of them.

    A sample and its successor make the output frames between them; past the last pair its last sample repeats.
    """
    w = Window.partitionBy(key).orderBy("frame")
    rows = samples.select(key, "frame", "x", F.lead("x").over(w).alias("next"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    first = F.expr(f"(frame * {target} + {source} - 1) div {source}")
    end = F.when(F.col("next").isNull(), F.round(F.col("n") * target / source).cast("long")).otherwise(F.expr(f"((frame + 1) * {target} + {source} - 1) div {source}"))
    spans = rows.withColumn("first", first).withColumn("end", end).where("end > first")
    out = spans.select(key, "frame", "x", "next", F.explode(F.sequence("first", F.col("end") - 1)).alias("out_frame"))
    share = F.col("out_frame") * F.lit(float(source)) / target - F.col("frame")
    return out.select(key, "out_frame", F.when(F.col("next").isNull(), F.col("x")).otherwise(F.col("x") + (F.col("next") - F.col("x")) * share).alias("x"))
