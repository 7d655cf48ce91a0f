"""Signal quality: errors of a candidate against a reference, by stream, frame and tile, and the best alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for an infinite ratio, so results compare everywhere.
INFINITE = 999.0


def snr_db(signal: Column, noise: Column, silent: float) -> Column:
    """10 log10 of signal to noise energy: no noise is infinite; no signal is what the caller says."""
    return F.when(noise == 0, INFINITE).when(signal == 0, silent).otherwise(10 * F.log10(signal / F.nullif(noise, F.lit(0.0))))


def compared(pairs: DataFrame, *by: str) -> DataFrame:
    """pairs(ref, cand): rms of both, largest and mean error, rmse, SNR and errors above thresholds, for each group."""
    e = F.abs(F.col("ref") - F.col("cand"))
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("ref") * F.col("ref"))).alias("rms_ref"), F.sqrt(F.avg(F.col("cand") * F.col("cand"))).alias("rms_cand"),
        F.max(e).alias("max_abs"), F.avg(e).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(F.col("ref") * F.col("ref")).alias("signal"), F.sum(e * e).alias("noise"),
        F.count_if(e > 0.00001).alias("above_low"), F.count_if(e > 0.0001).alias("above_high"),
    )
    return sums.withColumn("snr_db", snr_db(F.col("signal"), F.col("noise"), -INFINITE)).drop("signal", "noise")


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Percentiles by index round((n - 1) p) of the sorted values.

    Ranks come from a window, counts from an aggregate, so a group's values are sorted and spilled, not collected.
    """
    order = Window.partitionBy(*by).orderBy(value)
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    picks = [F.max(F.when(F.col("rank") == F.round((F.col("of") - 1) * p), F.col(value))).alias(k) for k, p in shares.items()]
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *picks)


def frame_errors(pairs: DataFrame, size: int, *by: str) -> DataFrame:
    """rmse, largest and mean error of tumbling frames of `size` samples."""
    e = F.col("ref") - F.col("cand")
    frames = pairs.withColumn("frame_no", F.expr(f"frame div {size}"))
    return frames.groupBy(*by, "frame_no").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs"), F.avg(F.abs(e)).alias("mean_abs"))


def tile_errors(pairs: DataFrame, size: int, *by: str) -> DataFrame:
    """Error of each tile and the first sample where it is largest."""
    e = F.abs(F.col("ref") - F.col("cand"))
    tiles = pairs.withColumn("tile", F.expr(f"frame div {size}")).withColumn("e", e)
    worst = F.max(F.struct(F.col("e"), (-F.col("frame")).alias("back")))
    got = tiles.groupBy(*by, "tile").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), worst.alias("w"))
    return got.select(*by, "tile", "rmse", F.col("w.e").alias("max_abs"), (-F.col("w.back")).alias("at"))


def best_shift(reference: DataFrame, candidate: DataFrame, most: int, by: str, digits: int = 9) -> DataFrame:
    """The shift within ±most frames with the least rmse; ties go to the smaller shift, then to the negative one.

    Each sample meets 2 most + 1 others by an equi-join on the shifted frame, however long the streams are.
    """
    shifts = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    moved = candidate.select(by, "frame", F.col("x").alias("c"), shifts.alias("shift")).withColumn("frame", F.col("frame") - F.col("shift"))
    both = reference.select(by, "frame", F.col("x").alias("r")).join(moved, [by, "frame"])
    errors = both.groupBy(by, "shift").agg(F.sqrt(F.avg((F.col("r") - F.col("c")) * (F.col("r") - F.col("c")))).alias("rmse"))
    return errors.groupBy(by).agg(F.min(F.struct(F.round("rmse", digits).alias("rmse"), F.abs("shift").alias("size"), "shift")).alias("b")).select(by, "b.shift", "b.rmse")


def energy_peak(samples: DataFrame, width: int, by: str, digits: int = 9) -> DataFrame:
    """Start of the window of `width` samples with the most energy, the last of equals."""
    window = Window.partitionBy(by).orderBy("frame").rowsBetween(0, width - 1)
    full = samples.withColumn("energy", F.round(F.sum(F.col("x") * F.col("x")).over(window), digits)).withColumn("n", F.count(F.lit(1)).over(window)).where(F.col("n") == width)
    return full.groupBy(by).agg(F.max(F.struct("energy", "frame")).alias("b")).select(by, F.col("b.frame").alias("start_frame"), "b.energy")


def waveform_peaks(samples: DataFrame, bins: int, by: str) -> DataFrame:
    """Largest amplitude of each of `bins` equal parts of a stream of 16-bit samples x, of full scale."""
    sizes = samples.groupBy(by).agg(F.count(F.lit(1)).alias("of"))
    part = F.expr(f"cast(frame div ceil(of / {bins}.0) as bigint)").alias("bin")
    return samples.join(sizes, by).select(by, part, "x").groupBy(by, "bin").agg((F.max(F.abs("x")) / F.lit(32768.0)).alias("peak"))


def hotspots(frames: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k worst frames by rmse, then by largest error."""
    return frames.orderBy(F.desc("rmse"), F.desc("max_abs"), *tie).limit(k)
