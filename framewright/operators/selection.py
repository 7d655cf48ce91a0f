"""Choosing among rows of tables that describe streams: programmes, streams, tracks, descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stream types of programme tables that hold sound, and what they name.
STREAM_TYPES = {0x03: "mpeg-audio", 0x04: "mpeg-audio", 0x0F: "aac", 0x11: "aac", 0x80: "pcm", 0x81: "ac3", 0x82: "dts", 0x87: "ac3"}


def first_programme(entries: DataFrame, stream: str) -> DataFrame:
    """(stream, program, pid) of entries(stream, program, pid): the smallest programme that is not 0, which is the network's."""
    return entries.where("program <> 0").groupBy(stream).agg(F.min(F.struct("program", "pid")).alias("least")).select(stream, "least.program", "least.pid")


def stream_codecs(spark: SparkSession) -> DataFrame:
    """(stream_type, codec): a dimension of a few rows."""
    return spark.createDataFrame(sorted(STREAM_TYPES.items()), "stream_type long, codec string")


def first_stream(entries: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, pid, codec): of the entries(by, order, pid, stream_type) the first whose type is known."""
    known = entries.join(F.broadcast(stream_codecs(entries.sparkSession)), "stream_type")
    return known.groupBy(by).agg(F.min(F.struct(order, "pid", "codec")).alias("least")).select(by, f"least.{order}", "least.pid", "least.codec")


def first_of_kind(tracks: DataFrame, by: str, order: list[str], good: Column) -> DataFrame:
    """Whole rows: of each `by` the first in order of which `good` holds."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return tracks.where(good).withColumn("__n", n).where("__n = 1").drop("__n")


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Whole rows: of each `by` the last in order, as tables that repeat a key mean their last word."""
    others = [c for c in rows.columns if c not in (by, order)]
    return rows.groupBy(by).agg(F.max(F.struct(order, *others)).alias("last")).select(by, *(f"last.{c}" for c in (order, *others)))


def references_descriptor(pairs: DataFrame, multiples: DataFrame) -> DataFrame:
    """pairs(descriptor_ref, descriptor, ...) with `refers`: no reference refers to all, one to its own, one to a list to all that this names.

    multiples(multiple, subdescriptor) has the lists. A pair is not repeated, however often a list names a descriptor.
    """
    named = multiples.select(F.col("multiple").alias("descriptor_ref"), F.col("subdescriptor").alias("descriptor")).distinct().withColumn("__named", F.lit(True))
    both = pairs.join(named, ["descriptor_ref", "descriptor"], "left")
    refers = F.col("descriptor_ref").isNull() | F.coalesce(F.col("descriptor_ref") == F.col("descriptor"), F.lit(False)) | F.coalesce("__named", F.lit(False))
    return both.withColumn("refers", refers).drop("__named")


def reachable(packages: DataFrame, storages: DataFrame, prefaces: DataFrame) -> DataFrame:
    """packages(source, material) with `reached`: whether a storage of a preface holds both; all are where there is neither preface nor storage.

    storages(storage, package) and prefaces(storage). The storages of a source are looked up, and its material in each of
    them, so no rows are made of the pairs of packages that a storage holds.
    """
    held = storages.join(prefaces.select("storage").distinct(), "storage", "left_semi").select("storage", "package").distinct()
    sources = packages.select("source", "material").distinct().join(held.withColumnRenamed("package", "source"), "source")
    both = sources.join(held.withColumnRenamed("package", "material"), ["storage", "material"], "left_semi").select("source", "material").distinct().withColumn("__held", F.lit(True))
    none = storages.limit(1).count() == 0 and prefaces.limit(1).count() == 0
    return packages.join(both, ["source", "material"], "left").withColumn("reached", F.coalesce("__held", F.lit(none))).drop("__held")


def passes(length_delta: Column, rmse: Column, mean_abs: Column, max_abs: Column, snr_db: Column) -> Column:
    """Whether a comparison stays within the thresholds that hold where none are given."""
    return (length_delta == 0) & (rmse <= 0.005) & (mean_abs <= 0.001) & (max_abs <= 0.5) & (snr_db >= 35.0)


def flac_block(total: Column, requested: Column, least: int = 32, most: int = 32767) -> Column:
    """The largest block of a stream that leaves a last block of none or of `least` frames; null for fewer frames."""
    total, top = total.cast("long"), F.least(F.lit(most), total, requested).cast("long")
    fits = lambda n: (total % n == 0) | (total % n >= least)
    # A block that is smaller by one leaves as many more frames as there are blocks, while they stay fewer than a block.
    rest, blocks = total % top, F.call_function("div", total, top)
    down = F.ceil((F.lit(least) - rest) / blocks)
    searched = lambda low, high: F.array_max(F.filter(F.sequence(F.greatest(F.lit(least).cast("long"), low), high), fits))
    near = top - down
    return F.when(top >= least, F.when(fits(top), top).when((near >= least) & (rest + blocks * down < near), near).otherwise(F.coalesce(searched(top - 2 * least, top), searched(F.lit(least), top))).cast("int"))


def integral_units(value: Column, numerator: Column, denominator: Column, timescale: Column) -> Column:
    """Edit units in ticks of a timescale; null where they are no whole number of ticks."""
    scaled = value.cast("decimal(20,0)") * timescale.cast("decimal(10,0)") * denominator.cast("decimal(8,0)")
    return F.when(scaled % numerator == 0, (scaled / numerator).cast("long"))
