"""Integrity of packet streams: counters, sequences, contiguous stamps, orphans, and summaries that tell order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def continuity(packets: DataFrame, key: str, order: str, counter: str, modulus: int = 16) -> DataFrame:
    """Adds duplicate (the counter stands still) and gap (it goes on by other than one)."""
    before = F.lag(counter).over(Window.partitionBy(key).orderBy(order))
    same = F.coalesce(before == F.col(counter), F.lit(False))
    jumped = F.coalesce((before + 1) % modulus != F.col(counter), F.lit(False))
    return packets.withColumn("duplicate", same).withColumn("gap", ~same & jumped)


def sequence_checked(pages: DataFrame, key: str, order: str, number: str, granule: str) -> DataFrame:
    """Adds lost (numbers passed over) and backwards (the granule falls)."""
    w = Window.partitionBy(key).orderBy(order)
    lost = F.coalesce(F.greatest(F.lit(0), F.col(number) - F.lag(number).over(w) - 1), F.lit(0))
    return pages.withColumn("lost", lost).withColumn("backwards", F.coalesce(F.col(granule) < F.lag(granule).over(w), F.lit(False)))


def contiguous(packets: DataFrame, key: str, order: str, pts: str, frames: str) -> DataFrame:
    """(key, packets, breaks): packets whose stamp is not where the one before ends; a null stamp is what is expected."""
    w = Window.partitionBy(key).orderBy(order)
    expected = F.lag(F.col(pts) + F.col(frames)).over(w)
    broken = F.coalesce((F.col(pts) != expected).cast("int"), F.lit(0))
    return packets.withColumn("broken", broken).groupBy(key).agg(F.count(F.lit(1)).alias("packets"), F.sum("broken").alias("breaks"))


def demux_summary(packets: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, packets, payload_bytes, fingerprint): the fingerprint is of the digests of the payloads in order.

    Digests, not payloads, are gathered for each stream.
    """
    one = packets.select(key, F.struct(F.col(order).alias("o"), F.sha2(F.col(payload), 256).alias("d")).alias("x"), F.octet_length(payload).alias("size"))
    got = one.groupBy(key).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("payload_bytes"), F.array_sort(F.collect_list("x")).alias("all"))
    return got.select(key, "packets", "payload_bytes", F.sha2(F.concat_ws("", F.transform("all", lambda x: x["d"])), 256).alias("fingerprint"))


def orphans(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(parents, keys, "left_anti")


def classified(cases: DataFrame, expected: str, accepted: str) -> DataFrame:
    """Adds outcome: pass, unexpected-accept, unexpected-reject, or missing where a case was not run."""
    e, a = F.col(expected), F.col(accepted)
    return cases.withColumn("outcome", F.when(a.isNull(), "missing").when(e == a, "pass").when(a, "unexpected-accept").otherwise("unexpected-reject"))


def differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of expected(keys, value) whose value in actual differs or is missing."""
    got = actual.select(*keys, F.col("value").alias("actual"))
    return expected.join(got, keys, "left").where(~F.col("value").eqNullSafe(F.col("actual")))
