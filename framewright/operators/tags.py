"""Descriptive tags: first-wins scalars, ordered distinct lists, and raw multimaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_up(tags: DataFrame, key: str, order: str, tag: str, value: str) -> DataFrame:
    """(key, tag, first_value, all_values, n): the first value, and the distinct ones in the order they came, joined by a bar.

    Each distinct value is first reduced to where it came first, so what is gathered has no repeats.
    """
    once = tags.groupBy(key, tag, value).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("c"))
    got = once.groupBy(key, tag).agg(F.min(F.struct("o", F.col(value).alias("v"))).alias("f"), F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))).alias("l"), F.sum("c").alias("n"))
    return got.select(key, tag, F.col("f.v").alias("first_value"), F.array_join(F.transform("l", lambda x: x["v"]), "|").alias("all_values"), "n")
