"""The star-schema tables seen as streams, packets, tracks and tags; beside each, SQL that makes the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = """samples AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
 greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 250) / 250)) AS x, event_id, event_type FROM events)"""
PAIRS = "pairs AS (SELECT stream_id, frame, x AS ref, round(x * CASE WHEN x < 0 THEN 32768 ELSE 32767 END) / 32768.0 AS cand FROM samples)"
INTS = "ints AS (SELECT event_id, x, CAST(round(x * CASE WHEN x < 0 THEN 32768 ELSE 32767 END) AS INTEGER) AS i16 FROM samples)"
PLANES = """flat AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
planes AS (SELECT vec_id, pos % 2 AS channel, pos // 2 AS frame, CAST(v AS DOUBLE) AS x FROM flat)"""
INDEX = """idx0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag) AS sample_id FROM lineitem),
idx AS (SELECT l_orderkey AS track_id, sample_id, CAST(l_quantity AS BIGINT) AS size, CAST(l_linenumber AS BIGINT) AS duration, (sample_id - 1) // 2 AS chunk,
 coalesce(sum(CAST(l_linenumber AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS decode_time FROM idx0)"""
EDITS = """edits0 AS (SELECT o_custkey AS track_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entry_no, 10 + o_orderkey % 50 AS duration,
 CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE (o_orderkey * 37) % 400 END AS media_time FROM orders),
edits AS (SELECT * FROM (SELECT *, coalesce(sum(duration) OVER (PARTITION BY track_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS presentation_start FROM edits0) WHERE media_time <> -1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame, x, event_id, event_type): events of a user as samples of a stream, within ±1."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 250) / 250))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), x.alias("x"), "event_id", "event_type")


def planes(spark: SparkSession, sf_dir: str, channels: int = 2) -> DataFrame:
    """(vec_id, channel, frame, x): vectors as interleaved blocks."""
    from framewright.operators.channels import deinterleaved

    return deinterleaved(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", channels).withColumn("x", F.col("x").cast("double"))


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, size, duration, ...): lines of an order as samples of a track, in an order that no tie leaves open."""
    return table(spark, sf_dir, "lineitem").withColumns({"track_id": F.col("l_orderkey"), "size": F.col("l_quantity").cast("long"), "duration": F.col("l_linenumber").cast("long")})


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, entry_no, duration, media_time): orders of a customer as entries of an edit list."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    media = F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_orderkey") * 37 % 400)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track_id"), F.row_number().over(order).alias("entry_no"), (F.col("o_orderkey") % 50 + 10).alias("duration"), media.alias("media_time"))
