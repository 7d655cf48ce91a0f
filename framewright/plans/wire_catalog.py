"""Queries of the sample formats on the wire: bytes made of the events' samples, read back and converted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import pcm, wire
from framewright.plans import adapt
from framewright.plans.adapt import INTS, SAMPLES
from framewright.plans.registry import query

WIRES = f"""WITH {SAMPLES}, {INTS}, w AS (SELECT event_id, CAST(i16 AS BIGINT) AS s16, CAST(i16 AS BIGINT) * 256 + event_id % 256 AS s24, CAST(i16 AS BIGINT) * 65536 + event_id % 65536 AS s32, CAST(CAST(x AS FLOAT) AS DOUBLE) AS f32 FROM ints),
v AS (SELECT event_id, s16, s24, s32, f32, -1 - s16 AS s16_b, -1 - s24 AS s24_b, -1 - s32 AS s32_b, -f32 AS f32_b FROM w)"""


def samples(spark, sf: str) -> DataFrame:
    """(event_id, s16, s24, s32, f32): the samples of the events in each depth."""
    s = adapt.samples(spark, sf).select("event_id", "x", pcm.float_to_i16_rounded(F.col("x")).cast("long").alias("s16"))
    return s.select("event_id", "s16", (F.col("s16") * 256 + F.col("event_id") % 256).alias("s24"), (F.col("s16") * 65536 + F.col("event_id") % 65536).alias("s32"), F.col("x").cast("float").cast("double").alias("f32"))


def _both(source: str) -> Column:
    """A sample and its counterpart of the other sign."""
    c = F.col(source)
    return F.array(c, -c if source == "f32" else -1 - c)


_same = lambda x: x
#: Name, wire format, rule, and the rule as SQL.
CONVERSIONS: list[tuple[str, str, Callable[[Column], Column], str]] = [
    ("s16le_to_i16", "s16le", _same, "{v}"),
    ("s16be_to_i16", "s16be", _same, "{v}"),
    ("s16le_to_i32", "s16le", lambda x: x.cast("int").cast("long"), "{v}"),
    ("s16le_to_f32", "s16le", pcm.i16_to_float, "{v} / 32768.0::DOUBLE"),
    ("s24le_to_i32", "s24le", _same, "{v}"),
    ("s24le_to_i16", "s24le", lambda x: pcm.shifted_to_i16(x, 24), "{v} >> 8"),
    ("s24be_to_i16", "s24be", lambda x: pcm.shifted_to_i16(x, 24), "{v} >> 8"),
    ("s32le_to_i32", "s32le", _same, "{v}"),
    ("s32be_to_i32", "s32be", _same, "{v}"),
    ("s32le_to_s24", "s32le", pcm.low_24, "{v} & 16777215"),
    ("s32be_to_s24", "s32be", pcm.low_24, "{v} & 16777215"),
    ("s32le_to_f32", "s32le", lambda x: x / F.lit(2147483647.0), "{v} / 2147483647.0::DOUBLE"),
    ("s32be_to_f32", "s32be", lambda x: x / F.lit(2147483647.0), "{v} / 2147483647.0::DOUBLE"),
    ("s32le_to_i16", "s32le", lambda x: pcm.shifted_to_i16(x, 32), "{v} >> 16"),
    ("s32be_to_i16", "s32be", lambda x: pcm.shifted_to_i16(x, 32), "{v} >> 16"),
    ("f32le_to_f32", "f32le", _same, "{v}"),
    ("f32le_to_i16", "f32le", pcm.float_to_i16_truncated, "CAST(trunc(greatest(-1, least(1, {v})) * 32767) AS BIGINT)"),
    ("f32be_to_i16", "f32be", pcm.float_to_i16_truncated, "CAST(trunc(greatest(-1, least(1, {v})) * 32767) AS BIGINT)"),
    ("f32le_to_i32", "f32le", pcm.float_to_i32_asymmetric, "CAST(trunc(CASE WHEN {v} >= 0 THEN {v} * 2147483647 ELSE {v} * 2147483648 END) AS BIGINT)"),
    ("f32le_to_s24", "f32le", pcm.float_to_s24_asymmetric, "CAST(trunc(CASE WHEN {v} >= 0 THEN {v} * 8388607 ELSE {v} * 8388608 END) AS BIGINT)"),
]


def _conversion(name: str, form: str, rule: Callable[[Column], Column], sql: str) -> None:
    source = form[:3]

    def run(spark, sf):
        got = samples(spark, sf).select("event_id", wire.samples(wire.block(_both(source), form), form).alias("v"))
        kind = "double" if name.endswith("f32") else "long"
        return got.select("event_id", rule(F.get("v", F.lit(0))).cast(kind).alias("a"), rule(F.get("v", F.lit(1))).cast(kind).alias("b"))

    query(f"{WIRES} SELECT event_id, {sql.format(v=source)} AS a, {sql.format(v=source + '_b')} AS b FROM v", f"wire_{name}")(run)


for _c in CONVERSIONS:
    _conversion(*_c)


@query(WIRES + " SELECT event_id, format('{:02X}{:02X}{:02X}{:02X}', s16 & 255, (s16 >> 8) & 255, s16_b & 255, (s16_b >> 8) & 255) AS bytes FROM v")
def wire_i16_to_bytes(spark, sf):
    return samples(spark, sf).select("event_id", F.hex(wire.block(_both("s16"), "s16le")).alias("bytes"))


@query(WIRES + """ SELECT event_id, 8 * (event_id % 4 + 1) AS bits, CASE event_id % 4 WHEN 0 THEN format('{:02X}', (s16 >> 8) + 128) WHEN 1 THEN format('{:02X}{:02X}', s16 & 255, (s16 >> 8) & 255)
 WHEN 2 THEN format('{:02X}{:02X}{:02X}', s24 & 255, (s24 >> 8) & 255, (s24 >> 16) & 255) ELSE format('{:02X}{:02X}{:02X}{:02X}', s32 & 255, (s32 >> 8) & 255, (s32 >> 16) & 255, (s32 >> 24) & 255) END AS bytes FROM v""")
def wire_pack_bits(spark, sf):
    """Samples of 8 bits are unsigned on the wire."""
    s, k = samples(spark, sf), F.col("event_id") % 4
    one = F.when(k == 0, wire.block(F.array(F.shiftright("s16", 8) + 128), "u8")).when(k == 1, wire.block(F.array("s16"), "s16le")).when(k == 2, wire.block(F.array("s24"), "s24le")).otherwise(wire.block(F.array("s32"), "s32le"))
    return s.select("event_id", (8 * (k + 1)).alias("bits"), F.hex(one).alias("bytes"))


_FORMS = [("s16le", 32768.0), ("s16be", 32768.0), ("s24le", 8388608.0), ("s24be", 8388608.0), ("s32le", 2147483648.0), ("f32be", 1.0)]


@query(WIRES + """ SELECT event_id, CASE WHEN event_id % 6 < 2 THEN s16 / 32768.0::DOUBLE WHEN event_id % 6 < 4 THEN s24 / 8388608.0::DOUBLE WHEN event_id % 6 = 4 THEN s32 / 2147483648.0::DOUBLE ELSE f32 END AS x FROM v""")
def wire_sample_by_format(spark, sf):
    """One sample by its depth, its encoding and its byte order."""
    s, k, x = samples(spark, sf), F.col("event_id") % 6, F.lit(None).cast("double")
    for i, (form, scale) in enumerate(_FORMS):
        x = F.when(k == i, F.get(wire.samples(wire.block(F.array(form[:3]), form), form), F.lit(0)) / F.lit(scale)).otherwise(x)
    return s.select("event_id", x.alias("x"))


@query(WIRES + """ SELECT event_id, CASE WHEN event_id % 2 = 0 THEN s16 / 32768.0::DOUBLE ELSE s32 / 2147483647.0::DOUBLE END AS l, CASE WHEN event_id % 2 = 0 THEN s16_b / 32768.0::DOUBLE ELSE s32_b / 2147483647.0::DOUBLE END AS r,
 round(CASE WHEN event_id % 2 = 0 THEN (s16 + s16_b) / 65536.0::DOUBLE ELSE (s32 / 2147483647.0::DOUBLE + s32_b / 2147483647.0::DOUBLE) / 2 END, 12) AS mono FROM v""")
def wire_planes_by_depth(spark, sf):
    """Interleaved blocks of two channels as planes of floats, by depth, and their mean."""
    s, deep = samples(spark, sf), F.col("event_id") % 2 == 1
    x = F.when(deep, F.transform(wire.samples(wire.block(_both("s32"), "s32le"), "s32le"), lambda v: v / F.lit(2147483647.0))).otherwise(F.transform(wire.samples(wire.block(_both("s16"), "s16le"), "s16le"), lambda v: v / F.lit(32768.0)))
    got = s.select("event_id", x.alias("x")).select("event_id", F.get("x", F.lit(0)).alias("l"), F.get("x", F.lit(1)).alias("r"))
    return got.withColumn("mono", F.round((F.col("l") + F.col("r")) / 2, 12))


@query(WIRES + """ SELECT event_id, f32 AS l, CASE WHEN event_id % 3 = 0 THEN f32 ELSE f32_b END AS r FROM v""")
def wire_stereo_pair(spark, sf):
    """One channel serves both sides, of several the first two do."""
    s = samples(spark, sf)
    x = wire.samples(wire.block(F.when(F.col("event_id") % 3 == 0, F.array("f32")).when(F.col("event_id") % 3 == 1, _both("f32")).otherwise(F.concat(_both("f32"), F.array(F.lit(0.5)))), "f32le"), "f32le")
    got = s.select("event_id", x.alias("x"))
    return got.select("event_id", F.get("x", F.lit(0)).alias("l"), F.coalesce(F.get("x", F.lit(1)), F.get("x", F.lit(0))).alias("r"))


@query("""SELECT doc_id, strlen(coalesce(text, '')) // (CAST(ceil((8 + 8 * (doc_id % 4)) / 8.0) AS BIGINT) * (doc_id % 3 + 1)) AS frames, strlen(coalesce(text, '')) % (CAST(ceil((8 + 8 * (doc_id % 4)) / 8.0) AS BIGINT) * (doc_id % 3 + 1)) AS rest,
 strlen(coalesce(text, '')) % (CAST(ceil((8 + 8 * (doc_id % 4)) / 8.0) AS BIGINT) * (doc_id % 3 + 1)) = 0 AS whole FROM documents""")
def wire_frame_count(spark, sf):
    """Frames of a headerless block, what is kept for the next one, and whether a stream may end here."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    frames, rest = wire.frames_of(data, 8 + 8 * (F.col("doc_id") % 4), F.col("doc_id") % 3 + 1)
    return adapt.table(spark, sf, "documents").select("doc_id", frames.alias("frames"), rest.alias("rest"), (rest == 0).alias("whole"))
