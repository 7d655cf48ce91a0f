"""Queries of whole files: made of the tables' rows, read back by the sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.octets import octets
from framewright.operators.timeline import edit_starts
from framewright.plans.adapt import EDITS, INDEX, ORDER, edits, raw_samples, table
from framewright.plans.registry import query
from framewright.sources import aiff, caf, mp4, tagged, wav

#: Frames of a packet of the files of packets.
FRAMES = 1024


def _text(s: str):
    return F.encode(F.lit(s), "UTF-8")


def _caf_files(spark, sf: str) -> DataFrame:
    """(path, content): a file for each order, a packet for each of its lines, whose size has two digits in the table."""
    own = Window.partitionBy("track_id").orderBy(*ORDER)
    rows = raw_samples(spark, sf).select("track_id", F.row_number().over(own).alias("no"), (F.col("size") * 37 % 3000 + 1).alias("size"))
    digits = F.concat(F.hex(F.shiftright("size", 7) + 128), F.lpad(F.hex(F.col("size").bitwiseAND(F.lit(127))), 2, "0"))
    files = rows.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("no", digits.alias("digits")))).alias("listed"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    priming, remainder, n = F.col("track_id") % 600, F.col("track_id") % 400, F.col("n")
    table_ = F.concat(octets(n, 8), octets(n * FRAMES - priming - remainder, 8), octets(priming, 4), octets(remainder, 4), F.unhex(F.array_join("listed.digits", "")))
    rate = F.unhex(F.lit("40E5888000000000"))  # 44,100 as a double
    parts = [_text("caff"), F.unhex(F.lit("00010000")), _text("desc"), octets(F.lit(32), 8), rate, _text("aac "), *(octets(F.lit(v), 4) for v in (0, 0, FRAMES, 2, 0))]
    parts += [_text("pakt"), octets(2 * n + 24, 8), table_, _text("data"), octets(F.col("total") + 4, 8), F.repeat(F.lit("\0"), (F.col("total") + 4).cast("int")).cast("binary")]
    return files.select(F.col("track_id").cast("string").alias("path"), F.concat(*parts).alias("content"))


@query(f"""WITH {INDEX}, p AS (SELECT track_id, sample_id, size * 37 % 3000 + 1 AS size, count(*) OVER (PARTITION BY track_id) AS n FROM idx)
SELECT track_id, sample_id, CAST(104 + 2 * n + sum(size) OVER (PARTITION BY track_id ORDER BY sample_id) - size AS BIGINT) AS "offset", size, (sample_id - 1) * {FRAMES} AS decode_time,
 CASE WHEN sample_id = 1 THEN track_id % 600 ELSE 0 END AS trim_start, CASE WHEN sample_id = n THEN {FRAMES} - track_id % 400 ELSE {FRAMES} END AS trim_end FROM p""")
def caf_packet_index(spark, sf):
    """Where the packets of files of packets lie, when they are, and the frames of each that are heard."""
    got = caf.packets_in(_caf_files(spark, sf))
    return got.select(F.col("path").cast("long").alias("track_id"), "sample_id", "offset", "size", "decode_time", "trim_start", "trim_end")


@query("""WITH t AS (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer)
SELECT k AS file_id, 0 AS seq, 'title' AS tag, c_name AS value FROM t WHERE k % 3 < 2
UNION ALL SELECT k, 1, 'genre', c_mktsegment FROM t WHERE k % 3 < 2
UNION ALL SELECT k, 0, 'title', left(upper(c_name), 30) FROM t WHERE k % 3 = 2
UNION ALL SELECT k, CASE WHEN k % 3 = 1 THEN 2 ELSE 1 END, 'comment', left(c_mktsegment, 28) FROM t WHERE k % 3 > 0
UNION ALL SELECT k, CASE WHEN k % 3 = 1 THEN 3 ELSE 2 END, 'track', CAST(k % 200 + 1 AS VARCHAR) FROM t WHERE k % 3 > 0""")
def trailing_tags(spark, sf):
    """Tags at the ends of files: APEv2 alone, ID3v1 after it, which fills its gaps, or ID3v1 alone."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    little = lambda v: octets(v, 4, little=True)
    item = lambda name, value: F.concat(little(F.octet_length(value)), little(F.lit(0)), _text(name), octets(F.lit(0), 1), value)
    items = F.concat(item("Title", F.encode("c_name", "UTF-8")), item("Genre", F.encode("c_mktsegment", "UTF-8")))
    ape = F.concat(items, _text("APETAGEX"), little(F.lit(2000)), little(F.octet_length(items) + 32), little(F.lit(2)), *[little(F.lit(0))] * 3)
    field = lambda value, size: F.concat(F.encode(F.left(value, F.lit(size)), "UTF-8"), F.unhex(F.repeat(F.lit("00"), size - F.length(F.left(value, F.lit(size))))))
    v1 = F.concat(_text("TAG"), field(F.upper("c_name"), 30), F.unhex(F.lit("00" * 64)), field(F.col("c_mktsegment"), 28), octets(F.lit(0), 1), octets(k % 200 + 1, 1), octets(F.lit(255), 1))
    content = F.concat(_text("samples"), F.when(k % 3 < 2, ape).otherwise(_text("")), F.when(k % 3 > 0, v1).otherwise(_text("")))
    got = tagged.tags_in(c.select(k.cast("string").alias("path"), content.alias("content")))
    return got.select(F.col("path").cast("long").alias("file_id"), F.col("seq").cast("int").alias("seq"), "tag", "value")


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, CAST(pos % 2 AS INTEGER) AS channel, CAST(pos // 2 AS BIGINT) AS frame, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM v""")
def aiff_sample_scan(spark, sf):
    """Vectors as AIFF-C files of two channels of big-endian floats, read back sample by sample."""
    from framewright.functions import wire

    e = table(spark, sf, "embeddings").select("vec_id", wire.block(F.col("embedding"), "f32be").alias("body"), (F.size("embedding") / 2).cast("long").alias("frames"))
    size = F.octet_length("body")
    common = F.concat(octets(F.lit(2), 2), octets(F.col("frames"), 4), octets(F.lit(32), 2), F.unhex(F.lit("400BFA00000000000000")), _text("fl32"), octets(F.lit(0), 2))
    parts = F.concat(_text("AIFC"), _text("COMM"), octets(F.lit(24), 4), common, _text("SSND"), octets(size + 8, 4), octets(F.lit(0), 8), F.col("body"))
    files = e.select(F.col("vec_id").cast("string").alias("path"), F.concat(_text("FORM"), octets(size + 56, 4), parts).alias("content"))
    return aiff.samples_in(files).select(F.col("path").cast("long").alias("vec_id"), "channel", "frame", "x")


@query("""WITH s AS (SELECT event_id, event_id % 2 + 1 AS channels, 8 * (event_id % 4 + 1) AS bits, CASE WHEN event_id % 3 = 0 THEN event_id * 4000000 ELSE event_id END AS frames FROM events)
SELECT event_id, CAST(channels AS INTEGER) AS channels, CAST(bits AS INTEGER) AS bits, 44100 AS rate, CASE WHEN frames * channels * (bits // 8) + frames * channels * (bits // 8) % 2 + 36 >= 4294967295 THEN 80 ELSE 44 END AS data_offset, least(16, frames * channels * (bits // 8)) // (channels * (bits // 8)) AS frames FROM s""")
def wav_header_round_trip(spark, sf):
    """Headers of files of any length, RF64 where 32 bits do not hold their sizes, read back over sixteen bytes of samples."""

    @F.pandas_udf("binary")
    def made(channels: pd.Series, bits: pd.Series, frames: pd.Series) -> pd.Series:
        return pd.Series([wav.header_bytes("int", c, 44100, b, n) + bytes(16) for c, b, n in zip(channels.tolist(), bits.tolist(), frames.tolist(), strict=True)], dtype=object)

    k = F.col("event_id")
    s = table(spark, sf, "events").select(k.cast("string").alias("path"), made(k % 2 + 1, 8 * (k % 4 + 1), F.when(k % 3 == 0, k * 4000000).otherwise(k)).alias("content"))
    return wav.headers_in(s).select(F.col("path").cast("long").alias("event_id"), "channels", "bits", "rate", "data_offset", "frames")


def _box(kind: str, size, *parts):
    """A box whose parts are of `size` octets."""
    return F.concat(octets(size + 8, 4), _text(kind), *parts)


def _numbers(*values):
    return F.concat(*(octets(F.lit(v) if isinstance(v, int) else v, 4) for v in values))


def _media() -> bytes:
    """An audio track's media of 44,100 a second, without samples."""
    made = lambda kind, *parts: (8 + sum(map(len, parts))).to_bytes(4, "big") + kind + b"".join(parts)
    time = b"".join(v.to_bytes(4, "big") for v in (0, 0, 0, 44100, 0, 0))
    return made(b"mdia", made(b"mdhd", time), made(b"hdlr", bytes(8), b"soun", bytes(12)), made(b"minf", made(b"stbl", made(b"stsd", bytes(8)))))


@query(f"""WITH {EDITS}, scaled AS (SELECT track_id, entry_no, (duration * 44100 + 300) // 600 AS duration, media_time FROM edits0),
starts AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY track_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM scaled)
SELECT track_id, entry_no, CAST(duration AS BIGINT) AS duration, media_time, CAST(start AS BIGINT) AS presentation_start FROM starts WHERE media_time <> -1""")
def mp4_edit_lists(spark, sf):
    """Edit lists of files with a track for each customer, as the times of their parts in the track and when they are shown."""
    # A negative number is written by its two's complement.
    entry = _numbers(F.col("duration"), F.pmod(F.col("media_time").cast("long"), F.lit(1 << 32)), 1 << 16)
    listed = edits(spark, sf).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("entry_no", F.hex(entry).alias("bytes")))).alias("listed"))
    n, media = F.size("listed"), _media()
    own = 12 * n + 8
    edts = _box("edts", own + 8, _box("elst", own, _numbers(0), octets(n, 4), F.unhex(F.array_join("listed.bytes", ""))))
    size = own + 16 + len(media) + 32
    track = _box("trak", size, _box("tkhd", F.lit(24), _numbers(0, 0, 0, F.col("track_id"), 0, 0)), F.unhex(F.lit(media.hex())), edts)
    content = F.concat(_box("ftyp", F.lit(4), _text("isom")), _box("moov", size + 8 + 28, _box("mvhd", F.lit(20), _numbers(0, 0, 0, 600, 0)), track))
    got = mp4.edits_in(listed.select(F.col("track_id").cast("string").alias("path"), content.alias("content"))).where("error is null")
    return edit_starts(got, "track_id", "entry_no").select("track_id", "entry_no", "duration", "media_time", "presentation_start")
