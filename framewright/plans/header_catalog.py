"""Queries of header fields, names and sniffers: headers made of the events' numbers are taken apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import octets, text
from framewright.functions.octets import octets as to_octets
from framewright.plans.adapt import table
from framewright.plans.registry import query

#: Scrambled numbers of 24 bits.
_H = "h AS (SELECT event_id, user_id, value, event_type, (event_id * 2654435761) % 16777216 AS h FROM events)"


def _events(spark, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("h", F.col("event_id") * F.lit(2654435761).cast("long") % 16777216)


@query(f"WITH {_H} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE h * 13 END AS size FROM h")
def synchsafe_integer(spark, sf):
    """Seven bits an octet; where one has its eighth bit set, there is no number."""
    v = F.col("h") * 13
    each = [F.shiftright(v, 7 * (3 - i)).bitwiseAND(F.lit(127)) for i in range(4)]
    each[2] = F.when(F.col("event_id") % 10 == 0, each[2] + 128).otherwise(each[2])
    e = _events(spark, sf).select("event_id", F.concat(*(to_octets(b, 1) for b in each)).alias("data"))
    return e.select("event_id", octets.synchsafe(F.col("data")).alias("size"))


@query(f"""WITH {_H} SELECT event_id, CASE event_id % 5 WHEN 0 THEN h % 128 WHEN 1 THEN h % 256 WHEN 2 THEN h WHEN 3 THEN NULL ELSE NULL END AS size, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 END AS octets FROM h""")
def ber_length(spark, sf):
    """Short and long forms, one that is cut off, and the indefinite one."""
    k, h = F.col("event_id") % 5, F.col("h")
    data = F.when(k == 0, to_octets(h % 128, 1)).when(k == 1, F.concat(to_octets(F.lit(0x81), 1), to_octets(h, 1))).when(k == 2, F.concat(to_octets(F.lit(0x84), 1), to_octets(h, 4))).when(k == 3, F.concat(to_octets(F.lit(0x84), 1), to_octets(h, 3))).otherwise(to_octets(F.lit(0x80), 1))
    value, size = octets.ber_length(F.col("data"))
    return _events(spark, sf).select("event_id", data.alias("data")).select("event_id", value.alias("size"), size.alias("octets"))


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 1234567891) % 8589934592 END AS stamp FROM events")
def pes_timestamp(spark, sf):
    """33 bits among marker bits; where a marker is missing, there is no stamp."""
    e = table(spark, sf, "events").select("event_id", octets.pes_stamp_bytes(F.col("event_id") * F.lit(1234567891).cast("long") % F.lit(1 << 33)).alias("data"))
    e = e.withColumn("data", F.when(F.col("event_id") % 13 == 0, F.concat(F.substring("data", 1, 4), to_octets(F.lit(0), 1))).otherwise(F.col("data")))
    return e.select("event_id", octets.pes_stamp(F.col("data")).alias("stamp"))


_MPEG = f"""WITH {_H}, b AS (SELECT event_id, 224 + h % 32 AS b1, (h // 32) % 256 AS b2, (h // 8192) % 256 AS b3 FROM h), f AS (SELECT *, (b1 >> 3) & 3 AS ver, 4 - ((b1 >> 1) & 3) AS layer, b2 >> 4 AS bi, (b2 >> 2) & 3 AS ri, (b2 >> 1) & 1 AS pad FROM b),
g AS (SELECT *, ver <> 1 AND layer < 4 AND bi BETWEEN 1 AND 14 AND ri < 3 AS good, CASE WHEN ver = 3 THEN 1 WHEN ver = 2 THEN 2 ELSE 4 END AS part FROM f),
r AS (SELECT *, ([44100, 48000, 32000])[ri + 1] // part AS rate, 1000 * (CASE WHEN ver = 3 AND layer = 1 THEN [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448] WHEN ver = 3 AND layer = 2 THEN [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
 WHEN ver = 3 THEN [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320] WHEN layer = 1 THEN [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256] ELSE [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160] END)[bi] AS rates FROM g)"""


@query(_MPEG + """ SELECT event_id, CASE WHEN good THEN CASE WHEN layer = 1 THEN (12 * rates // rate + pad) * 4 WHEN layer = 3 AND ver <> 3 THEN 72 * rates // rate + pad ELSE 144 * rates // rate + pad END END AS frame_length, CASE WHEN good THEN rate END AS sample_rate,
 CASE WHEN good THEN CASE WHEN b3 >> 6 = 3 THEN 1 ELSE 2 END END AS channels, CASE WHEN good THEN CASE WHEN layer = 1 THEN 384 WHEN layer = 3 AND ver <> 3 THEN 576 ELSE 1152 END END AS samples, CASE WHEN good THEN layer END AS layer FROM r""")
def mpeg_audio_header(spark, sf):
    h = F.col("h")
    data = F.concat(F.unhex(F.lit("FF")), to_octets(F.floor(h % 32) + 224, 1), to_octets(F.floor(h / 32), 1), to_octets(F.floor(h / 8192), 1))
    e = _events(spark, sf).select("event_id", data.alias("data"))
    return e.select("event_id", *(v.alias(k) for k, v in octets.mpeg_audio_header(F.col("data")).items()))


@query(f"""WITH {_H} SELECT event_id, h % 8000 + 7 AS frame_length, ([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350])[event_id % 13 + 1] AS sample_rate, event_id % 8 AS channels, 1024 AS samples FROM h""")
def adts_header_roundtrip(spark, sf):
    """Headers made for raw frames, taken apart again."""
    made = octets.adts_header_bytes(F.col("event_id") % 13, F.col("event_id") % 8, F.col("h") % 8000)
    return _events(spark, sf).select("event_id", made.alias("data")).select("event_id", *(v.alias(k) for k, v in octets.adts_header(F.col("data")).items()))


@query(f"""WITH {_H}, t AS (SELECT event_id, h % 256 AS toc, (h // 256) % 64 AS n FROM h), f AS (SELECT *, CASE WHEN toc // 8 < 12 THEN ([10000, 20000, 40000, 60000])[(toc // 8) % 4 + 1] WHEN toc // 8 < 16 THEN ([10000, 20000])[(toc // 8) % 2 + 1] ELSE ([2500, 5000, 10000, 20000])[(toc // 8) % 4 + 1] END AS us,
 CASE WHEN toc % 4 = 0 THEN 1 WHEN toc % 4 < 3 THEN 2 ELSE n END AS frames FROM t) SELECT event_id, CASE WHEN frames > 0 AND us * frames <= 120000 THEN CAST(us * frames * 1000 AS BIGINT) END AS ns FROM f""")
def opus_packet_duration(spark, sf):
    data = F.concat(to_octets(F.col("h") % 256, 1), to_octets(F.floor(F.col("h") / 256) % 64, 1))
    return _events(spark, sf).select("event_id", data.alias("data")).select("event_id", octets.opus_duration_ns(F.col("data")).alias("ns"))


@query(f"WITH {_H} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE h % 65536 END AS pre_skip, CASE WHEN event_id % 7 = 0 THEN NULL ELSE h % 2000 - 1000 END AS gain, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 END AS mapping FROM h")
def opus_head(spark, sf):
    """Pre-skip, signed gain and channel mapping; nothing of a head that is cut off."""
    h = F.col("h")
    data = F.concat(F.encode(F.lit("OpusHead"), "UTF-8"), to_octets(F.lit(0x0102), 2), to_octets(h % 65536, 2, True), to_octets(F.lit(48000), 4, True), to_octets(h % 2000 - 1000, 2, True), to_octets(F.col("event_id") % 3, 1))
    data = F.when(F.col("event_id") % 7 == 0, F.substring(data, 1, 18)).otherwise(data)
    return _events(spark, sf).select("event_id", data.alias("data")).select("event_id", *(v.alias(k) for k, v in octets.opus_head(F.col("data")).items()))


@query(f"WITH {_H} SELECT event_id, CASE h // 2097152 WHEN 0 THEN 'pcm-signed' WHEN 1 THEN 'pcm-float' WHEN 2 THEN 'opus' WHEN 3 THEN 'flac' WHEN 4 THEN 'aac' END AS flag, ([13, 14, 16, 18, 20, 21, 27, 32, 6, 1, 1, 1, 1, 1, 1, 1])[(h // 524288) % 16 + 1] AS amr_bytes FROM h")
def packet_flags(spark, sf):
    """Encoding by the highest three bits of a header, and bytes of an AMR frame by its type."""
    data = to_octets(F.col("h") * 256, 4)
    return _events(spark, sf).select("event_id", data.alias("data")).select("event_id", octets.encoding_flag(F.col("data")).alias("flag"), octets.amr_frame_bytes(F.col("data")).alias("amr_bytes"))


@query(f"""WITH {_H}, d AS (SELECT event_id, event_id % 4 AS k, h FROM h) SELECT event_id, k = 1 OR k = 3 AS tagged, k = 2 AS registered, k = 1 OR k = 2 OR k = 3 AS ac3 FROM d""")
def descriptor_exists(spark, sf):
    """Descriptors in a row: one tag among them, a registration, both cut off by a length that is too great."""
    k = F.col("event_id") % 4
    own = F.when(k == 0, "0A04656E6700").when(k == 1, "0A04656E67006A0101").when(k == 2, "0A04656E6700050441432D33").otherwise("6A00050941432D33")
    d = table(spark, sf, "events").select("event_id", F.unhex(own).alias("data"))
    tagged, registered = octets.has_descriptor(F.col("data"), 0x6A), octets.has_registration(F.col("data"), "AC-3")
    return d.select("event_id", tagged.alias("tagged"), registered.alias("registered"), (tagged | registered).alias("ac3"))


_ALIASES = "['H264', ' avc1', 'hvc1', 'VP09 ', 'v_av1', 'apch', 'AVdn', 'mpeg2', 'h.264']"
_MKV = "['A_OPUS', 'A_VORBIS', 'A_AAC', 'A_AAC/MPEG4/LC', 'A_MPEG/L3', 'A_AC3', 'A_DTS']"


@query(f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'h264' WHEN 1 THEN 'h264' WHEN 2 THEN 'hevc' WHEN 3 THEN 'vp9' WHEN 4 THEN 'av1' WHEN 5 THEN 'prores' WHEN 6 THEN 'dnxhd' END AS codec,
 CASE event_id % 7 WHEN 0 THEN 'opus' WHEN 1 THEN 'vorbis' WHEN 2 THEN 'aac' WHEN 3 THEN 'aac' WHEN 4 THEN 'mp3' WHEN 5 THEN 'ac3' ELSE 'a_dts' END AS matroska, 'mpeg-ts-' || event_id AS format FROM events""")
def codec_names(spark, sf):
    """Aliases of codecs, ids of Matroska and names of formats, in any case and with white space around them."""
    at = lambda values, n: F.get(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % n).cast("int"))
    alias = at(["H264", " avc1", "hvc1", "VP09 ", "v_av1", "apch", "AVdn", "mpeg2", "h.264"], 9)
    mkv = at(["A_OPUS", "A_VORBIS", "A_AAC", "A_AAC/MPEG4/LC", "A_MPEG/L3", "A_AC3", "A_DTS"], 7)
    name = F.concat(F.lit("  MPEG_ts-"), F.col("event_id").cast("string"), F.lit(" "))
    return table(spark, sf, "events").select("event_id", text.codec_name(alias).alias("codec"), text.matroska_codec(mkv).alias("matroska"), text.format_name(name).alias("format"))


@query("""SELECT event_id, CASE event_id % 15 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'ALBUM' WHEN 2 THEN 'ARTIST' WHEN 3 THEN 'ALBUMARTIST' WHEN 4 THEN 'COMPOSER' WHEN 5 THEN 'GENRE' WHEN 6 THEN 'GENRE' WHEN 7 THEN 'DATE' WHEN 8 THEN 'COMMENT' WHEN 9 THEN 'LYRICS' WHEN 10 THEN 'ENCODER' WHEN 11 THEN 'COPYRIGHT' WHEN 12 THEN 'TRACK' WHEN 13 THEN 'DISC' END AS tag,
 CASE event_id % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/bmp' WHEN 5 THEN 'image/webp' END AS image FROM events""")
def tag_and_image_kinds(spark, sf):
    """Tags of MP4 by four letters, and images by their first bytes, with one of neither."""
    tags, images = [*text.MP4_TAGS, "66726565"], [*(m for _, m in text.IMAGES), "52494646000000005745425056503820", "5249464600000000"]
    at = lambda values: F.unhex(F.get(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int")))
    return table(spark, sf, "events").select("event_id", text.mp4_tag(at(tags)).alias("tag"), text.image_type(F.concat(at(images), F.unhex(F.lit("0000")))).alias("image"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 188 WHEN 1 THEN 192 WHEN 2 THEN 204 END AS stride FROM events""")
def transport_stride(spark, sf):
    """Packets of 188, 192 and 204 bytes; one stream is too short, of one a sync byte is wrong."""
    def stream(first: int, stride: int, n: int) -> str:
        return (b"".join(bytes(first) + b"\x47" + bytes(stride - first - 1) for _ in range(n))).hex()

    kinds = [stream(0, 188, 5), stream(4, 192, 5), stream(0, 204, 6), stream(0, 188, 4), stream(0, 188, 3) + "00" + stream(0, 188, 3)[2:]]
    e = table(spark, sf, "events").select("event_id", F.unhex(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5).cast("int"))).alias("data"))
    return e.select("event_id", text.transport_stride(F.col("data")).alias("stride"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/song.FLAC' WHEN 1 THEN url || '/Song.wav' WHEN 2 THEN url || '/song' ELSE url || '/song.flac.txt' END AS path FROM pages)
SELECT page_id, page_id % 4 < 2 AS audio, contains(lower(path), 'song') AND contains(lower(path), 'http') AND contains(lower(path), 'flac') AS matches FROM p""")
def path_predicates(spark, sf):
    k = F.col("page_id") % 4
    path = F.concat("url", F.when(k == 0, "/song.FLAC").when(k == 1, "/Song.wav").when(k == 2, "/song").otherwise("/song.flac.txt"))
    terms = F.array(F.lit("song"), F.lit("http"), F.lit("flac"))
    return table(spark, sf, "pages").select("page_id", path.alias("path")).select("page_id", text.is_audio_path(F.col("path")).alias("audio"), text.path_matches(F.col("path"), terms).alias("matches"))
