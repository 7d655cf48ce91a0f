"""Fields of binary headers as Column expressions: octets, numbers of several octets, and the headers made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilobits a second by index, from 1, for MPEG 1 layers 1 to 3, MPEG 2 layer 1, and MPEG 2 layers 2 and 3.
BITRATES = [
    [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
]
#: Sample rates of MPEG 1 audio, and of ADTS, by index.
MPEG_RATES = [44100, 48000, 32000]
ADTS_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
#: Microseconds of an Opus frame by configuration, in groups of silk, hybrid and celt.
SILK_US, HYBRID_US, CELT_US = [10000, 20000, 40000, 60000], [10000, 20000], [2500, 5000, 10000, 20000]
#: Bytes of an AMR narrow-band frame by type, header included.
AMR_BYTES = [13, 14, 16, 18, 20, 21, 27, 32, 6, 1, 1, 1, 1, 1, 1, 1]
#: What a descriptor that registers a format begins with.
REGISTRATION = 5


def octet(data: Column, at: Column | int) -> Column:
    """The octet at an offset, null beyond the end."""
    return number(data, at, 1)


def number(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned number of up to seven octets at an offset, null where it is cut off."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.when(F.octet_length(part) == size, F.conv(digits, 16, 10).cast("long"))


def octets(value: Column, size: int, little: bool = False) -> Column:
    """The low octets of a number, negative ones by two's complement."""
    each = [F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]
    return F.unhex(F.concat(*(each if little else reversed(each))))


def _get(values: list[int], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def synchsafe(data: Column) -> Column:
    """Seven bits of each of four octets; null where one has its eighth bit set."""
    each = [octet(data, i) for i in range(4)]
    value = sum((F.shiftleft(b, 7 * (3 - i)) for i, b in enumerate(each)), F.lit(0).cast("long"))
    high = each[0].bitwiseOR(each[1]).bitwiseOR(each[2]).bitwiseOR(each[3])
    return F.when((F.octet_length(data) == 4) & (high < 128), value)


def ber_length(data: Column) -> tuple[Column, Column]:
    """Value and octets of a length in basic encoding rules, seven octets at most; null where it is indefinite or cut off."""
    first = octet(data, 0)
    count = first - 128
    value = F.when(first < 128, first)
    for n in range(1, 8):
        value = F.when(count == n, number(data, 1, n)).otherwise(value)
    return value, F.when(value.isNotNull(), F.when(first < 128, 1).otherwise(count + 1).cast("int"))


def pes_stamp(data: Column) -> Column:
    """A time stamp of 33 bits in five octets; null where a marker bit is missing."""
    b = [octet(data, i) for i in range(5)]
    marked = b[0].bitwiseAND(b[2]).bitwiseAND(b[4]).bitwiseAND(F.lit(1)) == 1
    value = F.shiftleft(F.shiftright(b[0], 1).bitwiseAND(F.lit(7)), 30) + F.shiftleft(b[1], 22) + F.shiftleft(F.shiftright(b[2], 1), 15) + F.shiftleft(b[3], 7) + F.shiftright(b[4], 1)
    return F.when(marked, value)


def pes_stamp_bytes(value: Column, mark: int = 2) -> Column:
    """Five octets of a time stamp, with the nibble that says which it is."""
    part = lambda shift, bits: F.shiftright(value, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return F.concat(octets(F.lit(mark << 4 | 1) + part(30, 3) * 2, 1), octets(part(15, 15) * 2 + 1, 2), octets(part(0, 15) * 2 + 1, 2))


def mpeg_audio_header(data: Column) -> dict[str, Column]:
    """frame_length, sample_rate, channels, samples and layer of an MPEG audio frame; all null where there is none."""
    b = [octet(data, i) for i in range(4)]
    version, layer = F.shiftright(b[1], 3).bitwiseAND(F.lit(3)), 4 - F.shiftright(b[1], 1).bitwiseAND(F.lit(3))
    rate_no, bits_no = F.shiftright(b[2], 2).bitwiseAND(F.lit(3)), F.shiftright(b[2], 4)
    good = (b[0] == 255) & (b[1] >= 224) & (version != 1) & (layer < 4) & (bits_no > 0) & (bits_no < 15) & (rate_no < 3) & b[3].isNotNull()
    row = F.when(version == 3, layer - 1).when(layer == 1, 3).otherwise(4)
    bitrate = F.get(F.get(F.array(*(F.array(*map(F.lit, r)) for r in BITRATES)), row.cast("int")), (bits_no - 1).cast("int")).cast("long") * 1000
    rate = F.floor(_get(MPEG_RATES, rate_no) / F.when(version == 3, 1).when(version == 2, 2).otherwise(4)).cast("long")
    padding = F.shiftright(b[2], 1).bitwiseAND(F.lit(1))
    per = lambda factor: F.floor(factor * bitrate / rate)
    length = F.when(layer == 1, (per(12) + padding) * 4).when((layer == 3) & (version != 3), per(72) + padding).otherwise(per(144) + padding)
    samples = F.when(layer == 1, 384).when((layer == 3) & (version != 3), 576).otherwise(1152)
    channels = F.when(F.shiftright(b[3], 6) == 3, 1).otherwise(2)
    return {k: F.when(good, v.cast("long")) for k, v in {"frame_length": length, "sample_rate": rate, "channels": channels, "samples": samples, "layer": layer}.items()}


def adts_header(data: Column) -> dict[str, Column]:
    """frame_length, sample_rate, channels and samples of an ADTS frame; all null where there is none."""
    b = [octet(data, i) for i in range(7)]
    rate = _get(ADTS_RATES, F.shiftright(b[2], 2).bitwiseAND(F.lit(15))).cast("long")
    channels = F.shiftleft(b[2].bitwiseAND(F.lit(1)), 2) + F.shiftright(b[3], 6)
    length = F.shiftleft(b[3].bitwiseAND(F.lit(3)), 11) + F.shiftleft(b[4], 3) + F.shiftright(b[5], 5)
    good = (b[0] == 255) & (b[1].bitwiseAND(F.lit(0xF6)) == 0xF0) & rate.isNotNull() & (length >= 7)
    samples = (b[6].bitwiseAND(F.lit(3)) + 1) * 1024
    return {k: F.when(good, v.cast("long")) for k, v in {"frame_length": length, "sample_rate": rate, "channels": channels, "samples": samples}.items()}


def adts_header_bytes(rate_index: Column, channels: Column, size: Column, profile: int = 1) -> Column:
    """The seven octets before a raw frame of `size` octets, without a checksum."""
    length = size + 7
    third = F.lit(profile << 6) + rate_index * 4 + F.shiftright(channels, 2)
    fourth = channels.bitwiseAND(F.lit(3)) * 64 + F.shiftright(length, 11).bitwiseAND(F.lit(3))
    return F.concat(F.unhex(F.lit("FFF1")), octets(third, 1), octets(fourth, 1), octets(F.shiftright(length, 3), 1), octets(length.bitwiseAND(F.lit(7)) * 32 + 31, 1), F.unhex(F.lit("FC")))


def opus_duration_ns(packet: Column) -> Column:
    """Nanoseconds of an Opus packet by its first octets; null where it is empty or longer than 120 milliseconds."""
    toc = octet(packet, 0)
    config, code = F.shiftright(toc, 3), toc.bitwiseAND(F.lit(3))
    frame = F.when(config < 12, _get(SILK_US, config.bitwiseAND(F.lit(3)))).when(config < 16, _get(HYBRID_US, config.bitwiseAND(F.lit(1)))).otherwise(_get(CELT_US, config.bitwiseAND(F.lit(3))))
    frames = F.when(code == 0, 1).when(code < 3, 2).otherwise(octet(packet, 1).bitwiseAND(F.lit(63)))
    total = frame.cast("long") * frames
    return F.when((frames > 0) & (total <= 120000), total * 1000)


def opus_head(data: Column) -> dict[str, Column]:
    """pre_skip, gain and mapping of an OpusHead; null where it is none or cut off."""
    good = (F.octet_length(data) >= 19) & (F.hex(F.substring(data, 1, 8)) == "4F70757348656164")
    gain = number(data, 16, 2, True)
    return {k: F.when(good, v.cast("int")) for k, v in {"pre_skip": number(data, 10, 2, True), "gain": F.when(gain >= 32768, gain - 65536).otherwise(gain), "mapping": octet(data, 18)}.items()}


def encoding_flag(header: Column) -> Column:
    """What the three highest bits of a header's first four octets name; null for none of them."""
    return F.get(F.array(*map(F.lit, ["pcm-signed", "pcm-float", "opus", "flac", "aac"])), F.shiftright(octet(header, 0), 5).cast("int"))


def amr_frame_bytes(header: Column) -> Column:
    """Octets of an AMR narrow-band frame by its first one."""
    return _get(AMR_BYTES, F.shiftright(octet(header, 0), 3).bitwiseAND(F.lit(15)))


def descriptors(data: Column, most: int = 32) -> Column:
    """Descriptors in a row as structs of tag and body; what follows one that is cut off is left out, as is what follows `most`."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<tag: bigint, body: binary>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        tag, size = octet(data, s["at"]), octet(data, s["at"] + 1)
        whole = F.coalesce(s["at"] + 2 + size <= F.octet_length(data), F.lit(False))
        more = F.concat(s["out"], F.array(F.struct(tag.alias("tag"), F.substring(data, s["at"] + 3, size.cast("int")).alias("body"))))
        return F.when(whole, F.struct((s["at"] + 2 + size).cast("int").alias("at"), more.alias("out"))).otherwise(F.struct(F.lit(1 << 30).alias("at"), s["out"].alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda s: s["out"])


def has_descriptor(data: Column, tag: int) -> Column:
    return F.exists(descriptors(data), lambda d: d["tag"] == tag)


def has_registration(data: Column, name: str) -> Column:
    """Whether a registration descriptor names a format of four letters."""
    return F.exists(descriptors(data), lambda d: (d["tag"] == REGISTRATION) & (F.hex(F.substring(d["body"], 1, 4)) == name.encode().hex().upper()))
