"""Tag keys, number pairs and magic bytes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How files of each kind begin, or what they hold at an offset.
MAGIC = [("ebml", 0, "1A45DFA3"), ("ac3", 0, "0B77"), ("mpeg-ps", 0, "000001BA"), ("riff", 0, "52494646"), ("ogg", 0, "4F676753"), ("flac", 0, "664C6143"), ("mp4", 4, "66747970"), ("id3", 0, "494433"), ("png", 0, "89504E47"), ("jpeg", 0, "FFD8FF"), ("gif", 0, "47494638"), ("html", 0, "3C21")]


def normalized_key(key: Column) -> Column:
    """ASCII letters and digits of a key, in lower case."""
    return F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", ""))


def number_pair(value: Column) -> tuple[Column, Column]:
    """Both sides of `n/total`; null where one is missing, no number, or beyond 32 bits."""
    parts = F.split(value, "/", 2)
    sides = (F.trim(F.get(parts, F.lit(i))) for i in range(2))
    numbers = [F.when(s.rlike(r"^\+?[0-9]{1,18}$"), F.regexp_replace(s, r"^\+", "").try_cast("long")) for s in sides]
    first, second = (F.when(n <= 4294967295, n) for n in numbers)
    return first, second


def sniffed(data: Column) -> Column:
    """Kind of a file by its first bytes, null if none is known."""
    out = F.lit(None).cast("string")
    for kind, at, magic in reversed(MAGIC):
        out = F.when(F.hex(F.substring(data, at + 1, len(magic) // 2)) == magic, kind).otherwise(out)
    return out


#: Names under which codecs go, and what they name.
CODEC_ALIASES = {"h264": ["h264", "avc", "avc1", "avc3"], "hevc": ["hevc", "h265", "hev1", "hvc1"], "vp9": ["vp9", "vp09", "v_vp9"], "av1": ["av1", "av01", "v_av1"], "prores": ["prores", "apco", "apcs", "apcn", "apch", "ap4h", "ap4x"], "dnxhd": ["dnxhd", "dnxhr", "avdn"]}
#: Codec ids of Matroska and what they name.
MATROSKA_CODECS = {"A_OPUS": "opus", "A_VORBIS": "vorbis", "A_AAC": "aac", "A_AAC/MPEG2/LC": "aac", "A_AAC/MPEG4/LC": "aac", "A_MPEG/L3": "mp3", "A_AC3": "ac3"}
#: Tags of MP4 by their four letters, in hexadecimal digits.
MP4_TAGS = {"A96E616D": "TITLE", "A9616C62": "ALBUM", "A9415254": "ARTIST", "61415254": "ALBUMARTIST", "A9777274": "COMPOSER", "A967656E": "GENRE", "676E7265": "GENRE", "A9646179": "DATE", "A9636D74": "COMMENT", "A96C7972": "LYRICS", "A9746F6F": "ENCODER", "A9637079": "COPYRIGHT", "74726B6E": "TRACK", "6469736B": "DISC"}
#: How images of each kind begin.
IMAGES = [("image/jpeg", "FFD8FF"), ("image/png", "89504E470D0A1A0A"), ("image/gif", "474946383761"), ("image/gif", "474946383961"), ("image/bmp", "424D")]
#: Extensions of files of sound.
AUDIO_EXTENSIONS = ["aac", "ac3", "aif", "aiff", "alac", "amr", "flac", "gsm", "m4a", "m4v", "mp3", "ogg", "oga", "opus", "opusfile", "raw", "wav", "webm", "wma"]
#: Offset of the first sync byte and stride of transport packets.
TS_LAYOUTS = [(0, 188), (4, 192), (0, 204)]


def format_name(value: Column) -> Column:
    """A format's name without white space around it, in lower case, with hyphens."""
    return F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))


def codec_name(value: Column) -> Column:
    """The codec that an alias names, null for none."""
    known = F.create_map(*(F.lit(x) for name, own in CODEC_ALIASES.items() for alias in own for x in (alias, name)))
    return F.try_element_at(known, F.lower(F.trim(value)))


def matroska_codec(codec_id: Column) -> Column:
    """The codec of a Matroska id; an unknown one in lower case."""
    known = F.create_map(*(F.lit(x) for pair in MATROSKA_CODECS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, codec_id), F.lower(codec_id))


def mp4_tag(kind: Column) -> Column:
    """The tag that four octets name, null for none."""
    known = F.create_map(*(F.lit(x) for pair in MP4_TAGS.items() for x in pair))
    return F.try_element_at(known, F.hex(kind))


def image_type(data: Column) -> Column:
    """MIME type of an image by its first bytes, null for none."""
    digits = F.hex(F.substring(data, 1, 12))
    out = F.when(digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250"), "image/webp")
    for kind, magic in reversed(IMAGES):
        out = F.when(digits.startswith(magic), kind).otherwise(out)
    return out


def is_audio_path(path: Column) -> Column:
    """Whether a path ends in an extension of sound, in any case."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(AUDIO_EXTENSIONS)


def path_matches(path: Column, terms: Column) -> Column:
    """Whether a path holds all terms, which are in lower case."""
    return F.forall(terms, lambda t: F.contains(F.lower(path), t))


def transport_stride(data: Column, packets: int = 5) -> Column:
    """Bytes from one transport packet to the next, by the sync bytes of the first ones; null where none fits."""
    out = F.lit(None).cast("int")
    for first, stride in reversed(TS_LAYOUTS):
        synced = F.octet_length(data) >= stride * packets
        for i in range(packets):
            synced = synced & (F.hex(F.substring(data, first + i * stride + 1, 1)) == "47")
        out = F.when(synced, stride).otherwise(out)
    return out
