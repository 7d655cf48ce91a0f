"""Sources of headerless samples, CAF, AIFF samples, RF64 headers and tags at the end, against files put together here."""

import struct

import numpy as np
import pytest

from framewright.functions import pcm, wire
from framewright.sources import aiff, caf, raw, tagged, wav


def block(values, encoding):
    return values.astype(raw.FILES[encoding]).tobytes() if encoding in raw.FILES else wire.packed(values, encoding)


def test_g711_tables(spark):
    codes = spark.range(256).selectExpr("cast(id as int) code")
    got = codes.select("code", pcm.ulaw_decoded(codes.code).alias("u"), pcm.alaw_decoded(codes.code).alias("a")).orderBy("code").toPandas()
    assert raw.ulaw_table().tolist() == got["u"].tolist() and raw.alaw_table().tolist() == got["a"].tolist()


@pytest.mark.parametrize("encoding", ["u8", "s8", "s16le", "s16be", "s24le", "s24be", "s32le", "f32le", "f64be"])
def test_headerless_samples(spark, tmp_path, encoding):
    size = raw.SIZES[encoding]
    x = np.array([0, 64, -64, 127, -128, 1])
    top = x / 128 if encoding[0] == "f" else x + 128 if encoding == "u8" else x * (1 << 8 * size - 8)
    (tmp_path / "a.raw").write_bytes(block(top, encoding) + b"\1" * (2 * size - 1))
    (tmp_path / "empty.raw").write_bytes(b"")
    rows = raw.read_samples(spark, str(tmp_path), encoding, 2).orderBy("frame", "channel").collect()
    assert [r["x"] for r in rows][:6] == (x / 128).tolist() and [(r["frame"], r["channel"]) for r in rows] == [(f, c) for f in range(3) for c in (0, 1)]
    extents = {r["path"].rsplit("/")[-1]: r for r in raw.read_extents(spark, str(tmp_path), encoding, 2, 3).collect()}
    assert extents["a.raw"]["frames"] == 3 and extents["a.raw"]["seconds"] == 1.0 and extents["a.raw"]["tail_bytes"] == 2 * size - 1
    assert extents["a.raw"]["error"] == f"{2 * size - 1} bytes after the last whole frame"
    assert "empty.raw" not in extents


def test_headerless_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        raw.read_samples(spark, str(tmp_path), "s12", 1)
    with pytest.raises(ValueError):
        raw.read_extents(spark, str(tmp_path), "s16le", 0, 8000)


def form(compression, channels, frames, bits, body):
    rate = struct.pack(">HQ", 16383 + 12, 8000 << 51)
    common = struct.pack(">hIh", channels, frames, bits) + rate + compression + b"\0\0"
    parts = b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">III", len(body) + 8, 0, 0) + body
    return b"FORM" + struct.pack(">I", len(parts) + 4) + b"AIFC" + parts


@pytest.mark.parametrize(("compression", "encoding", "bits"), [("NONE", "s24be", 24), ("NONE", "s16be", 12), ("sowt", "s16le", 16), ("fl32", "f32be", 32), ("fl64", "f64be", 64), ("23ni", "s32le", 32), ("raw ", "u8", 8)])
def test_aiff_samples(compression, encoding, bits):
    x = np.array([0, 64, -64, 127])
    top = x / 128 if encoding[0] == "f" else x + 128 if encoding == "u8" else x * (1 << 8 * raw.SIZES[encoding] - 8)
    data = form(compression.encode(), 2, 2, bits, block(top, encoding))
    head = aiff.parse(data)
    assert head["rate"] == 8000 and aiff.samples_of(data, head).tolist() == (x / 128).tolist()


def ima_plain(block):
    """One block, a sample at a time."""
    head = int.from_bytes(block[:2], "big")
    value, index, out = (head & 0xFF80) - (0x10000 if head & 0x8000 else 0), min(head & 127, 88), []
    for byte in block[2:]:
        for code in (byte & 15, byte >> 4):
            step = int(aiff.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
            out.append(value)
    return out


def test_ima_blocks(spark, tmp_path):
    assert len(aiff.STEPS) == 89
    body = np.random.default_rng(5).integers(0, 256, 34 * 6, dtype=np.uint8).tobytes()
    plain = [ima_plain(body[i : i + 34]) for i in range(0, len(body), 34)]
    assert aiff.ima_blocks(body + b"\0").tolist() == plain
    (tmp_path / "a.aifc").write_bytes(form(b"ima4", 2, 3, 16, body))
    (tmp_path / "bad.aifc").write_bytes(form(b"what", 2, 3, 16, body))
    rows = aiff.read_samples(spark, str(tmp_path)).where("channel = 1").orderBy("frame").collect()
    assert [r["x"] for r in rows] == [v / 32768 for b in plain[1::2] for v in b]


def test_rf64():
    frames = 1 << 31
    head = wav.header_bytes("int", 2, 48000, 16, frames)
    assert head[:4] == b"RF64" and struct.unpack_from("<3Q", head, 20) == (len(head) - 8 + 4 * frames, 4 * frames, frames)
    got = wav.parse_header(head + bytes(400))
    assert got["data_offset"] == len(head) and got["frames"] == 100 and got["channels"] == 2
    assert wav.header_bytes("float", 1, 8000, 32, 10)[:4] == b"RIFF"
    with pytest.raises(wav.WavError):
        wav.parse_header(head.replace(b"ds64", b"junk") + bytes(400))


def chunk(kind, body, size=None):
    return kind + struct.pack(">q", len(body) if size is None else size) + body


def number(n):
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def caf_file(packet_bytes, sizes, listed, valid, priming, remainder, frames=1024, unknown=False):
    desc = struct.pack(">d4s5I", 44100.0, b"aac ", 0, packet_bytes, frames, 2, 0)
    table = struct.pack(">qqii", len(sizes), valid, priming, remainder) + b"".join(map(number, listed))
    body = bytes(4) + bytes(sum(sizes))
    return b"caff\0\1\0\0" + chunk(b"desc", desc) + chunk(b"free", b"xx") + chunk(b"pakt", table) + chunk(b"data", body, -1 if unknown else None)


def test_caf_packets(spark, tmp_path):
    sizes = [3, 200, 20000, 127, 128]
    data = caf_file(0, sizes, sizes, 2500, 1100, 1520, unknown=True)
    got = caf.packets(data)
    start = len(data) - sum(sizes)
    assert got["size"].tolist() == sizes and got["offset"].tolist() == [start + sum(sizes[:i]) for i in range(5)]
    assert got["decode_time"].tolist() == [1024 * i for i in range(5)]
    heard = [[t for t in range(1024) if 1100 <= 1024 * i + t < 3600] for i in range(5)]
    assert (got["trim_end"] - got["trim_start"]).tolist() == [len(h) for h in heard]
    assert [(r.trim_start, r.trim_end) for r, h in zip(got.itertuples(), heard, strict=True) if h] == [(h[0], h[-1] + 1) for h in heard if h]
    (tmp_path / "a.caf").write_bytes(data)
    (tmp_path / "b.caf").write_bytes(caf_file(8, [8, 8], [], 2048, 0, 0))
    (tmp_path / "bad.caf").write_bytes(data[:40])
    tracks = {r["path"].rsplit("/")[-1]: r for r in caf.read_tracks(spark, str(tmp_path)).collect()}
    assert tracks["a.caf"]["codec"] == "aac " and tracks["a.caf"]["packets"] == 5 and tracks["a.caf"]["error"] is None
    assert tracks["bad.caf"]["error"] and tracks["bad.caf"]["packets"] is None
    counts = {r["path"].rsplit("/")[-1]: r["count"] for r in caf.read_packets(spark, str(tmp_path)).groupBy("path").count().collect()}
    assert counts == {"a.caf": 5, "b.caf": 2}


@pytest.mark.parametrize(("packet_bytes", "sizes", "listed", "frames"), [(0, [3, 4], [3, 5], 10), (0, [3, 4], [3], 10), (8, [8, 8], [8, 8], 10), (0, [3, 4], [3, 4], 0), (5, [8], [], 10)])
def test_caf_that_is_broken(packet_bytes, sizes, listed, frames):
    with pytest.raises(caf.CafError):
        caf.parse(caf_file(packet_bytes, sizes, listed, 0, 0, 0, frames))


def test_caf_numbers():
    assert caf.table_sizes(b"\x80\x80\x05" + number(1 << 26)).tolist() == [5, 1 << 26]
    for bad in (b"\x81", b"\x80" * 10 + b"\1", b"\xff" * 8 + b"\x7f"):
        with pytest.raises(caf.CafError):
            caf.table_sizes(bad)


def ape(*items, version=2000):
    body = b"".join(struct.pack("<II", len(v), flags) + k + b"\0" + v for k, v, flags in items)
    return body + b"APETAGEX" + struct.pack("<4I8x", version, len(body) + 32, len(items), 0)


def v1(title, comment, track=0):
    return b"TAG" + title.ljust(30, b"\0") + b"Someone".ljust(60, b"\0") + b"1999" + (comment[:28].ljust(28, b"\0") + bytes([0, track]) if track else comment.ljust(30, b"\0")) + b"\x11"


def test_tags_at_the_end(spark, tmp_path):
    own = ape((b"Title", b"One", 0), (b"Artist", b"A\0B", 0), (b"Cover Art (Front)", b"x\0\xff\xd8", 2))
    (tmp_path / "a").write_bytes(b"\xff\xfb" + bytes(50) + own + v1(b"Other", b"words", 7))
    (tmp_path / "b").write_bytes(v1(b"Alone", b"thirty characters are a comment"[:30]))
    (tmp_path / "c").write_bytes(form(b"NONE", 1, 0, 16, b"") + b"NAME\0\0\0\3abc\0" + b"AUTH\0\0\0\2me")
    (tmp_path / "d").write_bytes(b"TAG" + bytes(20))
    got = {}
    for r in tagged.read_tags(spark, str(tmp_path)).orderBy("path", "seq").collect():
        got.setdefault(r["path"].rsplit("/")[-1], []).append((r["tag"], r["value"]))
    assert got == {
        "a": [("title", "One"), ("artist", "A"), ("artist", "B"), ("date", "1999"), ("comment", "words"), ("track", "7")],
        "b": [("title", "Alone"), ("artist", "Someone"), ("date", "1999"), ("comment", "thirty characters are a commen")],
        "c": [("title", "abc"), ("artist", "me")],
    }
    assert list(tagged.apev2(ape((b"Title", b"One", 0), version=7))) == []
