"""Container parsers against files that are put together here."""

import struct

import numpy as np
import pytest

from framewright.operators import tags
from framewright.sources import matroska, mp4, ogg, tagged


def box(kind, *parts, long=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if long else struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *numbers, version=0, flags=0):
    return box(kind, struct.pack(f">I{len(numbers)}I", version << 24 | flags, *numbers))


def trak(tables):
    entry = struct.pack(">I4s6xH8xHH4xI", 36, b"mp4a", 1, 2, 16, 44100 << 16)
    return box(b"trak", full(b"tkhd", 0, 0, 7, 0, 0), box(b"mdia", full(b"mdhd", 0, 0, 44100, 5000, 0), full(b"hdlr", 0, struct.unpack(">I", b"soun")[0], 0, 0, 0), box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), *tables))))


def movie():
    """Five samples in chunks of 2, 2 and 1 behind the header."""
    sizes = [3, 5, 2, 7, 4]

    def whole(at):
        chunks = [at, at + 8, at + 17]
        tables = [full(b"stts", 2, 3, 1024, 2, 900), full(b"ctts", 2, 1, 10, 4, 0), full(b"stsc", 2, 1, 2, 1, 3, 1, 1), full(b"stsz", 0, 5, *sizes), full(b"stco", 3, *chunks), full(b"stss", 2, 1, 4)]
        return box(b"ftyp", b"isom") + box(b"moov", trak(tables))

    at = len(whole(0)) + 16
    return whole(at) + box(b"mdat", bytes(range(21)), long=True), at


def test_mp4_sample_tables():
    data, at = movie()
    (track,) = mp4.tracks(data)
    assert track == {"track_id": 7, "kind": "audio", "codec": "mp4a", "timescale": 44100, "duration": 5000, "rate": 44100.0, "channels": 2, "layout": "progressive"}
    got = mp4.packets(data)
    assert got["offset"].tolist() == [at + x for x in (0, 3, 8, 10, 17)] and got["size"].tolist() == [3, 5, 2, 7, 4]
    assert got["decode_time"].tolist() == [0, 1024, 2048, 3072, 3972] and got["presentation_time"].tolist()[0] == 10
    assert got["sync"].tolist() == [True, False, False, True, False] and got["sample_id"].tolist() == [1, 2, 3, 4, 5]


def test_mp4_fragments():
    head = box(b"moov", trak([full(b"stsz", 0, 0)]), box(b"mvex", full(b"trex", 7, 1, 1000, 4, 0x10000)))

    def part(start, offset):
        run = box(b"trun", struct.pack(">IIiI", 0x205, 3, offset, 0), struct.pack(">3I", 4, 5, 6))
        return box(b"moof", full(b"mfhd", 1), box(b"traf", full(b"tfhd", 7, flags=0x20000), full(b"tfdt", start), run))

    size = len(part(0, 0))
    data = head + part(500, size + 8) + box(b"mdat", bytes(15)) + part(9000, size + 8) + box(b"mdat", bytes(15))
    got = mp4.packets(data)
    assert mp4.layout(data) == "fragmented" and got["decode_time"].tolist() == [500, 1500, 2500, 9000, 10000, 11000]
    assert got["sync"].tolist() == [True, False, False] * 2 and got["sample_id"].tolist() == [1, 2, 3, 4, 5, 6]
    first = len(head) + size + 8
    assert got["offset"].tolist()[:3] == [first, first + 4, first + 9]


def test_mp4_that_is_broken():
    data, _ = movie()
    for bad in (data[:-3], data.replace(struct.pack(">III", 2, 3, 1024), struct.pack(">III", 2, 9, 1024)), struct.pack(">I4s", 4, b"free")):
        with pytest.raises(mp4.Mp4Error):
            mp4.packets(bad)
    assert mp4.layout(b"") is None and mp4.packets(b"").empty


def test_mp4_files(spark, tmp_path):
    data, _ = movie()
    (tmp_path / "a.m4a").write_bytes(data)
    (tmp_path / "b.mp4").write_bytes(data[:-3])
    (tmp_path / "c.mp4").write_bytes(b"")
    rows = {r["path"][-5:]: r for r in mp4.read_tracks(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.m4a", "b.mp4"} and rows["a.m4a"]["error"] is None and rows["b.mp4"]["error"]
    packets = mp4.read_packets(spark, str(tmp_path)).collect()
    assert sum(r["error"] is None for r in packets) == 5 and [r["path"][-5:] for r in packets if r["error"]] == ["b.mp4"]


def size_of(n):
    return (n | 1 << 28).to_bytes(4, "big")


def element(kind, *parts, unknown=False):
    body = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (b"\xff" if unknown else size_of(len(body))) + body


def webm():
    m = matroska
    entry = element(m.ENTRY, element(m.NUMBER, b"\1"), element(m.TYPE, b"\2"), element(m.CODEC, b"A_OPUS"), element(m.LENGTH, (20_000_000).to_bytes(4, "big")), element(m.AUDIO, element(m.RATE, struct.pack(">d", 48000)), element(m.CHANNELS, b"\2")))
    simple = lambda delta, flags, body: element(m.SIMPLE, b"\x81", struct.pack(">hB", delta, flags), body)
    first = element(m.CLUSTER, element(m.TIMESTAMP, b"\x64"), simple(0, 0x80, b"plain"), simple(20, 0x82, b"\1\2aabbbb"), simple(60, 0x84, b"\1aaabbb"), unknown=True)
    laced = simple(0, 0x06, b"\2" + bytes([0x82, 0xBF + 1]) + b"aa" + b"bbb" + b"c")
    group = element(m.GROUP, element(m.BLOCK, b"\x81", struct.pack(">hB", 5, 0), b"xyz"), element(m.REFERENCE, b"\xff"))
    second = element(m.CLUSTER, element(m.TIMESTAMP, b"\0\xc8"), laced, group)
    return element(m.EBML, b"") + element(m.SEGMENT, element(m.INFO, element(m.SCALE, (1_000_000).to_bytes(3, "big"))), element(m.TRACKS, entry), first, second, unknown=True)


def test_matroska_frames():
    data = webm()
    tracks, frames = matroska.parse(data)
    assert tracks == [{"rate": 48000.0, "channels": 2, "language": "eng", "track_id": 1, "kind": "audio", "codec": "A_OPUS", "default_ns": 20_000_000}]
    assert [data[f["offset"] : f["offset"] + f["size"]] for f in frames] == [b"plain", b"aa", b"bbbb", b"aaa", b"bbb", b"aa", b"bbb", b"c", b"xyz"]
    assert [f["timestamp_ns"] // 1_000_000 for f in frames] == [100, 120, 140, 160, 180, 200, 220, 240, 205]
    assert [f["keyframe"] for f in frames] == [True, True, True, True, True, False, False, False, False]
    assert matroska.parse(data[:-8])[1] == frames[:8]  # the last block lacks two bytes


def test_matroska_files(spark, tmp_path):
    (tmp_path / "a.webm").write_bytes(webm())
    (tmp_path / "b.mkv").write_bytes(b"no such file")
    errors = {r["path"][-4:]: r["error"] for r in matroska.read_tracks(spark, str(tmp_path)).collect()}
    assert errors["webm"] is None and errors[".mkv"]
    assert matroska.read_frames(spark, str(tmp_path)).count() == 9


def comment_block(*entries):
    return struct.pack("<I", 1) + b"v" + struct.pack("<I", len(entries)) + b"".join(struct.pack("<I", len(e)) + e for e in (x.encode() for x in entries))


def id3_tag(version):
    def frame(name, body):
        size = bytes([0, 0, len(body) >> 7, len(body) & 127]) if version == 4 else len(body).to_bytes(4, "big")
        return name + size + b"\0\0" + body

    body = frame(b"TIT2", b"\3Zw\xc3\xb6lf") + frame(b"TPE1", b"\1" + "Eins\0Zwei".encode("utf-16")) + frame(b"TXXX", b"\0mood\0calm") + frame(b"APIC", bytes(200)) + bytes(20)
    return b"ID3" + bytes([version, 0, 0, 0, 0, len(body) >> 7, len(body) & 127]) + body


@pytest.mark.parametrize("version", [3, 4])
def test_id3(version):
    assert list(tagged.tags_of(id3_tag(version))) == [("title", "Zwölf"), ("artist", "Eins"), ("artist", "Zwei"), ("mood", "calm")]
    for n in range(0, len(id3_tag(version)), 7):
        list(tagged.tags_of(id3_tag(version)[:n]))


def test_comments_and_lists(spark, tmp_path):
    block = comment_block("TITLE=a=b", "no sign", "artist=x", "ARTIST=y", "artist=x")
    want = [("title", "a=b"), ("artist", "x"), ("artist", "y"), ("artist", "x")]
    flac = b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + bytes(34) + bytes([0x84]) + len(block).to_bytes(3, "big") + block
    pages = ogg.page_bytes(1, 0, 0, [b"OpusHead"], first=True) + ogg.page_bytes(1, 1, 0, [b"OpusTags" + block])
    inner = b"INAM" + struct.pack("<I", 4) + b"abc\0" + b"IART" + struct.pack("<I", 3) + b"xyz\0"
    riff = b"RIFF" + struct.pack("<I", 12 + len(inner)) + b"WAVE" + b"LIST" + struct.pack("<I", 4 + len(inner)) + b"INFO" + inner
    assert list(tagged.tags_of(flac)) == want == list(tagged.tags_of(pages))
    assert list(tagged.tags_of(riff)) == [("title", "abc"), ("artist", "xyz")] and list(tagged.tags_of(b"")) == []
    for name, data in (("a.flac", flac), ("b.ogg", pages), ("c.wav", riff), ("d.bin", b"")):
        (tmp_path / name).write_bytes(data)
    assert [(r["sequence"], r["checksum_ok"]) for r in ogg.read_pages(spark, str(tmp_path)).collect()] == [(0, True), (1, True)]
    got = tags.rolled_up(tagged.read_tags(spark, str(tmp_path)), "path", "seq", "tag", "value").collect()
    assert {(r["path"][-6:], r["tag"]): (r["all_values"], r["n"]) for r in got}[("a.flac", "artist")] == ("x|y", 3)
    assert len(got) == 6 and np.all([r["first_value"] for r in got])


def test_an_empty_list_of_sync_samples_marks_all():
    data, _ = movie()
    at = data.find(b"stss")
    if at < 0:
        pytest.skip("the movie has no list")
    cut = bytearray(data)
    cut[at + 8 : at + 12] = bytes(4)
    assert mp4.packets(bytes(cut))["sync"].all()


def test_wire_formats():
    from framewright.functions import wire

    for form in wire.WIRE:
        values = np.array([0, 1, 200 if form == "u8" else -1, 127 if form == "u8" else -32768])
        data = wire.packed(values, form)
        assert len(data) == 4 * wire.WIRE[form][1] and wire.unpacked(data + b"\x01"[: wire.WIRE[form][1] - 1], form).tolist() == values.tolist()
    assert wire.packed(np.array([-2]), "s24be") == b"\xff\xff\xfe" and wire.unpacked(b"\x01\x00\x80", "s24le").tolist() == [-8388607]


def test_ogg_checksum_a_bit_at_a_time():
    from framewright.sources import ogg

    for n in (0, 1, 5, 300):
        page, crc = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes(), 0
        for b in page:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        assert ogg.checksum(page) == crc


def edited(entries, version=0, movie=1000):
    """A movie of five samples whose track has an edit list."""
    tables = [full(b"stts", 1, 5, 1000), full(b"stsc", 1, 1, 5, 1), full(b"stsz", 4, 5), full(b"stco", 1, 0)]
    body = b"".join(struct.pack(">QqI" if version else ">IiI", d, t, rate) for d, t, rate in entries)
    track = trak(tables)
    elst = box(b"edts", box(b"elst", struct.pack(">II", version << 24, len(entries)), body))
    names = box(b"\xa9nam", box(b"data", struct.pack(">II", 1, 0), b"Song")) + box(b"trkn", box(b"data", struct.pack(">II4H", 0, 0, 0, 3, 9, 0))) + box(b"gnre", box(b"data", struct.pack(">IIH", 0, 0, 5)))
    meta = box(b"udta", box(b"meta", bytes(4), full(b"hdlr", 0, 0, 0), box(b"ilst", names)))
    return box(b"ftyp", b"M4A ") + box(b"moov", full(b"mvhd", 0, 0, movie, 5000), box(b"trak", track[8:], elst), meta)


@pytest.mark.parametrize("version", [0, 1])
def test_mp4_edit_lists(spark, tmp_path, version):
    one = 1 << 16
    data = edited([(20, -1, one), (50, 1000, one), (45, 4000, one)], version)
    got = mp4.edits(data)
    # 20, 50 and 45 thousandths of a second, at 44,100 a second.
    assert got.values.tolist() == [[7, 1, 882, -1], [7, 2, 2205, 1000], [7, 3, 1985, 4000]]
    (tmp_path / "a.mp4").write_bytes(data)
    (tmp_path / "b.mp4").write_bytes(edited([]))
    (tmp_path / "c.mp4").write_bytes(edited([(20, 0, 2 * one)]))
    shown = [(r["path"][-5:], r["presentation_time"], r["presentation"]) for r in mp4.read_presented(spark, str(tmp_path)).orderBy("path", "sample_id").collect()]
    assert shown[:5] == [("a.mp4", t, p) for t, p in [(0, -118), (1000, 882), (2000, 1882), (3000, 2882), (4000, 3087)]]
    assert shown[5:] == [(f, t, t) for f in ("b.mp4", "c.mp4") for t in range(0, 5000, 1000)]
    errors = {r["path"][-5:]: r["error"] for r in mp4.read_edits(spark, str(tmp_path)).collect()}
    assert errors == {"a.mp4": None, "c.mp4": "edits at another rate"}


@pytest.mark.parametrize("entries", [[(5, -1, 1 << 16)], [(5, -2, 1 << 16)]])
def test_mp4_edits_without_a_place(entries):
    with pytest.raises(mp4.Mp4Error):
        mp4.edits(edited(entries))
    with pytest.raises(mp4.Mp4Error):
        mp4.edits(edited([(5, 0, 1 << 16)], movie=0))


def test_mp4_item_lists():
    assert list(tagged.tags_of(edited([]))) == [("title", "Song"), ("track", "3/9")]
    assert list(tagged.tags_of(edited([])[:-3])) == []
