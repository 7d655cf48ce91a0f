"""Edge values of operators, files and streams that the tables do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import pcm, sealing, text
from framewright.operators import framed, quality, resample, timeline
from framewright.sources import aiff, manifest, ogg, wav
from framewright.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "truncated", "rounded"), [(1.0, 32767, 32767), (-1.0, -32767, -32768), (2.0, 32767, 32767), (0.0, 0, 0), (0.99999, 32766, 32767)])
def test_float_to_i16(spark, x, truncated, rounded):
    assert one(spark, pcm.float_to_i16_truncated(F.lit(x))) == truncated
    assert one(spark, pcm.float_to_i16_rounded(F.lit(x))) == rounded


@pytest.mark.parametrize("x", [float("nan"), float("inf"), float("-inf")])
def test_float_that_is_no_number_is_silence(spark, x):
    assert one(spark, pcm.float_to_i16_rounded(F.lit(x))) == 0


@pytest.mark.parametrize(("x", "y"), [(-1, -1), (-257, -2), (256, 1), (255, 0)])
def test_shift_floors(spark, x, y):
    assert one(spark, pcm.shifted_to_i16(F.lit(x), 24)) == y


@pytest.mark.parametrize(("x", "y"), [(0x7FFFFF, 8388607), (0x800000, -8388608), (0xFFFFFF, -1)])
def test_sign_extension(spark, x, y):
    assert one(spark, pcm.sign_extended_24(F.lit(x))) == y


def test_stereo_average_truncates(spark):
    assert one(spark, pcm.halved_sum(F.lit(-3), F.lit(0))) == -1


def test_ulaw_round_trip_is_within_a_step(spark):
    got = spark.range(-32768, 32768, 37).select(F.col("id").cast("int").alias("x")).select("x", pcm.ulaw_decoded(pcm.ulaw_encoded(F.col("x"))).alias("y")).collect()
    assert all(abs(r["x"] - r["y"]) <= max(4, abs(r["x"]) // 16) for r in got if abs(r["x"]) < 32635)


def test_number_pairs(spark):
    pairs = {"03/12": (3, 12), " 7 ": (7, None), "x/2": (None, 2), "4294967296/1": (None, 1), "": (None, None)}
    for raw, want in pairs.items():
        a, b = text.number_pair(F.lit(raw))
        assert (one(spark, a), one(spark, b)) == want


def test_magic(spark):
    for data, kind in ((b"OggS....", "ogg"), (b"....ftypisom", "mp4"), (b"nothing", None)):
        assert one(spark, text.sniffed(F.lit(data))) == kind


@pytest.mark.parametrize("n", [1, 2, 100])
def test_nearest_rank(spark, n):
    values = [float(i * i % 101) for i in range(n)]
    got = quality.nearest_rank(spark.createDataFrame([(1, v) for v in values], "k int, v double"), "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, "k").first()
    ordered = sorted(values)
    assert (got["lo"], got["hi"]) == (ordered[0], ordered[-1])
    assert got["mid"] == ordered[int((n - 1) * 0.5 + 0.5)]


def test_identical_signals_have_infinite_ratio(spark):
    got = quality.compared(spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.1)], "k int, ref double, cand double"), "k")
    assert {r["k"]: r["snr_db"] for r in got.collect()} == {1: quality.INFINITE, 2: -quality.INFINITE}


def test_run_lengths(spark):
    runs = spark.createDataFrame([(1, 0, 2, 10), (1, 1, 0, 20), (1, 2, 1, 30)], "k int, o int, n int, v int")
    got = timeline.run_lengths_expanded(runs, "k", "o", "n", "v").collect()
    assert sorted((r["sample_id"], r["v"]) for r in got) == [(1, 10), (2, 10), (3, 30)]


def test_edit_map_falls_back(spark):
    edits = spark.createDataFrame([(1, 1, 100, 50, 0), (1, 2, 300, 50, 50)], "t int, entry_no int, media_time long, duration long, presentation_start long")
    times = spark.createDataFrame([(1, 120), (1, 20), (1, 200), (1, 999), (2, 5)], "t int, m long")
    got = {r["m"]: r["presentation"] for r in timeline.edit_mapped(times, edits, "t", "m").collect()}
    assert got == {120: 20, 20: -80, 200: -50, 999: 749, 5: 5}


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_round_trip(spark, tmp_path, bits):
    top = 1 << (bits - 1)
    x = np.array([[-top, top - 1], [0, 1], [5, -5]])
    (tmp_path / "a.wav").write_bytes(wav.wav_bytes(x, 48000, bits))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    heads = {r["path"].rsplit("/")[-1]: r for r in wav.read_headers(spark, str(tmp_path)).collect()}
    assert heads["a.wav"]["frames"] == 3 and heads["a.wav"]["bits"] == bits
    assert heads["bad.wav"]["error"]
    got = {(r["frame"], r["channel"]): r["x"] for r in wav.read_samples(spark, str(tmp_path)).collect()}
    assert got == {(f, c): x[f, c] / top for f in range(3) for c in range(2)}


def test_aiff_header():
    comm = b"\0\2\0\0\0\3\0\x10" + bytes.fromhex("400EBB80000000000000")
    data = b"FORM\0\0\0\0AIFFCOMM" + (18).to_bytes(4, "big") + comm + b"SSND" + (20).to_bytes(4, "big") + bytes(8) + bytes(12)
    got = aiff.parse(data)
    assert (got["channels"], got["frames"], got["bits"], got["rate"], got["data_bytes"]) == (2, 3, 16, 48000.0, 12)


def test_ogg_packets_and_checksums():
    data = ogg.page_bytes(7, 0, 0, [b"head"], first=True) + ogg.page_bytes(7, 1, 960, [b"x" * 300, b"y"], last=True)
    assert [p for _, p, _ in ogg.packets(data)] == [b"head", b"x" * 300, b"y"]
    assert [g for _, _, g in ogg.packets(data)] == [0, -1, 960]
    broken = data[:-1] + b"z"
    assert [p["checksum_ok"] for p in ogg.pages(broken)] == [True, False]


def test_tagged_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# c\na\tp\ts\ttitle=x=y\tartist=1\tartist=2\n")
    got = manifest.read_tagged(spark, str(tmp_path / "m.tsv")).first()
    assert got["expected"] == {"title": "x=y", "artist": "1|2"}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(s, i, (i * 3_000_000_000) % (1 << 33), (i * i) % 16) for s in (1, 2) for i in range(12)]
    schema = "stream_id long, seq long, pts long, counter long"
    for part in range(3):
        spark.createDataFrame(rows[part * 8 : part * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.unwrapped_stream(stream.select("stream_id", "seq", "pts")).writeStream.format("memory").queryName("unwrapped").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["stream_id"], r["seq"]): r["unwrapped"] for r in spark.table("unwrapped").collect()}
    want = timeline.pts_unwrapped(spark.createDataFrame(rows, schema), "stream_id", "seq", "pts").collect()
    assert got == {(r["stream_id"], r["seq"]): r["unwrapped"] for r in want}


def test_frame_stream_over_cuts(spark, tmp_path):
    payloads = [b"a", b"", b"b" * 70]
    data = b"".join(len(p).to_bytes(4, "big") + p for p in payloads)
    parts = [data[i : i + 9] for i in range(0, len(data), 9)]
    schema = "stream_id long, seq long, data binary"
    spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stateful.frames_stream(stream).writeStream.format("memory").queryName("frames").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [bytes(r["payload"]) for r in spark.table("frames").orderBy("frame").collect()] == payloads


def test_alaw_round_trip_is_within_a_step(spark):
    got = spark.range(-32768, 32768, 7).select(F.col("id").cast("int").alias("x")).select("x", pcm.alaw_decoded(pcm.alaw_encoded(F.col("x"))).alias("y")).toPandas()
    assert (abs(got["x"] - got["y"]) <= np.maximum(16, abs(got["x"]) / 32 + 1)).all()
    assert one(spark, pcm.alaw_encoded(F.lit(0))) == 0xD5


def test_sealing_follows_the_standard_vector():
    # Section 2.8.2 of RFC 8439.
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    (got,) = sealing.seal(key, [nonce], [plain], bytes.fromhex("50515253c0c1c2c3c4c5c6c7"))
    assert got[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691" and got[:8].hex() == "d31a8d34648e60db"
    assert sealing.unseal(key, [nonce] * 3, [got, got[:-1] + b"x", b"short"], bytes.fromhex("50515253c0c1c2c3c4c5c6c7")) == [plain, None, None]
    assert sealing.seal(key, [], []) == []


def test_sealed_nulls_and_empties(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"x" * 200)], "n long, p binary")
    got = rows.select("n", "p", sealing.sealed(bytes(32), F.col("p"), F.col("n")).alias("s")).select("p", sealing.opened(bytes(32), F.col("s"), F.col("n")).alias("q")).collect()
    assert all(r["p"] == r["q"] for r in got)


def test_resampled_tone(spark):
    tone = lambda n, rate: np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    for source, target in ((44100, 48000), (48000, 16000)):
        rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(tone(3000, source))], "stream_id long, frame long, x double")
        whole = [r["x"] for r in resample.sinc_resampled(rows, "stream_id", source, target).orderBy("out_frame").collect()]
        parts = [r["x"] for r in resample.sinc_resampled(rows, "stream_id", source, target, block=100).orderBy("out_frame").collect()]
        assert len(whole) == -(-3000 * target // source) and np.allclose(whole, parts, atol=1e-12)
        assert np.abs(np.array(whole) - tone(len(whole), target))[60:-60].max() < 5e-3
    assert resample.sinc_resampled(rows.limit(0), "stream_id", 1, 2).count() == 0


def test_frames_without_an_end(spark):
    rows = spark.createDataFrame([(1, 0, b"\0\0\0\2ab\0\0"), (1, 1, b"\0\1"), (2, 0, b"\xff\0\0\0zz")], "stream_id long, seq long, data binary")
    got = sorted((r["stream_id"], r["frame"], r["payload"], bool(r["error"])) for r in framed.frames_of(rows).collect())
    assert got == [(1, 0, b"ab", False), (1, 1, None, True), (2, 0, None, True)]
