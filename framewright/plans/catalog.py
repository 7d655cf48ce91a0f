"""All queries of the engine by name, with SQL that gives the same rows on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import pcm, sealing, text
from framewright.operators import channels, framed, integrity, quality, resample, tags, timeline
from framewright.plans import adapt
from framewright.plans import header_catalog, source_catalog, table_catalog, wire_catalog  # noqa: F401  (their queries join the registry)
from framewright.plans.adapt import EDITS, INDEX, INTS, ORDER, PAIRS, PLANES, SAMPLES, table
from framewright.plans.registry import oracle_sql, queries, query  # noqa: F401

def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = adapt.samples(spark, sf)
    return s.select("stream_id", "frame", F.col("x").alias("ref"), (F.round(F.col("x") * F.when(F.col("x") < 0, 32768).otherwise(32767)) / 32768.0).alias("cand"))


def _ints(spark: SparkSession, sf: str) -> DataFrame:
    return adapt.samples(spark, sf).select("event_id", "x", pcm.float_to_i16_rounded(F.col("x")).alias("i16"))


# Sample formats


@query(f"WITH {SAMPLES} SELECT event_id, CAST(trunc(x * 32767) AS INTEGER) AS i16 FROM samples")
def pcm_f32_to_i16_trunc(spark, sf):
    return adapt.samples(spark, sf).select("event_id", pcm.float_to_i16_truncated(F.col("x")).alias("i16"))


@query(f"WITH {SAMPLES}, {INTS} SELECT event_id, i16 FROM ints")
def pcm_f32_to_i16_round(spark, sf):
    return _ints(spark, sf).select("event_id", "i16")


@query(f"WITH {SAMPLES} SELECT event_id, CAST(trunc(CASE WHEN x >= 0 THEN x * 2147483647 ELSE x * 2147483648 END) AS BIGINT) AS i32 FROM samples")
def pcm_i32_asymmetric(spark, sf):
    return adapt.samples(spark, sf).select("event_id", pcm.float_to_i32_asymmetric(F.col("x")).alias("i32"))


@query(f"WITH {SAMPLES} SELECT event_id, CAST(greatest(-8388608, least(8388607, round(x * 1.1 * 8388608))) AS INTEGER) AS s24 FROM samples")
def pcm_s24_clamp(spark, sf):
    return adapt.samples(spark, sf).select("event_id", pcm.float_to_s24(F.col("x") * F.lit(1.1)).alias("s24"))


@query(f"WITH {SAMPLES}, {INTS} SELECT event_id, CAST(round(i16 * 8388607.0::DOUBLE / 32768) AS INTEGER) AS s24 FROM ints")
def pcm_s16_to_s24(spark, sf):
    return _ints(spark, sf).select("event_id", pcm.i16_to_s24(F.col("i16")).alias("s24"))


@query(f"WITH {SAMPLES}, {INTS} SELECT event_id, CASE WHEN i16 <= 0 THEN i16 ELSE CAST(round(i16 * 32767.0::DOUBLE / 32768) AS INTEGER) END AS y FROM ints")
def pcm_i16_positive_rescale(spark, sf):
    return _ints(spark, sf).select("event_id", pcm.i16_positive_rescaled(F.col("i16")).alias("y"))


@query(f"WITH {SAMPLES}, {INTS} SELECT event_id, (i16 * 256 + event_id % 256) >> 8 AS i16 FROM ints")
def pcm_shift_exact(spark, sf):
    return _ints(spark, sf).select("event_id", pcm.shifted_to_i16(F.col("i16") * 256 + F.col("event_id") % 256, 24).alias("i16"))


@query(f"WITH {SAMPLES}, {INTS} SELECT event_id, CAST((i16 * 65536) & 16777215 AS INTEGER) AS masked FROM ints")
def pcm_mask_s24(spark, sf):
    return _ints(spark, sf).select("event_id", pcm.low_24(F.col("i16") * 65536).alias("masked"))


@query(f"WITH {SAMPLES}, {INTS}, m AS (SELECT event_id, (i16 * 256) & 16777215 AS u FROM ints) SELECT event_id, CAST(CASE WHEN u >= 8388608 THEN u - 16777216 ELSE u END AS INTEGER) AS s24 FROM m")
def pcm_s24_sign_extend(spark, sf):
    return _ints(spark, sf).select("event_id", pcm.sign_extended_24(pcm.low_24(F.col("i16") * 256)).alias("s24"))


@query(f"WITH {SAMPLES}, {INTS} SELECT event_id, i16 / 32768.0::DOUBLE AS x FROM ints")
def pcm_i16_to_f32(spark, sf):
    return _ints(spark, sf).select("event_id", pcm.i16_to_float(F.col("i16")).alias("x"))


@query("SELECT event_id, CASE WHEN value > 480 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 100 - 2)) END AS x FROM events")
def finite_clamp(spark, sf):
    e = table(spark, sf, "events")
    odd = F.when(F.col("value") > 485, F.lit(float("inf"))).when(F.col("value") > 480, F.lit(float("nan"))).otherwise(F.col("value") / 100 - 2)
    return e.select("event_id", pcm.finite(odd).alias("x"))


_ULAW = f"""WITH {SAMPLES}, {INTS}, m AS (SELECT event_id, i16, least(32635, abs(i16)) + 132 AS s FROM ints),
e AS (SELECT *, CASE WHEN s >= 16384 THEN 7 WHEN s >= 8192 THEN 6 WHEN s >= 4096 THEN 5 WHEN s >= 2048 THEN 4 WHEN s >= 1024 THEN 3 WHEN s >= 512 THEN 2 WHEN s >= 256 THEN 1 ELSE 0 END AS ex FROM m),
c AS (SELECT *, (s // CAST(pow(2, ex + 3) AS INTEGER)) % 16 AS ma FROM e)"""


@query(_ULAW + """ SELECT event_id, CAST(255 - (CASE WHEN i16 < 0 THEN 128 ELSE 0 END + ex * 16 + ma) AS INTEGER) AS code,
 CAST((CASE WHEN i16 < 0 THEN -1 ELSE 1 END) * ((ma * 8 + 132) * CAST(pow(2, ex) AS INTEGER) - 132) AS INTEGER) AS decoded FROM c""")
def g711_roundtrip(spark, sf):
    coded = _ints(spark, sf).select("event_id", pcm.ulaw_encoded(F.col("i16")).cast("int").alias("code"))
    return coded.select("event_id", "code", pcm.ulaw_decoded(F.col("code")).cast("int").alias("decoded"))


# Channels


@query(f"WITH {PLANES} SELECT vec_id, channel, frame, x FROM planes")
def deinterleave_planes(spark, sf):
    return adapt.planes(spark, sf)


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def interleave_planes(spark, sf):
    return channels.interleaved(adapt.planes(spark, sf), "vec_id", 2)


@query(f"WITH {PLANES} SELECT vec_id, frame, round(avg(x), 9) AS x FROM planes GROUP BY ALL")
def mono_mean(spark, sf):
    return channels.mono_mean(adapt.planes(spark, sf), "vec_id").withColumn("x", F.round("x", 9))


@query(f"WITH {PLANES} SELECT vec_id, frame, x FROM planes WHERE channel = 0")
def mono_take_left(spark, sf):
    return adapt.planes(spark, sf).where("channel = 0").select("vec_id", "frame", "x")


@query(f"""WITH {PLANES}, i AS (SELECT vec_id, frame, max(CASE WHEN channel = 0 THEN CAST(trunc(x * 1000) AS INTEGER) END) AS l, max(CASE WHEN channel = 1 THEN CAST(trunc(x * 1000) AS INTEGER) END) AS r FROM planes GROUP BY ALL)
SELECT vec_id, frame, CAST(trunc((l + r) / 2.0) AS INTEGER) AS mono FROM i""")
def mono_avg_int(spark, sf):
    p = adapt.planes(spark, sf).withColumn("i", (F.col("x") * 1000).cast("int"))
    both = p.groupBy("vec_id", "frame").agg(F.max(F.when(F.col("channel") == 0, F.col("i"))).alias("l"), F.max(F.when(F.col("channel") == 1, F.col("i"))).alias("r"))
    return both.select("vec_id", "frame", pcm.halved_sum(F.col("l"), F.col("r")).alias("mono"))


@query("""WITH flat AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
p AS (SELECT vec_id, pos % 6 AS c, pos // 6 AS frame, CAST(v AS DOUBLE) AS x FROM flat),
m AS (SELECT vec_id, frame, sum(x * CASE WHEN c = 0 THEN 1 WHEN c IN (2, 4) THEN 0.707 ELSE 0 END) AS l, sum(x * CASE WHEN c = 1 THEN 1 WHEN c IN (2, 5) THEN 0.707 ELSE 0 END) AS r FROM p GROUP BY ALL),
k AS (SELECT *, greatest(1.0, max(greatest(abs(l), abs(r))) OVER (PARTITION BY vec_id)) AS peak FROM m)
SELECT vec_id, frame, round(l / peak, 9) AS l, round(r / peak, 9) AS r FROM k""")
def stereo_downmix_block_normalised(spark, sf):
    return channels.stereo_mix(adapt.planes(spark, sf, 6), "vec_id").select("vec_id", "frame", F.round("l", 9).alias("l"), F.round("r", 9).alias("r"))


@query("""WITH flat AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, pos - vec_id % 60 AS pos, CAST(x AS DOUBLE) AS x FROM flat WHERE pos >= vec_id % 60 AND pos < vec_id % 60 + 8""")
def pcm_slice_trim(spark, sf):
    cut = channels.trimmed(table(spark, sf, "embeddings").withColumn("a", (F.col("vec_id") % 60).cast("int")).withColumn("n", F.lit(8)), "embedding", "a", "n")
    return cut.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


# Quality


@query(f"WITH {SAMPLES}, {PAIRS} SELECT stream_id, count(*) AS n, round(sqrt(avg(ref * ref)), 9) AS rms, max(abs(ref)) AS peak FROM pairs GROUP BY ALL")
def pcm_stats(spark, sf):
    p = _pairs(spark, sf)
    return p.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("ref") * F.col("ref"))), 9).alias("rms"), F.max(F.abs("ref")).alias("peak"))


_SNR = "CASE WHEN sum((ref-cand)*(ref-cand)) = 0 THEN 999.0 WHEN sum(ref*ref) = 0 THEN {silent} ELSE 10 * log10(sum(ref*ref) / sum((ref-cand)*(ref-cand))) END"


@query(f"""WITH {SAMPLES}, {PAIRS} SELECT stream_id, count(*) AS n, round(sqrt(avg(ref*ref)), 9) AS rms_ref, round(sqrt(avg(cand*cand)), 9) AS rms_cand, round(max(abs(ref-cand)), 9) AS max_abs,
 round(avg(abs(ref-cand)), 9) AS mean_abs, round(sqrt(avg((ref-cand)*(ref-cand))), 9) AS rmse, count(*) FILTER (abs(ref-cand) > 0.00001) AS above_low, count(*) FILTER (abs(ref-cand) > 0.0001) AS above_high,
 round({_SNR.format(silent="-999.0")}, 6) AS snr_db FROM pairs GROUP BY ALL""")
def quality_compare(spark, sf):
    q = quality.compared(_pairs(spark, sf), "stream_id")
    fine = {c: F.round(c, 9) for c in ("rms_ref", "rms_cand", "max_abs", "mean_abs", "rmse")}
    return q.withColumns(fine | {"snr_db": F.round("snr_db", 6)})


@query(f"""WITH {SAMPLES}, {PAIRS}, l AS (SELECT stream_id, count(*) AS n, list_sort(list(abs(ref))) AS v FROM pairs GROUP BY ALL)
SELECT stream_id, n, v[CAST(round((n-1)*0.5) AS BIGINT)+1] AS p50, v[CAST(round((n-1)*0.99) AS BIGINT)+1] AS p99, v[CAST(round((n-1)*0.999) AS BIGINT)+1] AS p999 FROM l""")
def percentile_nearest_rank(spark, sf):
    return quality.nearest_rank(_pairs(spark, sf).withColumn("v", F.abs("ref")), "v", {"p50": 0.5, "p99": 0.99, "p999": 0.999}, "stream_id")


@query(f"""WITH {SAMPLES}, i AS (SELECT stream_id, CAST(round(x*32767) AS BIGINT) AS ref, CAST(floor(CAST(round(x*32767) AS BIGINT) / 16.0) AS BIGINT) * 16 AS cand FROM samples)
SELECT stream_id, round(sqrt(avg((ref-cand)*(ref-cand))), 6) AS rmse, round(avg(abs(ref-cand)), 6) AS mae, max(abs(ref-cand)) AS max_abs, round({_SNR.format(silent="0.0")}, 6) AS snr_db FROM i GROUP BY ALL""")
def quality_int16(spark, sf):
    i = adapt.samples(spark, sf).select("stream_id", F.round(F.col("x") * 32767).cast("long").alias("ref")).withColumn("cand", F.floor(F.col("ref") / 16) * 16)
    e = F.col("ref") - F.col("cand")
    got = i.groupBy("stream_id").agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.max(F.abs(e)).alias("max_abs"), F.sum(F.col("ref") * F.col("ref")).cast("double").alias("s"), F.sum(e * e).cast("double").alias("z"))
    return got.withColumn("snr_db", F.round(quality.snr_db(F.col("s"), F.col("z"), 0.0), 6)).drop("s", "z")


@query("""SELECT doc_id, round(CASE WHEN n_chars % 5 = 0 THEN 0.0 ELSE strlen(text) * 8.0 / (n_chars % 5) / 1000 END, 6) AS kbps FROM documents""")
def bitrate_kbps(spark, sf):
    d, dur = table(spark, sf, "documents"), F.col("n_chars") % 5
    return d.select("doc_id", F.round(F.when(dur == 0, F.lit(0.0)).otherwise(F.octet_length("text") * 8.0 / F.nullif(dur, F.lit(0)) / 1000), 6).alias("kbps"))


@query(f"WITH {SAMPLES}, {PAIRS} SELECT stream_id, round(CASE WHEN avg((ref-cand)*(ref-cand)) = 0 THEN 999.0 ELSE 10 * log10(1.0 / avg((ref-cand)*(ref-cand))) END, 6) AS psnr FROM pairs GROUP BY ALL")
def psnr(spark, sf):
    d = F.col("ref") - F.col("cand")
    m = _pairs(spark, sf).groupBy("stream_id").agg(F.avg(d * d).alias("m"))
    return m.select("stream_id", F.round(F.when(F.col("m") == 0, quality.INFINITE).otherwise(10 * F.log10(F.lit(1.0) / F.nullif("m", F.lit(0.0)))), 6).alias("psnr"))


_FRAMES = f"""WITH {SAMPLES}, {PAIRS}, f AS (SELECT stream_id, frame // 16 AS frame_no, count(*) AS n, round(sqrt(avg((ref-cand)*(ref-cand))), 9) AS rmse, round(max(abs(ref-cand)), 9) AS max_abs, round(avg(abs(ref-cand)), 9) AS mean_abs FROM pairs GROUP BY ALL)"""


@query(_FRAMES + " SELECT * FROM f")
def frame_rmse(spark, sf):
    f = quality.frame_errors(_pairs(spark, sf), 16, "stream_id")
    return f.withColumns({c: F.round(c, 9) for c in ("rmse", "max_abs", "mean_abs")})


@query(_FRAMES + " SELECT * FROM f ORDER BY rmse DESC, max_abs DESC, stream_id, frame_no LIMIT 20")
def frame_quality_hotspots(spark, sf):
    return quality.hotspots(frame_rmse(spark, sf), 20, "stream_id", "frame_no")


@query(f"""WITH {SAMPLES}, {PAIRS}, t AS (SELECT stream_id, frame // 8 AS tile, frame, abs(ref-cand) AS e FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, tile ORDER BY e DESC, frame) AS k FROM t)
SELECT stream_id, tile, round(sqrt(avg(e*e)), 9) AS rmse, round(max(e), 9) AS max_abs, max(CASE WHEN k = 1 THEN frame END) AS at FROM r GROUP BY ALL""")
def tile_error_argmax(spark, sf):
    t = quality.tile_errors(_pairs(spark, sf), 8, "stream_id")
    return t.withColumns({"rmse": F.round("rmse", 9), "max_abs": F.round("max_abs", 9)})


@query(f"""WITH {SAMPLES}, {INTS}, i AS (SELECT stream_id, frame, i16 FROM samples JOIN ints USING (event_id)), c AS (SELECT stream_id, count(*) AS n FROM i GROUP BY ALL)
SELECT stream_id, CAST(frame // CAST(ceil(n / 10.0) AS BIGINT) AS BIGINT) AS bin, max(abs(i16)) / 32768.0::DOUBLE AS peak FROM i JOIN c USING (stream_id) GROUP BY ALL""")
def waveform_peaks(spark, sf):
    return quality.waveform_peaks(adapt.samples(spark, sf).withColumn("x", pcm.float_to_i16_rounded(F.col("x"))), 10, "stream_id")


@query(f"""WITH {SAMPLES}, {PAIRS}, t AS (SELECT stream_id, count(*) AS n, sqrt(avg((ref-cand)*(ref-cand))) AS rmse, avg(abs(ref-cand)) AS mae, max(abs(ref-cand)) AS most FROM pairs GROUP BY ALL)
SELECT stream_id % 3 AS backend, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS samples, round(avg(rmse), 9) AS rmse, round(avg(mae), 9) AS mae, round(max(most), 9) AS most FROM t GROUP BY ALL""")
def backend_aggregate(spark, sf):
    """Sums over a backend's tracks, means of the tracks' own measures, and the largest error of any."""
    tracks = quality.compared(_pairs(spark, sf), "stream_id")
    return tracks.groupBy((F.col("stream_id") % 3).alias("backend")).agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").cast("long").alias("samples"), F.round(F.avg("rmse"), 9).alias("rmse"), F.round(F.avg("mean_abs"), 9).alias("mae"), F.round(F.max("max_abs"), 9).alias("most"))


@query(f"""WITH {SAMPLES}, r AS (SELECT stream_id, frame, x FROM samples), c AS (SELECT stream_id, frame + stream_id % 5 - 2 AS frame, x FROM samples), k AS (SELECT unnest(range(-3, 4)) AS shift),
e AS (SELECT r.stream_id, shift, round(sqrt(avg((r.x-c.x)*(r.x-c.x))), 9) AS rmse FROM k CROSS JOIN r JOIN c ON c.stream_id = r.stream_id AND c.frame = r.frame + shift GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY rmse, abs(shift), shift) AS n FROM e) SELECT stream_id, shift, rmse FROM o WHERE n = 1""")
def zip_align_best_shift(spark, sf):
    s = adapt.samples(spark, sf).select("stream_id", "frame", "x")
    return quality.best_shift(s, s.withColumn("frame", F.col("frame") + F.col("stream_id") % 5 - 2), 3, "stream_id").withColumn("shift", F.col("shift").cast("long"))


@query(f"""WITH {SAMPLES}, w AS (SELECT stream_id, frame, round(sum(x*x) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING), 9) AS energy,
 count(*) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n FROM samples),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY energy DESC, frame DESC) AS k FROM w WHERE n = 16) SELECT stream_id, frame AS start_frame, energy FROM o WHERE k = 1""")
def energy_probe_argmax(spark, sf):
    return quality.energy_peak(adapt.samples(spark, sf), 16, "stream_id")


# Sample tables and timelines


@query(f"""WITH {INDEX} SELECT track_id, sample_id, chunk, size, decode_time,
 coalesce(sum(size) OVER (PARTITION BY track_id, chunk ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_offset FROM idx""")
def sample_index_build(spark, sf):
    got = timeline.sample_index(adapt.raw_samples(spark, sf), "track_id", ORDER, 2)
    return got.select("track_id", "sample_id", "chunk", "size", "decode_time", "chunk_offset")


_RUNS = "runs AS (SELECT o_custkey AS track_id, o_orderkey AS run_no, o_orderkey % 4 AS n, o_orderkey % 9 + 1 AS delta FROM orders)"


def _runs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("run_no"), (F.col("o_orderkey") % 4).alias("n"), (F.col("o_orderkey") % 9 + 1).alias("delta"))


@query(f"""WITH {_RUNS}, x AS (SELECT track_id, run_no, delta, unnest(range(n)) AS i FROM runs)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY run_no, i) AS sample_id, delta FROM x""")
def rle_expand_durations(spark, sf):
    return timeline.run_lengths_expanded(_runs(spark, sf), "track_id", "run_no", "n", "delta")


@query(f"""WITH {INDEX}, offs AS (SELECT o_orderkey AS track_id, unnest(range(1, o_orderkey % 4 + 1)) AS sample_id, o_orderkey % 9 + 1 AS off FROM orders)
SELECT track_id, sample_id, decode_time + coalesce(off, 0) AS presentation_time FROM idx LEFT JOIN offs USING (track_id, sample_id)""")
def rle_left_default(spark, sf):
    index = timeline.sample_index(adapt.raw_samples(spark, sf), "track_id", ORDER, 2)
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("track_id"), F.lit(1).alias("run_no"), (F.col("o_orderkey") % 4).alias("n"), (F.col("o_orderkey") % 9 + 1).alias("off"))
    offsets = timeline.run_lengths_expanded(runs, "track_id", "run_no", "n", "off")
    return index.join(offsets, ["track_id", "sample_id"], "left").select("track_id", "sample_id", (F.col("decode_time") + F.coalesce("off", F.lit(0))).alias("presentation_time"))


@query(f"""WITH {INDEX}, sync AS (SELECT o_orderkey AS track_id, 1 AS sample_id FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 3 > 0)
SELECT track_id, sample_id FROM idx WHERE (track_id, sample_id) IN (SELECT track_id, sample_id FROM sync) OR track_id NOT IN (SELECT track_id FROM sync)""")
def sync_semi_join(spark, sf):
    index = timeline.sample_index(adapt.raw_samples(spark, sf), "track_id", ORDER, 2).select("track_id", "sample_id")
    sync = table(spark, sf, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("track_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("sample_id"))
    listed = sync.groupBy("track_id").agg(F.collect_set("sample_id").alias("ids"))
    return index.join(listed, "track_id", "left").where("ids is null or array_contains(ids, sample_id)").select("track_id", "sample_id")


@query(f"WITH {INDEX} SELECT track_id, sample_id, o_orderpriority AS codec, decode_time / 48000.0 AS seconds FROM idx JOIN orders ON o_orderkey = track_id")
def sample_track_join(spark, sf):
    index = timeline.sample_index(adapt.raw_samples(spark, sf), "track_id", ORDER, 2)
    tracks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_orderpriority").alias("codec"))
    return index.join(tracks, "track_id").select("track_id", "sample_id", "codec", (F.col("decode_time") / 48000.0).alias("seconds"))


@query(f"WITH {EDITS} SELECT track_id, entry_no, media_time, presentation_start FROM edits")
def edit_running_start(spark, sf):
    return timeline.edit_starts(adapt.edits(spark, sf), "track_id", "entry_no").select("track_id", "entry_no", "media_time", "presentation_start")


@query(f"""WITH {EDITS}, t AS (SELECT event_id, user_id AS track_id, event_id % 450 AS t FROM events),
c AS (SELECT event_id, t, e.entry_no, e.media_time, e.presentation_start, CASE WHEN t >= e.media_time AND t < e.media_time + e.duration THEN 0 WHEN t < e.media_time THEN 1 ELSE 2 END AS class FROM t LEFT JOIN edits e USING (track_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY class, CASE WHEN class = 2 THEN -entry_no ELSE entry_no END) AS k FROM c)
SELECT event_id, t, CASE WHEN entry_no IS NULL THEN t ELSE t - media_time + presentation_start END AS presentation FROM o WHERE k = 1""")
def edit_asof_map(spark, sf):
    edits = timeline.edit_starts(adapt.edits(spark, sf), "track_id", "entry_no")
    times = table(spark, sf, "events").select("event_id", F.col("user_id").alias("track_id"), (F.col("event_id") % 450).alias("t"))
    return timeline.edit_mapped(times, edits, "track_id", "t").select("event_id", "t", "presentation")


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 97 END AS own, n_regionkey AS track, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS frag FROM events JOIN nation ON n_nationkey = user_id % 25)
SELECT event_id, CAST(coalesce(own, frag, track + 1000) AS BIGINT) AS size, CAST(CASE WHEN own IS NOT NULL THEN 'sample' WHEN frag IS NOT NULL THEN 'fragment' ELSE 'track' END AS VARCHAR) AS origin FROM p""")
def defaults_cascade(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("track"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("frag"))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 97).alias("own"), (F.col("user_id") % 25).cast("int").alias("n_nationkey"))
    both = e.join(n, "n_nationkey")  # the fixed table is small enough to be broadcast by its size
    return both.select("event_id", F.coalesce("own", "frag", F.col("track") + 1000).cast("long").alias("size"), F.when(F.col("own").isNotNull(), "sample").when(F.col("frag").isNotNull(), "fragment").otherwise("track").alias("origin"))


@query("""SELECT l_orderkey AS clip, max(r_name) AS package, count(*) AS references_n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def graph_resolve(spark, sf):
    t = lambda n: table(spark, sf, n)
    clips = t("lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(F.count(F.lit(1)).alias("references_n"))
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("package"))
    return clips.join(t("orders"), F.col("clip") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey")).select("clip", "package", "references_n")


@query("SELECT p_partkey AS track_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_anti_join(spark, sf):
    tracks = table(spark, sf, "part").select(F.col("p_partkey").alias("track_id"))
    described = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("track_id"))
    return integrity.orphans(tracks, described, ["track_id"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') ")
def reachability_semi_join(spark, sf):
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(used, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("""WITH p AS (SELECT event_id, event_id % 5000 AS st, 1024 AS d, 900 + event_id % 200 AS fr, 2000 AS es, 1500 AS ed, 44100 AS ts, 48000 AS rt FROM events),
c AS (SELECT *, greatest(st, es) - st AS b, least(st + d, es + ed) - st AS e FROM p), k AS (SELECT event_id, least(fr, (b * rt + ts - 1) // ts) AS source_start, least(fr, e * rt // ts) AS source_end FROM c WHERE e > b)
SELECT event_id, source_start, source_end - source_start AS source_count FROM k WHERE source_end > source_start""")
def interval_trim(spark, sf):
    c = {"start": "event_id % 5000", "duration": "1024L", "frames": "900 + event_id % 200", "edit_start": "2000L", "edit_duration": "1500L", "timescale": "44100L", "rate": "48000L"}
    packets = table(spark, sf, "events").select("event_id", *(F.expr(v).alias(k) for k, v in c.items()))
    return timeline.interval_trimmed(packets).select("event_id", "source_start", "source_count")


@query("""WITH p AS (SELECT event_id, user_id, (event_id * 900000000) % 8589934592 AS pts FROM events), l AS (SELECT *, lag(pts) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM p)
SELECT event_id, pts + sum(CASE WHEN q - pts > 4294967296 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) * 8589934592 AS unwrapped FROM l""")
def pts_unwrap(spark, sf):
    p = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") * F.lit(900000000).cast("long") % F.lit(8589934592)).alias("pts"))
    return timeline.pts_unwrapped(p, "user_id", "event_id", "pts").select("event_id", "unwrapped")


@query("""WITH p AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 3 ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 16 END AS cc FROM events), l AS (SELECT *, lag(cc) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM p)
SELECT event_id, coalesce(q = cc, false) AS duplicate, coalesce(q <> cc AND (q + 1) % 16 <> cc, false) AS gap FROM l""")
def continuity_gaps(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    p = table(spark, sf, "events").withColumn("cc", F.when(F.col("event_id") % 11 == 0, 3).otherwise(n % 16))
    return integrity.continuity(p, "user_id", "event_id", "cc").select("event_id", "duplicate", "gap")


@query("""WITH l AS (SELECT conv_id, turn, length(text) AS g, lag(turn) OVER w AS q, lag(length(text)) OVER w AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(greatest(0, turn - q - 1), 0) AS lost, coalesce(g < h, false) AS backwards FROM l""")
def sequence_check(spark, sf):
    c = table(spark, sf, "conversations").withColumn("g", F.length("text"))
    return integrity.sequence_checked(c, "conv_id", "turn", "turn", "g").select("conv_id", "turn", "lost", "backwards")


_SPANS = "spans AS (SELECT user_id, event_id, sum(4 + event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) - (4 + event_id % 3) + CASE WHEN event_id % 10 = 0 THEN 5 ELSE 0 END AS st, 4 + event_id % 3 AS n FROM events)"


def _spans(spark, sf):
    n = F.col("event_id") % 3 + 4
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("user_id", "event_id", (F.sum(n).over(w) - n + F.when(F.col("event_id") % 10 == 0, 5).otherwise(0)).alias("st"), n.alias("n"))


@query(f"""WITH {_SPANS}, b AS (SELECT *, CASE WHEN lag(st + n) OVER w <> st THEN 1 ELSE 0 END AS k FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM b) SELECT user_id, CAST(run AS BIGINT) AS run, min(st) AS start, sum(n) AS length, count(*) AS n FROM r GROUP BY ALL""")
def coalesce_runs(spark, sf):
    return timeline.coalesced(_spans(spark, sf), "user_id", "event_id", "st", "n")


@query(f"""WITH {_SPANS}, b AS (SELECT *, CASE WHEN lag(st + n) OVER w <> st THEN 1 ELSE 0 END AS k FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS packets, sum(k) AS breaks FROM b GROUP BY ALL""")
def contiguous_pts(spark, sf):
    return integrity.contiguous(_spans(spark, sf), "user_id", "event_id", "st", "n")


@query(f"""WITH {SAMPLES}, n AS (SELECT stream_id, frame, x, lead(x) OVER (PARTITION BY stream_id ORDER BY frame) AS y, count(*) OVER (PARTITION BY stream_id) AS n FROM samples),
s AS (SELECT *, (frame * 48000 + 44099) // 44100 AS a, CASE WHEN y IS NULL THEN CAST(round(n * 48000 / 44100.0) AS BIGINT) ELSE ((frame + 1) * 48000 + 44099) // 44100 END AS b FROM n),
o AS (SELECT *, unnest(range(a, b)) AS out_frame FROM s WHERE b > a)
SELECT stream_id, out_frame, round(CASE WHEN y IS NULL THEN x ELSE x + (y - x) * (out_frame * 44100.0::DOUBLE / 48000 - frame) END, 9) AS x FROM o""")
def lerp_resample_48k(spark, sf):
    return timeline.lerp_resampled(adapt.samples(spark, sf), "stream_id", 44100, 48000).withColumn("x", F.round("x", 9))


@query(f"WITH {SAMPLES} SELECT stream_id, frame // 24 AS block, min(frame) AS start_frame, count(*) AS n, round(sum(x), 6) AS total FROM samples GROUP BY ALL")
def rechunk_blocks(spark, sf):
    return timeline.rechunked(adapt.samples(spark, sf), "stream_id", 24).withColumn("total", F.round("total", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CAST(l_orderkey AS HUGEINT) * 1000003 * 48000 + 22050) // 44100 AS ticks FROM lineitem")
def rational_rescale(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("v", F.col("l_orderkey") * 1000003)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pcm.rescaled("v", 44100, 48000).alias("ticks"))


@query("""SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events""")
def discontinuity_sessions(spark, sf):
    e = table(spark, sf, "events")
    return timeline.sessions(e, "user_id", ["ts", "event_id"], "event_type = 'error'").select("event_id", "user_id", "session")


# Integrity, tags, files


@query("""SELECT conv_id, count(*) AS packets, sum(strlen(text)) AS payload_bytes, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY ALL""")
def demux_summary(spark, sf):
    c = table(spark, sf, "conversations").withColumn("data", F.encode("text", "UTF-8"))
    return integrity.demux_summary(c, "conv_id", "turn", "data")


@query("""WITH a AS (SELECT doc_id, 'lang' AS k, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
e AS (SELECT doc_id, 'lang' AS k, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS value FROM documents UNION ALL SELECT doc_id, 'title', 'none' FROM documents WHERE doc_id % 50 = 0)
SELECT e.doc_id, e.k, e.value, a.value AS actual FROM e LEFT JOIN a ON a.doc_id = e.doc_id AND a.k = e.k WHERE e.value IS DISTINCT FROM a.value""")
def expected_actual_diff(spark, sf):
    d = table(spark, sf, "documents")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("value"))
    actual = d.select("doc_id", F.inline(F.array(pair("lang", F.col("lang")), pair("source", F.col("source")))))
    wanted = F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))
    expected = d.select("doc_id", F.explode(F.array(pair("lang", wanted), F.when(F.col("doc_id") % 50 == 0, pair("title", F.lit("none"))))).alias("p")).where("p is not null").select("doc_id", "p.k", "p.value")
    return integrity.differences(expected, actual, ["doc_id", "k"])


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN (n_chars >= 1000) = (quality = 1) THEN 'pass' WHEN quality = 1 THEN 'unexpected-accept' ELSE 'unexpected-reject' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def case_classify(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return integrity.classified(d.withColumn("e", F.col("n_chars") >= 1000).withColumn("a", F.col("quality") == 1), "e", "a").select("doc_id", "outcome")


_TAGS = """tags AS (SELECT user_id AS file_id, event_id AS ord, event_type AS tag_key, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS tag_value FROM events)"""


@query(f"""WITH {_TAGS}, o AS (SELECT file_id, tag_key, tag_value, min(ord) AS o, count(*) AS c FROM tags GROUP BY ALL)
SELECT file_id, tag_key, arg_min(tag_value, o) AS first_value, string_agg(tag_value, '|' ORDER BY o) AS all_values, CAST(sum(c) AS BIGINT) AS n FROM o GROUP BY ALL""")
def tag_rollup(spark, sf):
    t = table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("tag_key"), F.floor(F.col("value") / 50).cast("string").alias("tag_value"))
    return tags.rolled_up(t, "file_id", "ord", "tag_key", "tag_value")


@query("SELECT p_partkey, lower(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9]', '', 'g')) AS tag_key FROM part")
def normalize_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normalized_key(F.concat_ws("/", "p_name", "p_type")).alias("tag_key"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' 03/' || p_size WHEN 1 THEN p_size || '' WHEN 2 THEN 'x/' || p_size ELSE p_size || '/99999999999' END AS v FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(trim(split_part(v, '/', 1)), '[0-9]+') THEN CAST(trim(split_part(v, '/', 1)) AS BIGINT) END AS number,
 CASE WHEN regexp_full_match(trim(split_part(v, '/', 2)), '[0-9]+') AND CAST(trim(split_part(v, '/', 2)) AS BIGINT) <= 4294967295 THEN CAST(trim(split_part(v, '/', 2)) AS BIGINT) END AS total FROM v""")
def number_pair(spark, sf):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit(" 03/"), "p_size")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.concat(F.lit("x/"), "p_size")).otherwise(F.concat("p_size", F.lit("/99999999999")))
    number, total = text.number_pair(v)
    return table(spark, sf, "part").select("p_partkey", number.alias("number"), total.alias("total"))


@query("""SELECT event_id, CASE event_id % 14 WHEN 0 THEN 'ebml' WHEN 1 THEN 'ac3' WHEN 2 THEN 'mpeg-ps' WHEN 3 THEN 'riff' WHEN 4 THEN 'ogg' WHEN 5 THEN 'flac' WHEN 6 THEN 'mp4' WHEN 7 THEN 'id3' WHEN 8 THEN 'png' WHEN 9 THEN 'jpeg' WHEN 10 THEN 'gif' WHEN 11 THEN 'html' END AS kind FROM events""")
def magic_sniff(spark, sf):
    """Heads of all kinds, one of none, and one that is cut off."""
    heads = [f"{'00' * at}{magic}77" for _, at, magic in text.MAGIC] + ["7F454C46", "1A45"]
    e = table(spark, sf, "events").select("event_id", F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("event_id") % 14).cast("int"))).alias("data"))
    return e.select("event_id", text.sniffed(F.col("data")).alias("kind"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query("""SELECT lower(url) AS path, min(page_id) AS page_id FROM pages WHERE contains(lower(url), 'http') AND contains(lower(url), '/') GROUP BY ALL""")
def path_discovery(spark, sf):
    path = F.lower("url")
    found = table(spark, sf, "pages").where(path.contains("http") & path.contains("/"))
    return found.groupBy(path.alias("path")).agg(F.min("page_id").alias("page_id"))


@query(f"""WITH {SAMPLES}, {INTS}, s AS (SELECT event_id, i16, (CASE WHEN i16 < 0 THEN -i16 - 1 ELSE i16 END) >> 4 AS s FROM ints),
e AS (SELECT *, CASE WHEN s < 16 THEN 0 ELSE CAST(floor(log2(s)) AS INTEGER) - 3 END AS ex FROM s),
c AS (SELECT *, (s >> greatest(ex - 1, 0)) & 15 AS ma FROM e)
SELECT event_id, CAST(xor((CASE WHEN i16 < 0 THEN 0 ELSE 128 END) + ex * 16 + ma, 85) AS INTEGER) AS code,
 CAST((CASE WHEN i16 < 0 THEN -1 ELSE 1 END) * (CASE WHEN ex = 0 THEN ma * 16 + 8 ELSE (ma * 16 + 264) * CAST(pow(2, ex - 1) AS INTEGER) END) AS INTEGER) AS decoded FROM c""")
def alaw_roundtrip(spark, sf):
    coded = _ints(spark, sf).select("event_id", pcm.alaw_encoded(F.col("i16")).cast("int").alias("code"))
    return coded.select("event_id", "code", pcm.alaw_decoded(F.col("code")).cast("int").alias("decoded"))


@query(f"""WITH {SAMPLES}, n AS (SELECT stream_id, max(frame) + 1 AS n FROM samples GROUP BY ALL),
o AS (SELECT stream_id, unnest(range(0, (n * 160 + 146) // 147)) AS out_frame FROM n), p AS (SELECT *, out_frame * 147 // 160 AS pos, (out_frame * 147 % 160) / 160.0::DOUBLE AS rest FROM o),
t AS (SELECT p.stream_id, out_frame, x, rest - (frame - pos) AS d FROM p JOIN samples s ON s.stream_id = p.stream_id AND s.frame > p.pos - 17 AND s.frame < p.pos + 18)
SELECT stream_id, out_frame, round(sum(CASE WHEN abs(d) >= 16 THEN 0 ELSE x * (0.5 + 0.5 * cos(pi() * d / 16)) * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) END END), 6) AS x FROM t GROUP BY ALL""")
def sinc_resample(spark, sf):
    return resample.sinc_resampled(adapt.samples(spark, sf), "stream_id", 44100, 48000).withColumn("x", F.round("x", 6))


_LINES = "string_split(coalesce(text, ''), chr(10))"


@query(f"""WITH l AS (SELECT doc_id AS stream_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS frame FROM documents)
SELECT stream_id, frame, strlen(line) AS n_bytes, sha256(line) AS digest, CAST(NULL AS VARCHAR) AS error FROM l""")
def frame_stream_state(spark, sf):
    docs = table(spark, sf, "documents")
    streams = docs.select(F.col("doc_id").alias("stream_id"), framed.framed(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("data"))
    got = framed.frames_of(framed.chunks(streams, 1000))
    return got.select("stream_id", "frame", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"), "error")


@query("SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, 16 AS added, sha256(coalesce(text, '')) AS digest FROM documents")
def chacha_roundtrip(spark, sf):
    key = bytes(range(32))
    plain = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("plain"))
    hidden = plain.select("doc_id", F.octet_length("plain").alias("n"), sealing.sealed(key, F.col("plain"), F.col("doc_id")).alias("sealed"))
    back = hidden.select("doc_id", (F.octet_length("sealed") - F.col("n")).alias("added"), sealing.opened(key, F.col("sealed"), F.col("doc_id")).alias("plain"))
    return back.select("doc_id", F.octet_length("plain").cast("long").alias("n_bytes"), "added", F.sha2("plain", 256).alias("digest"))
