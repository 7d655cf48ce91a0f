"""Queries that choose among rows of tables, and of values that tables and codecs are reckoned with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import quality, selection, timeline
from framewright.plans import adapt
from framewright.plans.adapt import INDEX, ORDER, PAIRS, SAMPLES, table
from framewright.plans.registry import query


@query("""WITH e AS (SELECT l_orderkey AS stream, (l_partkey + l_linenumber) % 4 AS program, l_partkey % 8192 AS pid FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY program, pid) AS n FROM e WHERE program <> 0)
SELECT stream, program, pid FROM o WHERE n = 1""")
def pat_selection(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stream"), ((F.col("l_partkey") + F.col("l_linenumber")) % 4).alias("program"), (F.col("l_partkey") % 8192).alias("pid"))
    return selection.first_programme(e, "stream")


_TYPES = "CASE l_partkey % 11 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 15 WHEN 3 THEN 17 WHEN 4 THEN 128 WHEN 5 THEN 129 WHEN 6 THEN 130 WHEN 7 THEN 135 WHEN 8 THEN 27 WHEN 9 THEN 2 ELSE 36 END"


@query(f"""WITH e AS (SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS pos, l_suppkey AS pid, {_TYPES} AS t FROM lineitem),
k AS (SELECT *, CASE WHEN t IN (3, 4) THEN 'mpeg-audio' WHEN t IN (15, 17) THEN 'aac' WHEN t = 128 THEN 'pcm' WHEN t IN (129, 135) THEN 'ac3' WHEN t = 130 THEN 'dts' END AS codec FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pos) AS n FROM k WHERE codec IS NOT NULL) SELECT stream, pos, pid, codec FROM o WHERE n = 1""")
def pmt_selection(spark, sf):
    """The first stream of a programme whose type is known, in the order of its table."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    kind = F.get(F.array(*map(F.lit, [3, 4, 15, 17, 128, 129, 130, 135, 27, 2, 36])), (F.col("l_partkey") % 11).cast("int")).cast("long")
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stream"), pos.alias("pos"), F.col("l_suppkey").alias("pid"), kind.alias("stream_type"))
    return selection.first_stream(e, "stream", "pos")


@query("SELECT o_custkey AS file_id, min(o_orderkey) AS track_id, arg_min(o_orderpriority, o_orderkey) AS codec FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY ALL")
def first_supported_track(spark, sf):
    """Of each file the first track of a kind whose codec is known."""
    tracks = table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("track_id"), F.col("o_orderpriority").alias("codec"), F.col("o_orderstatus").alias("kind"))
    good = (F.col("kind") == "F") & F.col("codec").isin("1-URGENT", "3-MEDIUM")
    return selection.first_of_kind(tracks, "file_id", ["track_id"], good).select("file_id", "track_id", "codec")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS config FROM events GROUP BY ALL")
def config_once(spark, sf):
    """A stream's configuration, told with its first packet alone."""
    e = table(spark, sf, "events")
    return selection.first_of_kind(e, "user_id", ["event_id"], F.lit(True)).select("user_id", "event_id", F.col("event_type").alias("config"))


@query("SELECT o_custkey % 97 AS number, max(o_orderkey) AS track_id, arg_max(o_orderstatus, o_orderkey) AS kind FROM orders GROUP BY ALL")
def latest_track(spark, sf):
    """Of the tracks that share a number, the last that was told."""
    tracks = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("number"), F.col("o_orderkey").alias("track_id"), F.col("o_orderstatus").alias("kind"))
    return selection.latest(tracks, "number", "track_id")


_REFS = """p AS (SELECT c_custkey AS package, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 50 END AS r, (c_custkey * 7) % 60 AS d FROM customer), m AS (SELECT s_suppkey % 50 AS multiple, (s_suppkey * 3) % 60 AS sub FROM supplier)"""


@query(f"WITH {_REFS} SELECT package, d AS descriptor, coalesce(r IS NULL OR r = d OR EXISTS (SELECT 1 FROM m WHERE m.multiple = p.r AND m.sub = p.d), false) AS refers FROM p")
def package_references_descriptor(spark, sf):
    c = F.col("c_custkey")
    pairs = table(spark, sf, "customer").select(c.alias("package"), F.when(c % 5 != 0, c % 50).alias("descriptor_ref"), (c * 7 % 60).alias("descriptor"))
    lists = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("multiple"), (F.col("s_suppkey") * 3 % 60).alias("subdescriptor"))
    return selection.references_descriptor(pairs, lists).select("package", "descriptor", "refers")


_STORES = "s AS (SELECT DISTINCT s_nationkey AS storage, s_suppkey AS package FROM supplier), f AS (SELECT n_nationkey AS storage FROM nation WHERE n_regionkey < 3), h AS (SELECT s.* FROM s JOIN f USING (storage))"


@query(f"""WITH {_STORES}, p AS (SELECT DISTINCT l_suppkey AS source, l_suppkey % 7 + 1 AS material FROM lineitem)
SELECT source, material, EXISTS (SELECT 1 FROM h a JOIN h b ON a.storage = b.storage WHERE a.package = p.source AND b.package = p.material) AS reached, true AS reached_alone FROM p""")
def package_reachability(spark, sf):
    """Packages that a preface's storage holds together; where there is no preface and no storage, all are reached."""
    storages = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("storage"), F.col("s_suppkey").alias("package"))
    prefaces = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("storage"))
    packages = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_suppkey") % 7 + 1).alias("material")).distinct()
    alone = selection.reachable(packages, storages.where("false"), prefaces.where("false")).withColumnRenamed("reached", "reached_alone")
    return selection.reachable(alone, storages, prefaces)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name AS label FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 > 0""")
def primer_lookup(spark, sf):
    """Labels of local tags by a primer; a tag that it lacks has none."""
    primer = table(spark, sf, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("label"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(primer, "l_suppkey", "left")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O'")
def block_track_join(spark, sf):
    """Blocks with their tracks; blocks of tracks that are not known are dropped."""
    tracks = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("kind"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(tracks, "l_orderkey")


@query(f"WITH {INDEX}, o AS (SELECT track_id, sample_id, (track_id * 7919 + sample_id * 104729) % 1000003 AS place FROM idx) SELECT place, track_id, sample_id FROM o ORDER BY place, track_id, sample_id LIMIT 500")
def packets_by_offset(spark, sf):
    """The first packets of a file by their place in it, not by their times."""
    index = timeline.sample_index(adapt.raw_samples(spark, sf), "track_id", ORDER, 2)
    at = (F.col("track_id") * 7919 + F.col("sample_id") * 104729) % 1000003
    return index.select(at.alias("place"), "track_id", "sample_id").orderBy("place", "track_id", "sample_id").limit(500)


@query(f"""WITH {SAMPLES}, {PAIRS}, t AS (SELECT stream_id, frame // 8 AS tile, round(sqrt(avg((ref-cand)*(ref-cand))), 9) AS rmse, round(max(abs(ref-cand)), 9) AS max_abs FROM pairs GROUP BY ALL) SELECT * FROM t ORDER BY rmse DESC, max_abs DESC, stream_id, tile LIMIT 40""")
def worst_tiles(spark, sf):
    from framewright.plans.catalog import _pairs

    t = quality.tile_errors(_pairs(spark, sf), 8, "stream_id").withColumns({"rmse": F.round("rmse", 9), "max_abs": F.round("max_abs", 9)})
    return quality.hotspots(t, 40, "stream_id", "tile").select("stream_id", "tile", "rmse", "max_abs")


@query("""WITH r AS (SELECT l_orderkey AS package, l_linenumber, l_partkey, l_suppkey, l_partkey % 60 + 1 AS num, l_linenumber AS den FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY num / den::DOUBLE, den, num) AS n FROM r) SELECT package, num, den FROM o WHERE n = 1""")
def least_edit_rate(spark, sf):
    """The slowest edit rate of a package's tracks."""
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("package"), (F.col("l_partkey") % 60 + 1).alias("num"), F.col("l_linenumber").alias("den"))
    least = r.groupBy("package").agg(F.min(F.struct((F.col("num") / F.col("den")).alias("rate"), "den", "num")).alias("least"))
    return least.select("package", "least.num", "least.den")


@query("""WITH p AS (SELECT event_id, user_id, (event_id * 900000000) % 8589934592 AS pts FROM events), l AS (SELECT *, lag(pts) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM p), e AS (SELECT *, sum(CASE WHEN q - pts > 4294967296 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) * 8589934592 AS epoch FROM l)
SELECT event_id, (pts + 8589934592 - 3003) % 8589934592 + epoch AS dts FROM e""")
def dts_unwrap(spark, sf):
    """Decoding stamps take the epoch of the presentation stamps beside them."""
    p = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") * F.lit(900000000).cast("long") % F.lit(1 << 33)).alias("pts"))
    got = timeline.pts_unwrapped(p, "user_id", "event_id", "pts")
    return got.select("event_id", ((F.col("pts") + F.lit((1 << 33) - 3003)) % F.lit(1 << 33) + F.col("unwrapped") - F.col("pts")).alias("dts"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_orderkey * 1000000.0::DOUBLE * 1.5) AS BIGINT) AS ns, (l_orderkey * 48000 + 500) // 1000 AS samples,
 CASE WHEN (CAST(l_orderkey AS HUGEINT) * 48000 * 1001) % (l_linenumber * 1000) = 0 THEN CAST((CAST(l_orderkey AS HUGEINT) * 48000 * 1001) // (l_linenumber * 1000) AS BIGINT) END AS edit_ticks FROM lineitem""")
def clock_scales(spark, sf):
    """Ticks as nanoseconds, milliseconds as samples, and edit units that must come out whole."""
    v = F.col("l_orderkey")
    ticks = selection.integral_units(v, F.col("l_linenumber").cast("long") * 1000, F.lit(1001), F.lit(48000))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(v * F.lit(1000000.0) * F.lit(1.5)).cast("long").alias("ns"), F.expr("(l_orderkey * 48000 + 500) div 1000").alias("samples"), ticks.alias("edit_ticks"))


@query("""WITH t AS (SELECT p_partkey, p_partkey * 37 AS total, p_size * 100 AS requested FROM part) SELECT p_partkey, list_max(list_filter(range(32, greatest(32, least(32767, total, requested)) + 1), lambda n: total % n = 0 OR total % n >= 32)) AS block FROM t WHERE least(32767, total, requested) >= 32
UNION ALL SELECT p_partkey, NULL FROM t WHERE least(32767, total, requested) < 32""")
def flac_block_size(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 37).alias("total"), (F.col("p_size") * 100).alias("requested"))
    return p.select("p_partkey", selection.flac_block(F.col("total"), F.col("requested")).cast("long").alias("block"))


@query("""WITH q AS (SELECT event_id, event_id % 200 - 100 AS q, event_id % 60 + 70 AS sf, value AS r FROM events) SELECT event_id, round(sign(q) * pow(abs(q), 4.0::DOUBLE / 3) * pow(2.0::DOUBLE, (sf - 100) / 4.0), 6) AS x, round(q + r, 9) AS l, round(q - r, 9) AS r FROM q""")
def spectral_values(spark, sf):
    """Dequantised spectral values, and mid and side as left and right."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 200 - 100).alias("q"), (F.col("event_id") % 60 + 70).alias("scale"), "value")
    x = F.signum("q") * F.pow(F.abs("q").cast("double"), F.lit(4.0 / 3)) * F.pow(F.lit(2.0), (F.col("scale") - 100) / 4.0)
    return e.select("event_id", F.round(x, 6).alias("x"), F.round(F.col("q") + F.col("value"), 9).alias("l"), F.round(F.col("q") - F.col("value"), 9).alias("r"))


@query(f"""WITH {SAMPLES}, {PAIRS}, c AS (SELECT stream_id, count(*) AS n, sqrt(avg((ref-cand)*(ref-cand))) AS rmse, avg(abs(ref-cand)) AS mae, max(abs(ref-cand)) AS most, sum(ref*ref) AS s, sum((ref-cand)*(ref-cand)) AS z FROM pairs GROUP BY ALL)
SELECT stream_id, stream_id % 4 = 0 AND rmse <= 0.005 AND mae <= 0.001 AND most <= 0.5 AND (z = 0 OR 10 * log10(s / z) >= 35) AS passes FROM c""")
def quality_gate(spark, sf):
    from framewright.plans.catalog import _pairs

    q = quality.compared(_pairs(spark, sf), "stream_id")
    return q.select("stream_id", selection.passes(F.col("stream_id") % 4, F.col("rmse"), F.col("mean_abs"), F.col("max_abs"), F.col("snr_db")).alias("passes"))


@query("""WITH p AS (SELECT conv_id, turn, strlen(text) AS n FROM conversations), o AS (SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS place FROM p)
SELECT conv_id, count(*) AS packets, string_agg(format('{:02X}{:02X}{:02X}{:02X}', place & 255, (place >> 8) & 255, (place >> 16) & 255, (place >> 24) & 255), '' ORDER BY turn) AS offsets, CAST(4 + 4 * count(*) + sum(n) AS BIGINT) AS size FROM o GROUP BY ALL""")
def packed_offset_index(spark, sf):
    """A count, an offset for each packet, and the packets, in one block."""
    from framewright.functions.octets import octets

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data")).withColumn("n", F.octet_length("data"))
    at = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("n")
    rows = c.withColumn("at", at).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "at", "data"))).alias("rows"))
    block = F.concat(octets(F.size("rows"), 4, True), F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(octets(r["at"], 4, True))), "")), F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["data"])), "")))
    made = rows.select("conv_id", F.size("rows").cast("long").alias("packets"), block.alias("block"))
    return made.select("conv_id", "packets", F.expr("hex(substring(block, 5, cast(4 * packets as int)))").alias("offsets"), F.octet_length("block").cast("long").alias("size"))


@query("""SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS accepted, count(*) FILTER (event_id % 3 = 1) AS rejected, count(*) FILTER (event_id % 3 = 2) AS skipped, round(avg(value) FILTER (event_id % 2 = 0) / avg(value) FILTER (event_id % 2 = 1), 9) AS ratio FROM events GROUP BY ALL""")
def sweep_counts(spark, sf):
    """Outcomes of a sweep by kind, and the ratio of two mean times."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 3
    return e.groupBy("event_type").agg(F.count_if(k == 0).alias("accepted"), F.count_if(k == 1).alias("rejected"), F.count_if(k == 2).alias("skipped"), F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))), 9).alias("ratio"))
