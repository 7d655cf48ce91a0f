"""Work that must grow no faster than the input: rows that operators put out, bytes that are carried, calls for each row."""

import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_containers import edited
from test_sources import caf_file

from framewright.functions import sealing
from framewright.operators import framed, selection
from framewright.sources import caf, mp4


def most(df, name):
    """The rows of a result, and the most of a count that an operator of its plan has."""
    execution = df._jdf.queryExecution()
    rows = execution.executedPlan().executeCollect()

    def plans(p):
        yield p
        for i in range(p.children().size()):
            yield from plans(p.children().apply(i))

    counts = [m.get().value() for p in plans(execution.executedPlan()) if (m := p.metrics().get(name)).isDefined()]
    return len(rows), max(counts)


@pytest.fixture
def plain_plans(spark):
    """Plans whose operators keep their counts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_reachable_makes_no_pairs_of_a_storage(plain_plans):
    spark = plain_plans
    storages = spark.range(1000).selectExpr("0L as storage", "id as package")
    packages = spark.createDataFrame([(1, 2), (1, 2), (3, 5000), (None, 2), (998, 999)], "source long, material long")
    got = selection.reachable(packages, storages, spark.createDataFrame([(0,), (0,), (7,)], "storage long"))
    assert sorted((r["source"] or 0, r["material"], r["reached"]) for r in got.collect()) == [(0, 2, False), (1, 2, True), (1, 2, True), (3, 5000, False), (998, 999, True)]
    n, made = most(got, "numOutputRows")
    assert n == 5 and made <= 1000


def test_edit_lists_of_many_files_come_together(plain_plans):
    good, bad = edited([(20, -1, 1 << 16), (50, 1000, 1 << 16)]), edited([(5, -1, 1 << 16)])
    k = F.col("id")
    files = plain_plans.range(0, 2000, 1, 1).select(k.cast("string").alias("path"), F.when(k % 100 == 0, F.lit(bad)).when(k % 100 == 1, F.lit(edited([]))).otherwise(F.lit(good)).alias("content"))
    got = mp4.edits_in(files)
    rows = got.collect()
    assert len(rows) == 20 + 2 * 1960 and sum(r["error"] == "edits without a place in the track" for r in rows) == 20
    assert sorted(tuple(r)[1:] for r in rows if r["path"] == "2") == [(7, 1, 882, -1, None), (7, 2, 2205, 1000, None)]
    # What comes back from Python: a batch for each file would have its own header of some hundred bytes.
    n, size = most(got, "pythonDataReceived")
    assert n == len(rows) and size < 100 * n


def test_flac_blocks_of_any_request_take_few_steps(spark):
    totals = [None, -5, 0, 31, 32, 33, 63, 64, 65, 1000, 1057, 4097, 32767, 65537, 99991, 740_005, 266_000_033, 232_792_560 + 5, (1 << 58) + 3]
    asked = [-1, 0, 31, 32, 33, 40, 63, 100, 500, 1031, 5000, 32767, 40000]
    rows = spark.createDataFrame([(t, r) for t in totals for r in asked], "t long, r int")
    fits = lambda t, r: max((n for n in range(32, min(32767, t, r) + 1) if t % n == 0 or t % n >= 32), default=None)
    got = rows.select("t", "r", selection.flac_block(F.col("t"), F.col("r")).alias("n")).collect()
    assert [x["n"] for x in got] == [None if x["t"] is None else fits(x["t"], x["r"]) for x in got]
    # All candidates of each of these would be a hundred and fifty million.
    many = spark.range(100000, 105000, 1, 1).select(selection.flac_block(F.col("id") * 37, F.lit(32767)).alias("n"))
    began = time.monotonic()
    assert many.where("n > 32000").count() == 5000
    assert time.monotonic() - began < 8


def test_caf_tables_are_read_together(spark, monkeypatch):
    good = caf_file(0, [3, 200, 20000], [3, 200, 20000], 2500, 100, 400)
    bad = [caf_file(0, [3, 4], [3, 5], 10, 0, 0), caf_file(0, [3, 4], [7], 10, 0, 0), caf_file(0, [7, 0], [7, 0], 10, 0, 0), caf_file(0, [3], [3], 2000, 0, 0), good[:40], caf_file(0, [1 << 20], [1 << 27], 10, 0, 0)]
    cut = good.replace(b"\x81\x9c\x20", b"\x81\x9c\xa0")
    other = [caf_file(8, [8, 8], [], 2048, 0, 0), caf_file(0, [], [], 0, 0, 0), cut]
    data = [good, *bad, *other, good, good]
    files = spark.createDataFrame([(str(i), d) for i, d in enumerate(data)], "path string, content binary").coalesce(1)
    for kept in (data, [d for d in data if d is not bad[-1]]):
        want = []
        for i, d in enumerate(data):
            try:
                want += [(str(i), *r) for r in caf.packets(d).values.tolist()] if d in kept else []
            except caf.CafError:
                pass
        got = caf.packets_in(files.where(F.col("path").isin([str(i) for i, d in enumerate(data) if d in kept])))
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 11
    calls = []
    monkeypatch.setattr(caf, "table_sizes", lambda body, own=caf.table_sizes: calls.append(1) or own(body))
    many = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: many.extend(run(iter([pa.record_batch({"path": ["a"] * 500, "content": [good] * 500})]))), raising=False)
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, run, schema: many.extend(run(iter([pd.DataFrame({"path": ["a"] * 500, "content": [good] * 500})]))), raising=False)
    caf.packets_in(files)
    assert sum(map(len, many)) == 500 * 3 if isinstance(many[0], pd.DataFrame) else sum(b.num_rows for b in many) == 500 * 3
    assert len(calls) == 1


def test_frames_of_many_streams_come_together(plain_plans):
    frame = lambda *payloads: b"".join(len(p).to_bytes(4, "big") + p for p in payloads)
    streams = {None: frame(b"of none"), 1: frame(b"a", b"", b"x" * 90000), 2: frame(b"ab") + b"\0\0\0\5ab", 3: b"\xff\0\0\0zz" + frame(b"z"), 4: b""} | {i: frame(b"%d" % i) for i in range(10, 2010)}
    rows = plain_plans.createDataFrame(list(streams.items()), "stream_id long, data binary")
    pieces = framed.chunks(rows, 7)
    got = framed.frames_of(pieces)
    found = {(r["stream_id"], r["frame"]): (r["payload"], r["error"]) for r in got.collect()}
    assert found.pop((None, 0)) == (b"of none", None) and [found.pop((1, i)) for i in range(3)] == [(b"a", None), (b"", None), (b"x" * 90000, None)]
    assert found.pop((2, 0)) == (b"ab", None) and found.pop((2, 1)) == (None, "6 bytes of a frame that has no end") and found.pop((3, 0)) == (None, "a frame of 4278190080 bytes")
    assert found == {(i, 0): (b"%d" % i, None) for i in range(10, 2010)}
    n, size = most(framed.frames_of(pieces.where("stream_id >= 10")), "pythonDataReceived")
    assert n == 2000 and size < 100 * n


def test_payloads_are_sealed_and_opened_a_slice_at_a_time(monkeypatch):
    plain = [None if i % 7 == 0 else bytes([i]) * (i * 8000) for i in range(120)]
    work = []
    for name in ("pandas_udf", "arrow_udf"):
        monkeypatch.setattr(sealing.F, name, lambda *_: lambda f: work.append(f) or (lambda *columns: columns[0]))
    for column in (sealing.sealed, sealing.opened):
        column(bytes(32), F.lit(b""), F.lit(1))
    at = pa.array(range(120), pa.int64())
    hidden = list(work[0](iter([(pa.array(plain, pa.binary()), at)])))
    back = list(work[1](iter([(pa.concat_arrays(hidden), at)])))
    assert pa.concat_arrays(back).to_pylist() == plain and sum(map(len, hidden)) == 120
    assert sum(len(p or b"") for p in plain) > 10 * sealing.SLICE and max(p.nbytes for p in hidden + back) < 2 * sealing.SLICE
