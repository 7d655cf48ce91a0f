"""Mixing sources to target weights, by fixed-length blocks and multinomial draws.

The words of a source, its documents in hashed order, are cut into blocks of equal length. Each output shard draws
how many blocks it takes from every source; the draws of a source are numbered, and a keyed permutation of its
blocks, gone through again once it is used up, says which block a number means. Blocks and numbers meet in an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import materialize, rows_apart, text_slices, utf8_rows

BLOCK, SEED = 64, 20_240_229
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Slots of an output shard, and the most shards that there are; beyond that shards grow.
SHARD_SLOTS, MOST_SHARDS = 4096, 1 << 20
#: Sources beyond which the driver refuses to plan.
MOST_SOURCES = 50_000
#: Documents that share a bucket, within which offsets are summed in order.
BUCKET = 4096
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    """What the driver decides for each source, all arrays by the number of the source."""

    sources: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last_words: np.ndarray
    shards: int


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Divide share of all sizes by weight; none gets more than most times its own, the excess goes to the others."""
    out, limit = np.zeros(len(sizes)), most * sizes.astype(float)
    free, left = sizes > 0, share * float(sizes.sum())
    while free.any() and left > 0:
        give = np.where(free, weights, 0) * left / weights[free].sum()
        over = free & (give >= limit)
        if not over.any():
            return np.where(free, give, out)
        out[over] = limit[over]
        left -= limit[over].sum()
        free &= ~over
    return out


def _round(right: np.ndarray, r: int, key: np.ndarray) -> np.ndarray:
    x = (right + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, at index: four Feistel rounds, walked until within n. back: its inverse."""
    index, n = index.astype(np.uint64), np.broadcast_to(n, index.shape).astype(np.uint64)
    key = np.broadcast_to(key, index.shape).astype(np.uint64)
    half = np.ones(len(index), np.uint64)
    while (small := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[small] += np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for r in range(4):
            if back:
                left, right = right ^ (_round(left, 3 - r, k) & mask), left
            else:
                left, right = right, left ^ (_round(right, r, k) & mask)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def source_keys(sources: list[str | None], seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(b"\xff" if s is None else s.encode(), seed) for s in sources], np.uint64)


def drawn(slots: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """`take` of the slots, so many of each source: multinomial draws by what each has left, so that none gives more."""
    got = np.zeros_like(slots)
    while take > 0:
        room = slots - got
        more = np.minimum(rng.multinomial(take, room / room.sum()), room)
        got += more
        take -= int(more.sum())
    return got


def shard_slots(slots: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For one output shard, the first slot of each source and how many it has.

    All slots are divided in two by a draw, each half again, down to single shards; a seed for each division makes
    any task find its shards alone, in a number of draws that is logarithmic in the shards. Sums are kept.
    """
    low, high, first, left = 0, shards, np.zeros(len(slots), np.int64), slots.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        part = drawn(left, int(left.sum()) * (middle - low) // (high - low), np.random.default_rng([seed, low, high]))
        if shard < middle:
            left, high = part, middle
        else:
            first, left, low = first + part, left - part, middle
    return first, left


def plan(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, block: int = BLOCK, seed: int = SEED, share: float = SHARE, most: float = MOST) -> Plan:
    """Targets and draws. Without weights, sources by code point, null last, weigh 5, 2, 1, repeating."""
    sources: list[str | None] = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    sources += [None] if None in sizes else []
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"{len(sources)} sources; the mix is planned on the driver for at most {MOST_SOURCES}")
    size = np.array([sizes[s] for s in sources], np.int64)
    weight = np.array([WEIGHTS[i % len(WEIGHTS)] if weights is None else weights[s] for i, s in enumerate(sources)], float)
    want = targets(size, weight, share, most)
    words = np.minimum(np.rint(want).astype(np.int64), (most * size).astype(np.int64))
    blocks = -(-size // block)
    slots, last = np.zeros_like(size), np.zeros_like(size)
    keys = source_keys(sources, seed)
    for i, (n, target) in enumerate(zip(blocks.tolist(), words.tolist(), strict=True)):
        if not n or not target:
            continue
        epochs, rest = divmod(target, int(size[i]))
        # The shorter last block of a source stands somewhere in the permuted order.
        tail, order = int(size[i]) - (n - 1) * block, 0
        if rest:
            order = int(permuted(np.array([n - 1]), np.array(n), keys[i : i + 1], back=True)[0])
            before = order * block
            if rest <= before:
                whole, part = divmod(rest, block)
            elif rest <= before + tail:
                whole, part = order, rest - before
                whole, part = (order + 1, 0) if part == tail else (order, part)
            else:
                whole, part = divmod(rest - before - tail, block)
                whole += order + 1
            slots[i], last[i] = epochs * n + whole + (part > 0), part
        else:
            slots[i] = epochs * n
    shards = int(min(MOST_SHARDS, max(1, -(-int(slots.sum()) // SHARD_SLOTS))))
    return Plan(sources, size, want, blocks, slots, last, shards)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words and a hash of each whole text; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sizes = [len(t.split()) for t in utf8_rows(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source"), pa.array(sizes, pa.int64()), part.column("h")], ["doc_id", "source", "size", "h"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text, F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, source string, size long, h long")


def _numbered(spark, p: Plan) -> DataFrame:
    rows = pd.DataFrame({"source": pd.Series(p.sources, dtype=object), "no": np.arange(len(p.sources)), "source_size": p.sizes, "target": p.targets})
    return spark.createDataFrame(rows, "source string, no int, source_size long, target double")


def pieces(rows: DataFrame, p: Plan, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, no, block, at, start, n): which words of each document, from start, stand where in which block of its source.

    Offsets are sums of sums: of hashed buckets of a source, then of documents within a bucket, so no task goes
    through a whole source. Documents without an id are dealt by their rows too, as there may be any number of copies.
    """
    spark = rows.sparkSession
    buckets = max(1, -(-rows.count() // BUCKET))
    numbered = F.broadcast(_numbered(spark, p).select(F.col("source").alias("__fw_source"), "no"))
    salt = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.lit(0).cast("long"))
    placed = rows.where("size > 0").join(numbered, F.col("source").eqNullSafe(F.col("__fw_source"))).select("row", "doc_id", "h", "no", "size", F.pmod(F.xxhash64("doc_id", "h", salt), F.lit(buckets)).alias("bucket"))
    sums = placed.groupBy("no", "bucket").agg(F.sum("size").alias("words"))
    base = sums.select("no", "bucket", (F.sum("words").over(Window.partitionBy("no").orderBy("bucket")) - F.col("words")).alias("base"))
    order = Window.partitionBy("no", "bucket").orderBy("doc_id", "h", "row").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("upto", F.sum("size").over(order))
    spans = inner.join(base, ["no", "bucket"]).withColumn("first", F.col("base") + F.col("upto") - F.col("size"))
    last = F.expr(f"(first + size - 1) div {block}")
    cut = spans.select("row", "doc_id", "no", "size", "first", F.explode(F.sequence(F.expr(f"first div {block}"), last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("first"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("first"))
    return cut.select("row", "doc_id", "no", "block", (F.greatest(F.lit(0), F.col("first") - F.col("block") * block)).alias("at"), start.alias("start"), (end - start).alias("n"))


def slots(spark, p: Plan, seed: int = SEED) -> DataFrame:
    """(shard, no, slot, epoch, block, words): every slot of the mix and the block that it takes; words null: the whole block."""
    keys, sizes = source_keys(p.sources, seed), p.blocks
    total, part, shards = p.slots, p.last_words, p.shards

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"].tolist():
                first, own = shard_slots(total, shards, shard, seed)
                ends = np.cumsum(own)
                for a in range(0, int(own.sum()), 1 << 18):
                    k = np.arange(a, min(int(own.sum()), a + (1 << 18)))
                    no = np.searchsorted(ends, k, "right")
                    at = first[no] + k - (ends - own)[no]
                    block = permuted(at % sizes[no], sizes[no], keys[no])
                    words = np.where((at == total[no] - 1) & (part[no] > 0), part[no], -1)
                    yield pd.DataFrame({"shard": shard, "no": no.astype(np.int32), "slot": at, "epoch": at // sizes[no], "block": block, "words": words})

    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInPandas(run, "shard long, no int, slot long, epoch long, block long, words long")


def mixed(rows: DataFrame, p: Plan, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, no, slot, epoch, row, doc_id, start, n): the words of documents that every slot of the mix takes."""
    # Spark takes the slots for as few as the shards that they are made from; merged, they are not gathered on the driver.
    joined = pieces(rows, p, block).join(slots(rows.sparkSession, p, seed).hint("merge"), ["no", "block"])
    n = F.when(F.col("words") < 0, F.col("n")).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.col("words") - F.col("at"))))
    return joined.select("shard", "no", "slot", "epoch", "row", "doc_id", "start", n.alias("n")).where("n > 0")


def prepared(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: dict[str | None, float] | None = None) -> tuple[DataFrame, Plan]:
    # Written, so that the numbers of the rows hold.
    rows = materialize(word_counts(docs).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()}
    return rows, plan(sizes, weights, block, seed)


def mix_report(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target (its source's), taken (words, repeats counted).

    The words taken of a source are its target, rounded; no document gives more than twice its size. The result
    depends on the rows and the seed alone, but for copies that share an id or have none, which may change places.
    A document without words has size and taken 0; rows that share a doc_id are documents of their own; an empty
    table gives no rows.
    """
    rows, p = prepared(docs, block, seed)
    got = mixed(rows, p, block, seed).groupBy("row").agg(F.sum("n").alias("got"))
    numbered = F.broadcast(_numbered(docs.sparkSession, p).select(F.col("source").alias("__fw_source"), "source_size", "target"))
    known = rows.join(numbered, F.col("source").eqNullSafe(F.col("__fw_source")))
    return known.join(got, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0).cast("long")).alias("taken"))


@rows_apart
def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The mix as documents with the columns of docs: for each time that it goes through a source, a row of each of its documents that it takes words of.

    Such a row has the words taken, runs of them as they stand in the text and parted by a line feed, and n_chars,
    where there is one, to match; other columns stay. Documents without words are not in a mix. Rows that share a
    doc_id, nulls among them, are documents of their own; an empty table gives no rows.
    """
    rows, p = prepared(docs, block, seed, weights)
    runs = mixed(rows, p, block, seed).groupBy("doc_id", "epoch").agg(F.collect_list(F.struct("start", "n")).alias("__fw_runs")).withColumnRenamed("doc_id", "__fw_id").drop("epoch")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts, names = [], batch.schema.names[:-1]
            for text, taken in zip(batch.column("text").to_pylist(), batch.column("__fw_runs").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, n in sorted((r["start"], r["n"]) for r in taken):
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = a + n
                    else:
                        spans.append([a, a + n])
                at = [m.span() for m in word.finditer(text or "")]
                spans = [[a, min(b, len(at))] for a, b in spans if a < len(at)]
                texts.append("\n".join((text or "")[at[a][0] : at[b - 1][1]] for a, b in spans))
            columns = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in names], names)

    both = docs.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__fw_id"))).drop("__fw_id")
    return both.mapInArrow(cut, docs.schema)
