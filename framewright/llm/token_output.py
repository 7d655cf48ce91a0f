"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode independently.

A segment holds the ids of some documents in order. Layout, little endian: magic, ids, documents, ids of a block,
bytes of the bit string (unsigned 32-bit each), ids of each document (32-bit), bit offset of each block (64-bit),
CRC-32 of the bit string, the bit string, most significant bit first. The code stands beside the segments, as one of
number -1: magic, the greatest length of a code (a byte), and a byte for each id, its code's length, compressed by zlib.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import shared_dir
from framewright.llm.tokens import END, id_type, token_table

MAGIC, CODE_MAGIC, BLOCK = b"FWH1", b"FWHC", 256
#: Bits of the longest code, unless there are more ids than that can tell apart, and what the reader can look up at most.
LIMIT, MOST_BITS = 16, 25
#: Ids of a segment; a longer document has one of its own. Files at most.
SEGMENT_IDS, MOST_FILES = 1 << 18, 1 << 15


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # At each level, coins and packages by weight; a mark says which are coins.
    marks, items = [], weight
    is_coin = np.ones(len(weight), bool)
    for _ in range(limit - 1):
        marks.append(is_coin)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        items, is_coin = both[by], by < len(weight)
    marks.append(is_coin)
    lengths, take = np.zeros(len(weight), np.int64), 2 * len(weight) - 2
    for mark in reversed(marks):
        coins = int(mark[:take].sum())
        lengths[:coins] += 1
        take = 2 * (take - coins)
    out[order] = lengths
    return out


def limit_for(used: int) -> int:
    """Bits of the longest code for so many ids."""
    limit = max(LIMIT, (max(used, 1) - 1).bit_length())
    if limit > MOST_BITS:
        raise ValueError(f"{used} ids need codes of more than {MOST_BITS} bits")
    return limit


def write_code(lengths: np.ndarray, limit: int) -> bytes:
    return CODE_MAGIC + bytes([limit]) + zlib.compress(lengths.astype(np.uint8).tobytes())


def read_code(data: bytes) -> tuple[np.ndarray, int]:
    """Length of each id's code and the greatest that there may be."""
    if data[:4] != CODE_MAGIC:
        raise ValueError("not a code of token ids")
    return np.frombuffer(zlib.decompress(data[5:]), np.uint8), data[4]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.uint64)
    limit = int(size.max()) if len(size) else 0
    steps = np.uint64(1) << (np.uint64(limit) - size)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = ((np.cumsum(steps) - steps) >> (np.uint64(limit) - size)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length by the next `limit` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    ids[: spans.sum()], sizes[: spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit string of ids and the bit offset of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(size)
    at = ends - size
    # Each code reaches into two 32-bit words at most.
    word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    sums = np.bitwise_or.reduceat(value, first)
    words = np.zeros(int(ends[-1] + 63) // 32 + 1, np.uint32)
    words[word[first]] |= (sums >> np.uint64(32)).astype(np.uint32)
    words[word[first] + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::block].astype(np.uint64)


def decode_ids(bits: bytes, n: int, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK, limit: int = LIMIT) -> np.ndarray:
    """n ids; every block is read from its own checkpoint, all blocks a code at a time together."""
    ids, sizes = table
    raw = np.frombuffer(bits + bytes(5), np.uint8)
    last = len(raw) - 5
    out = np.zeros((len(offsets), block), np.uint32)
    at, tail = offsets.astype(np.int64).copy(), n - (len(offsets) - 1) * block
    for k in range(block if len(offsets) > 1 else max(tail, 0)):
        rows = len(offsets) if k < tail else len(offsets) - 1
        p = np.minimum(at[:rows] >> 3, last)
        four = raw[p].astype(np.uint32) << 24 | raw[p + 1].astype(np.uint32) << 16 | raw[p + 2].astype(np.uint32) << 8 | raw[p + 3]
        peek = four >> (32 - limit - (at[:rows] & 7)).astype(np.uint32) & ((1 << limit) - 1)
        out[:rows, k] = ids[peek]
        at[:rows] += sizes[peek]
    return out.ravel()[:n]


def write_segment(documents: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    bits, offsets = encode_ids(ids, lengths, codes, block)
    head = MAGIC + struct.pack("<4I", len(ids), len(documents), block, len(bits))
    return b"".join([head, np.array([len(d) for d in documents], "<u4").tobytes(), offsets.astype("<u8").tobytes(), struct.pack("<I", zlib.crc32(bits)), bits])


def read_segment(data: bytes, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> list[np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a token-id segment")
    n, documents, block, size = struct.unpack_from("<4I", data, 4)
    at = 20
    counts = np.frombuffer(data, "<u4", documents, at)
    at += 4 * documents
    blocks = -(-n // block)
    offsets = np.frombuffer(data, "<u8", blocks, at)
    at += 8 * blocks
    bits = data[at + 4 : at + 4 + size]
    if len(bits) != size or zlib.crc32(bits) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("a token-id segment is damaged")
    return np.split(decode_ids(bits, n, offsets, table, block, limit), np.cumsum(counts.astype(np.int64))[:-1]) if documents else []


def id_counts(table: DataFrame, dtype: str) -> DataFrame:
    """(id, n): how often each id occurs in all of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                ids = np.frombuffer(b"".join(unpack.decompress(x) for x in batch.column("ids").slice(i, 1024).to_pylist()), dtype)
                got = np.bincount(ids, minlength=len(total))
                total = got + np.pad(total, (0, len(got) - len(total)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    return table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str | None = None, end: int = END, folder: str | None = None) -> str:
    """The folder of a table of segments (file, seq, doc_ids, n_ids, segment) of all ids by ascending doc_id, null first, with their code.

    Files are the ranges of doc_id that tasks sort and write; each has its segments in order. They are rows of a
    table, in the shared folder where no other is given, so that any store that Spark writes to can hold them. Rows
    that share a doc_id stand in the order of hashes of their ids, repeated rows in any. Null texts have the end id
    alone; an empty table gives a code and no segments.
    """
    table = token_table(docs, path, end)
    dtype = id_type(path)
    counted = id_counts(table, dtype).collect()  # at most the vocabulary
    counts = np.zeros(max([0, *(r["id"] for r in counted)]) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    limit = limit_for(int((counts > 0).sum()))
    lengths = code_lengths(counts, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, seq, codes, unpack = TaskContext.get().partitionId(), 0, canonical(lengths), zstandard.ZstdDecompressor()
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([seq], pa.int32()), pa.array([list(keys)], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([write_segment(held, lengths, codes)], pa.binary())], ["file", "seq", "doc_ids", "n_ids", "segment"])

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(unpack.decompress(raw), dtype)
                if held and size + len(ids) > SEGMENT_IDS:
                    yield out()
                    seq, size = seq + 1, 0
                    held.clear()
                    keys.clear()
                held.append(ids)
                keys.append(doc)
                size += len(ids)
        if held:
            yield out()

    spark = docs.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_FILES))
    # The last keys part rows that share a doc_id, so that no id, nor null, fills a task.
    order = ["doc_id", F.xxhash64("ids"), "part", "source", "before"]
    ordered = table.select("doc_id", "ids", "part", "source", "before").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "file int, seq int, doc_ids array<long>, n_ids long, segment binary"
    segments = ordered.select("doc_id", "ids").mapInArrow(run, schema)
    code = spark.createDataFrame([(-1, 0, [], 0, bytearray(write_code(lengths, limit)))], schema)
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    segments.unionByName(code).write.parquet(folder)
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files in a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    table = spark.read.parquet(folder)
    lengths, limit = read_code(bytes(table.where("file = -1").select("segment").first()["segment"]))
    files = table.where("file >= 0")
    order = Window.partitionBy("file").orderBy("seq")
    index = files.select("file", "seq", "n_ids").withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))
    sums = {r["file"]: r["n"] for r in files.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}  # at most MOST_FILES
    ordered = sorted(sums)
    base = dict(zip(ordered, (np.cumsum([sums[f] for f in ordered]) - np.array([sums[f] for f in ordered])).tolist() if ordered else [], strict=True))
    bases = spark.createDataFrame(pd.DataFrame({"file": pd.Series(list(base), dtype="int32"), "base": pd.Series(list(base.values()), dtype="int64")}), "file int, base long")
    starts = index.join(F.broadcast(bases), "file").select("file", "seq", (F.col("before") + F.col("base")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decode_table(lengths, limit)
        for batch in batches:
            for file, seq, keys, data in zip(*(batch.column(c) for c in ("file", "seq", "doc_ids", "segment")), strict=True):
                ids = read_segment(data.as_py(), known, limit)
                sizes = np.array([len(x) for x in ids], np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(keys.as_py(), pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["file", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    got = files.select("file", "seq", "doc_ids", "segment").mapInArrow(run, "file int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return got.join(starts, ["file", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
