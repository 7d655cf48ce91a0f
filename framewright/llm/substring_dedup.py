"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

The hash at a byte depends on the 32 bytes up to it alone, so an insertion moves no cut beyond those bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import rows_apart, text_slices, utf8_rows

#: Bytes the rolling hash looks back on: one for each bit of its 32-bit value.
WINDOW = 32
#: A cut falls after a byte whose hash has this many leading zero bits.
CUT_BITS = 5
#: Shorter chunks are no evidence by themselves; they go with the chunks around them.
LEAST_CHUNK = 12
#: Bytes between two repeated chunks that a span may bridge.
BRIDGE = 32
#: Shorter runs of repeated chunks are left alone.
LEAST_SPAN = 80


def gear_table(seed: int = 0x9E3779B9) -> np.ndarray:
    """256 mixed 32-bit values, by the finaliser of a splitmix generator."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + GEAR[byte] modulo 2**32, for all bytes at once by doubling."""
    h, step = GEAR[data], 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunks(texts: list[bytes], cut_bits: int = CUT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Row, start and length of every chunk, and the padded bytes that the starts count in.

    Each text follows WINDOW zero bytes, so its cuts do not depend on what stands before it.
    """
    pad = bytes(WINDOW)
    flat = pad + pad.join(texts) + pad
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + WINDOW) - sizes
    cuts = np.flatnonzero(gear_hashes(np.frombuffer(flat, np.uint8)) < (1 << (32 - cut_bits))) + 1
    row = np.searchsorted(first, cuts, "right") - 1
    inside = (row >= 0) & (cuts > first[row]) & (cuts < first[row] + sizes[row])
    full = np.flatnonzero(sizes)
    ends = np.unique(np.concatenate([cuts[inside], (first + sizes)[full]]))
    row = np.searchsorted(first, ends - 1, "right") - 1
    starts = np.where(np.r_[-1, row[:-1]] != row, first[row], np.r_[0, ends[:-1]])
    return row, starts, ends - starts, flat, first  # type: ignore[return-value]


def chunk_digests(docs: DataFrame, cut_bits: int = CUT_BITS, least: int = LEAST_CHUNK) -> DataFrame:
    """(doc_id, at, size, hi, lo): place, bytes and 128-bit digest of every chunk of at least `least` bytes. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in text_slices(batch):
                row, start, size, flat, first = chunks(utf8_rows(part.column("text")), cut_bits)
                keep = size >= least
                row, start, size = row[keep], start[keep], size[keep]
                got = b"".join([digest(flat[a:b]) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
                pair = np.frombuffer(got, ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(start - first[row])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(pa.array(row)), at, pa.array(size.astype(np.int32)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", "at", "size", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, at long, size int, hi long, lo long")


def merged(at: np.ndarray, size: np.ndarray, bridge: int = BRIDGE, least: int = LEAST_SPAN) -> list[tuple[int, int]]:
    """Runs of chunks, in order, with gaps of at most `bridge` bytes, of at least `least` bytes."""
    if not len(at):
        return []
    cut = np.flatnonzero(at[1:] - (at + size)[:-1] > bridge) + 1
    a, b = at[np.r_[0, cut]], (at + size)[np.r_[cut, len(at)] - 1]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def _spans(bridge: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"repeated": [], "removed": []}
            for items in batch.column("chunks").to_pylist():
                # A repeated row of a document brings its chunks twice.
                items = sorted({(x["at"], x["size"], x["hi"], x["lo"], x["elsewhere"], x["later"]) for x in items})
                seen: set[tuple[int, int]] = set()
                dup, cut = [], []
                for a, n, hi, lo, elsewhere, later in items:
                    again = (hi, lo) in seen
                    seen.add((hi, lo))
                    if elsewhere or again:
                        dup.append((a, n))
                    if later or again:
                        cut.append((a, n))
                for name, rows in (("repeated", dup), ("removed", cut)):
                    pair = np.array(rows, np.int64).reshape(-1, 2)
                    out[name].append([{"start": s, "end": e} for s, e in merged(pair[:, 0], pair[:, 1], bridge, least)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["repeated"], kind), pa.array(out["removed"], kind)], ["doc_id", "repeated", "removed"])

    return run


def repeated_spans(docs: DataFrame, cut_bits: int = CUT_BITS, least_chunk: int = LEAST_CHUNK, bridge: int = BRIDGE, least_span: int = LEAST_SPAN) -> DataFrame:
    """(doc_id, repeated, removed): byte spans of each document that holds repeated chunks.

    repeated: also found in another document, or earlier in this one. removed: those of them that stand earlier,
    in a document of a smaller doc_id or in this one, so one copy of each passage stays. doc_id is the key of a
    document: rows that share one are taken as one document, and a null doc_id as a document after all others.
    Documents without such a span, empty and null texts have no row or empty lists.
    """
    occ = chunk_digests(docs, cut_bits, least_chunk)
    found = occ.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).where("n > 1")
    elsewhere = F.coalesce(F.col("first") != F.col("last"), F.lit(False)) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))
    later = F.when(F.col("doc_id").isNull(), F.col("known") > 0).otherwise(F.col("doc_id") > F.col("first"))
    marked = occ.join(found, ["hi", "lo"]).select("doc_id", "at", "size", "hi", "lo", elsewhere.alias("elsewhere"), later.alias("later"))
    lists = marked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "size", "hi", "lo", "elsewhere", "later")).alias("chunks"))
    kind = "array<struct<start: bigint, end: bigint>>"
    return lists.mapInArrow(_spans(bridge, least_span), f"doc_id long, repeated {kind}, removed {kind}")


@rows_apart
def substring_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs, each text without its removed spans; cuts inside a character drop that character.

    Rows that share a doc_id, nulls among them, are documents of their own; null and empty texts stay as they are,
    and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__fw_spans").to_pylist(), strict=True):
                if text is not None and spans:
                    raw, at, kept = text.encode(), 0, []
                    for s in spans:
                        kept.append(raw[at : s["start"]].decode(errors="ignore"))
                        at = s["end"]
                    text = "".join(kept) + raw[at:].decode(errors="ignore")
                out.append(text)
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    spans = repeated_spans(docs, **options).select(F.col("doc_id").alias("__fw_id"), F.col("removed").alias("__fw_spans"))
    both = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__fw_id")), "left").drop("__fw_id")
    return both.mapInArrow(run, docs.schema)


@rows_apart
def span_report(docs: DataFrame, **options: int) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, repeated_bytes, removed_bytes, and both lists of byte spans.

    Rows that share a doc_id, nulls among them, are documents of their own; null and empty texts have no spans; an
    empty table gives no rows.
    """
    spans = repeated_spans(docs, **options)
    total = lambda c: F.aggregate(F.coalesce(c, F.array()), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    got = spans.select(F.col("doc_id").alias("__fw_id"), "repeated", "removed")
    both = sizes.join(got, F.col("doc_id").eqNullSafe(F.col("__fw_id")), "left")
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return both.select("doc_id", "n_bytes", total(F.col("repeated")).alias("repeated_bytes"), total(F.col("removed")).alias("removed_bytes"), F.coalesce("repeated", empty).alias("repeated_spans"), F.coalesce("removed", empty).alias("removed_spans"))
