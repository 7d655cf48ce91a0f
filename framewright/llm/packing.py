"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of LENGTH tokens is filled to target proportions; what a source falls short of by fractions of a token is
its deficit, served first in later windows. A source is served until it runs dry; the others then share its part by
their targets. Windows are packed in partitions of many; how far each source has come where a partition begins is
planned by the same round-robin over partitions, so deficits carry across both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import kept, materialize
from framewright.llm.mixing import MOST_SOURCES, WEIGHTS
from framewright.llm.tokens import END, id_type, token_table

LENGTH = 2048
#: Windows of a partition, unless that makes more partitions than these; then partitions grow.
WINDOWS, MOST_PARTITIONS = 256, 1 << 18
#: Entries of the driver's plan (partitions times sources).
MOST_ENTRIES = 1 << 23
#: Rows of the queues' starts by task that are broadcast at most; more are joined by a shuffle.
MOST_BASES = 1 << 19


def served(share: np.ndarray, deficit: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that each queue gives to a window of `size`, and the deficits after it.

    A queue is due its share of the window and its deficit. Queues that have less give what they have, and the others
    take over the rest in proportion; whole tokens are served, the last ones to the largest remainders.
    """
    due = np.where(left > 0, np.maximum(deficit + share * size, 0), 0)
    dry, exact = left <= 0, left.astype(float)
    while not dry.all():
        weight = due if due[~dry].sum() > 0 else left.astype(float)
        give = weight * ((size - left[dry].sum()) / weight[~dry].sum())
        over = ~dry & (give >= left)
        if not over.any():
            exact = np.where(dry, left, give)
            break
        dry |= over
    take = np.minimum(np.floor(exact + 1e-9).astype(np.int64), left)
    while (short := size - int(take.sum())) > 0:
        open_ = np.flatnonzero(left > take)
        take[open_[np.argsort(-(exact - take)[open_], kind="stable")][:short]] += 1
    return take, np.where(left > take, exact - take, 0)


def planned(totals: np.ndarray, length: int = LENGTH, windows: int = WINDOWS, targets: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Tokens of each source before each partition (partitions + 1, sources), and the windows of a partition; without targets, the sources' own proportions."""
    total, targets = int(totals.sum()), (totals if targets is None else targets).astype(float)
    most = max(1, min(MOST_PARTITIONS, MOST_ENTRIES // max(1, len(totals))))
    windows = max(windows, -(-total // (length * most)))
    size, count = windows * length, -(-total // (windows * length))
    at, out, deficit = np.zeros(len(totals), np.int64), [], np.zeros(len(totals))
    for _ in range(count):
        out.append(at.copy())
        share = np.where(totals > at, targets, 0)
        take, deficit = served(share / max(share.sum(), 1e-300), deficit, totals - at, min(size, total - int(at.sum())))
        at += take
    return np.array([*out, at], np.int64).reshape(len(out) + 1, len(totals)), windows


def filled(quota: np.ndarray, length: int = LENGTH, targets: np.ndarray | None = None) -> np.ndarray:
    """Tokens of each source in each window (windows, sources) of a partition that has `quota` of them; without targets, in the proportions of the quota."""
    total, left, out, deficit = int(quota.sum()), quota.astype(np.int64).copy(), [], np.zeros(len(quota))
    targets = (quota if targets is None else targets).astype(float)
    while total > 0:
        size, share = min(length, total), np.where(left > 0, targets, 0)
        take, deficit = served(share / max(share.sum(), 1e-300), deficit, left, size)
        out.append(take)
        left -= take
        total -= size
    return np.array(out, np.int64).reshape(-1, len(quota))


def _rows(table: DataFrame, plan: np.ndarray, number: dict[str | None, int], dtype: str) -> DataFrame:
    """A row for each partition that a document of table(doc_id, source, first, n, ids) reaches into, with the ids that it gives there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("packing")  # frees the words that this worker remembers
        unpack, width = zstandard.ZstdDecompressor(), np.dtype(dtype).itemsize
        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                out: list[tuple] = []
                for doc, source, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "first", "n", "ids")), strict=True):
                    s = number[source]
                    cuts = plan[:, s]
                    k, end = int(np.searchsorted(cuts, first, "right")) - 1, int(np.searchsorted(cuts, first + n, "left"))
                    if end - k == 1:
                        out.append((k, s, first - int(cuts[k]), doc, 0, n, ids))
                        continue
                    raw = unpack.decompress(ids)
                    for p in range(k, end):
                        a, b = max(first, int(cuts[p])), min(first + n, int(cuts[p + 1]))
                        if b > a:
                            out.append((p, s, a - int(cuts[p]), doc, a - first, n, pack.compress(raw[(a - first) * width : (b - first) * width])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["partition", "no", "at", "doc_id", "start", "doc_tokens", "ids"])

    return table.mapInArrow(run, "partition long, no int, at long, doc_id long, start long, doc_tokens long, ids binary")


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(plan: np.ndarray, windows: int, length: int, targets: np.ndarray, dtype: str, with_ids: bool):
    def done(key: int, rows: list[tuple]) -> dict[str, list]:
        unpack, quota = zstandard.ZstdDecompressor(), plan[key + 1] - plan[key]
        takes = filled(quota, length, targets)
        # Within a window the sources stand one after the other.
        offset = np.cumsum(takes, axis=1) - takes
        ends = np.cumsum(takes, axis=0)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))}
        for s in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == s]
            ids = [np.frombuffer(unpack.decompress(r[5]), dtype) for r in own]
            first = np.array([r[1] for r in own], np.int64)
            size = np.array([len(x) for x in ids], np.int64)
            edge = np.unique(np.r_[0, ends[:, s]])
            cut = np.unique(np.concatenate([first, first + size, edge[edge <= quota[s]]]))
            a, b = cut[:-1], cut[1:]
            row = np.searchsorted(first, a, "right") - 1
            window = np.searchsorted(ends[:, s], a, "right")
            flat = np.concatenate(ids).astype("<u4").tobytes()
            start = np.array([r[3] for r in own], np.int64)[row] + a - first[row]
            at = offset[window, s] + a - (ends[window, s] - takes[window, s])
            out["doc_id"] += [own[i][2] for i in row.tolist()]
            out["doc_tokens"] += [own[i][4] for i in row.tolist()]
            out["start"] += start.tolist()
            out["length"] += (b - a).tolist()
            pieces = [flat[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            out["ids_crc32"] += [zlib.crc32(x) for x in pieces]
            out["sequence_id"] += (key * windows + window).tolist()
            out["offset"] += at.tolist()
            if with_ids:
                out["ids"] += [np.frombuffer(x, "<u4").astype(np.int64).tolist() for x in pieces]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("packing")
        key, held = None, []
        kinds = {"ids": pa.list_(pa.int64())}

        def table(got: dict) -> Iterator[pa.RecordBatch]:
            if got["doc_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items()], list(got))

        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                for k, *row in zip(*(batch.column(c).to_pylist() for c in ("partition", "no", "at", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                    if k != key and held:
                        yield from table(done(key, held))
                        held = []
                    key = k
                    held.append(tuple(row))
        if held:
            yield from table(done(key, held))

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False, weights: dict[str | None, float] | None = None) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    weights are the sources' target proportions in every window; without them, sources by code point, null last,
    weigh 5, 2, 1, repeating. Each token of each row of docs, the end ids included, lies in exactly one piece; all
    sequences but the last are full. Null texts have the end id alone; repeated rows, and rows that share a doc_id,
    are documents of their own; an empty table gives no rows. The order of a source is that of the table.
    """
    table = token_table(docs, path, end)
    sums = table.groupBy("part", "source").agg(F.sum("n").alias("n"))
    sizes = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; packing is planned on the driver")
    sources = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    targets = np.array([WEIGHTS[i % len(WEIGHTS)] if weights is None else weights[s] for i, s in enumerate(sources)], float)
    plan, windows = planned(np.array([sizes[s] for s in sources], np.int64), length, targets=targets)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    base = materialize(sums.select(F.col("part").alias("__part"), F.col("source").alias("__source"), before.alias("base")), "pack-bases")
    few = base.limit(MOST_BASES + 1).count() <= MOST_BASES
    both = table.join(F.broadcast(base) if few else base, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source")))
    dtype = id_type(path)
    # Repeated rows keep apart by their place in the queue.
    rows = _rows(both.select("doc_id", "source", (F.col("base") + F.col("before")).alias("first"), "n", "ids"), plan, {s: i for i, s in enumerate(sources)}, dtype)
    ordered = rows.repartition("partition").sortWithinPartitions("partition", "no", "at")
    return ordered.mapInArrow(_pack(plan, windows, length, targets, dtype, with_ids), SCHEMA + (", ids array<long>" if with_ids else ""))
