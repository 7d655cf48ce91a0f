"""SimHash near-duplicates, linked by BK-trees.

Fingerprints within two bits agree wholly on one of three parts of their 64 bits, so each shard of the
fingerprints that share a part gets a BK-tree of its own, and a search never has to leave its shard. The trees go
to the tasks by key: all fingerprints of a corpus have no size bound that would allow them to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import connected_components, materialize, rows_apart, text_slices, utf8_rows

SEED, WORDS, RADIUS = 42, 3, 2
#: Distinct fingerprints of a shard beyond which it is divided by a further part.
SHARD = 4096
#: First bit and bits of each part, for RADIUS + 1 parts.
PARTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a value; its number, also where it was there already."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (value ^ self.values[at]).bit_count():
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of all values within radius; only edges from d - radius to d + radius are followed."""
        hits, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                hits.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return hits


def star_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """For the distinct values of a shard, one edge from each component's first value to each of the others."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in values:
        near = {root(i) for i in tree.within(v, radius)}
        own = tree.add(v)
        if own == len(parent):
            parent.append(own)
        top = min(near | {own})
        for i in near | {own}:
            parent[i] = top
    return [(tree.values[root(i)], v) for i, v in enumerate(tree.values) if root(i) != i]


def text_fingerprint(text: bytes, words: int = WORDS) -> int:
    return int(_fingerprints([text], words)[0])


def _fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    hashes: list[int] = []
    counts = []
    digest = xxhash.xxh64_intdigest
    for t in texts:
        w = t.translate(_LOWER).split()
        flat, n = b" ".join(w), len(w)
        if n <= words:
            got = [digest(flat, SEED)] if n else []
        else:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
            starts = [0, *(ends[: n - words] + 1).tolist()]
            got = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
        hashes += got
        counts.append(len(got))
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    raw = np.array(hashes, "<u8")
    starts = np.cumsum(counts) - counts
    rows = np.flatnonzero(counts)
    for first in range(0, len(rows), 512):
        part = rows[first : first + 512]
        a, b = starts[part[0]], starts[part[-1]] + counts[part[-1]]
        bits = np.unpackbits(raw[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, starts[part] - a, axis=0, dtype=np.int64)
        on = (2 * sums > counts[part][:, None]).astype(np.uint8)
        out[part] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp bigint) of every whole text.

    Words are the runs other than spaces and ASCII controls 9 to 13, with A-Z lowered; fewer words than a shingle
    make one shingle of them all; null, empty and blank texts have fingerprint 0. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2 << 20):
                fp = _fingerprints(utf8_rows(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _part(bits: tuple[int, int], no: int) -> F.Column:
    low, n = bits
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1)).bitwiseOR(F.lit(no << 58))


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            got: list[tuple[int, int]] = []
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(keys)], strict=True):
                if b - a > 1:
                    got += star_links(fps[a:b].view(np.uint64).tolist(), radius)
            pairs = np.array(got, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "finer")])
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            if held:
                keys, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], fps])
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links(keys[:cut], fps[:cut])
            held = keys[cut:], fps[cut:]
        if held:
            yield links(*held)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between the distinct values of fps(fp) that span all links within radius (2 at most).

    A shard of more than `shard` values is divided by a further part of the remaining bits, so no task holds more
    than the values that agree on both.
    """
    if not 0 <= radius <= 2:
        raise ValueError("three parts serve a radius of 2 at most")
    keyed = fps.select("fp", F.explode(F.array(*(_part(p, i) for i, p in enumerate(PARTS)))).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > shard).select("shard", F.lit(True).alias("large"))
    keyed = keyed.join(large, "shard", "left")
    finer = []
    for no, (low, n) in enumerate(PARTS):
        rest = [i for i in range(64) if not low <= i < low + n]
        size = -(-len(rest) // 3)
        parts = []
        for k in range(3):
            own = rest[k * size : (k + 1) * size]
            mask = sum(1 << i for i in own)
            parts.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        finer.append(F.array(*(F.xxhash64(F.lit(k), p) for k, p in enumerate(parts))))
    which = F.shiftrightunsigned("shard", 58)
    by_part = F.when(which == 0, finer[0]).when(which == 1, finer[1]).otherwise(finer[2])
    keyed = keyed.select("fp", "shard", F.explode(F.when(F.col("large"), by_part).otherwise(F.array(F.lit(0).cast("long")))).alias("finer"))
    ordered = keyed.repartition("shard", "finer").sortWithinPartitions("shard", "finer", "fp")
    return ordered.mapInArrow(_shard_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links within radius.

    Rows of one fingerprint are always linked; repeated rows come back as often as they are there. A null doc_id
    takes part and has its component's id; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, words), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_links(fps.select("fp"), radius)
    joined = connected_components(links).select(F.col("node").alias("fp"), "root")
    labelled = materialize(fps.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


@rows_apart
def simhash_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, whole, that stay: of each component the row with the smallest doc_id, a null one last."""
    groups = simhash_groups(docs, words, radius)
    keep = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("__fw_id"))
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__fw_id")), "left_semi")
