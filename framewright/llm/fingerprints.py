"""Document fingerprints by randomised edit embedding.

A walk reads a text: at each step it puts out the character that it stands on, and a bit shared by all walks, drawn
from the step and the character, says whether it goes on to the next. A few edits make two walks differ in few
steps, so the Hamming distance of what they put out stands for the edit distance. Long texts are walked in segments
that end where a hash of the last characters says so: an edit, or text put in, changes the segment it falls in and no
other. Each sample of a fingerprint takes the segment whose beginning has the least hash for it, and a shared step
of that segment's walk. Bands of bits, drawn from the samples, find candidates; the fingerprints verify them.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import connected_components, forget, materialize, near_in_bands, pairs_across, row_slices, shared_bands, unlinked_in_bands

#: Sampled steps of a fingerprint, a byte each.
SAMPLES = 128
#: Characters of a segment, on average and at most, and those that a hash for its end looks back on.
CUT, SEGMENT, LOOK, SEED = 512, 2048, 16, 7
#: Characters below which a segment ends in a mark of its own, as most of its steps are past its end.
SHORT = 32
#: Documents of a range that a task puts in order, and ranges at most; beyond that ranges grow.
BUCKET, MOST_RANGES = 4096, 8192
#: Keys sampled for each bound between ranges.
OVERSAMPLE = 8
#: Likeness at which two fingerprints link.
LIKENESS = 0.8
#: Bands, samples that a band draws, and bits that it takes of each of these: those that tell letters apart.
#: 24 bands of 8 samples miss a pair of likeness 0.8 once in eighty times.
BANDS, DRAWN, BITS = 24, 8, 5
#: Neighbours that a fingerprint is verified against, besides its band's first, and fingerprints of a band put in order together.
NEIGHBOURS, ORDERED = 2, 1024
#: Fingerprints of a band beyond which its pairs are found by two groups of samples, of so many each, at a time.
CROWDED, GROUP = 64, 4
#: Samples in a long, and longs of a fingerprint.
LANES = 7
WORDS = -(-SAMPLES // LANES)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps_of(n: np.ndarray | int) -> np.ndarray | int:
    """Steps in which a walk over n characters ends, but for a chance of millions to one; half a character a step."""
    return np.where(np.asarray(n) > 0, 2 * np.asarray(n) + np.asarray(n) // 4 + 24, 1)


class Embedding:
    """The shared walks and samples for one seed."""

    def __init__(self, samples: int = SAMPLES, segment: int = SEGMENT, seed: int = SEED) -> None:
        self.samples, self.segment, self.pitch = samples, segment, int(steps_of(segment))
        at = np.arange(self.pitch * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        #: Whether the walk goes on, by step and by the character's low byte mixed with its high ones.
        self.go = (mixed(at) & np.uint64(1)).astype(np.uint8).reshape(self.pitch, 256)
        self.keys = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        # Each sample is the step with the least random value among the steps that there are. The least up to some
        # length changes only at records, each found by dividing by a uniform number, so lengths share most samples.
        rng, self.records = np.random.default_rng(seed), []
        for _ in range(samples):
            at, own = 0, [0]
            while at < 1 << 46:
                at = int(at / max(rng.random(), 1e-9)) + 1
                own.append(at)
            self.records.append(np.array(own, np.int64))

    def segments(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first character, size and name of each segment of texts that stand one after the other in data."""
        begin = np.cumsum(sizes) - sizes
        h, step, power = data * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B), 1, 0x2C1B3C6D
        h ^= h >> np.uint32(15)
        while step < LOOK:  # h[i] of the last 2 * step characters, of those of the last step
            h[step:] = h[step:] + h[:-step] * np.uint32(power)
            step, power = step * 2, power * power % (1 << 32)
        cuts = np.flatnonzero(h * np.uint32(0xC2B2AE35) < np.uint32((1 << 32) // CUT)) + 1
        text = np.searchsorted(begin + sizes, cuts, "right")
        inside = (text < len(sizes)) & (cuts - begin[np.minimum(text, len(sizes) - 1)] >= LOOK)
        at = np.unique(np.concatenate([begin[sizes > 0], cuts[inside]]))
        # A text's first segment, its only one too, has one name; the others are named by the characters before them.
        text = np.searchsorted(begin + sizes, at, "right")
        name = np.where(begin[text] == at, np.uint64(1), h[np.maximum(at - 1, 0)].astype(np.uint64) + np.uint64(2))
        size = np.minimum(np.r_[at[1:], len(data)], (begin + sizes)[text]) - at
        # Segments without an end in sight are cut at a fixed size.
        more = np.maximum(1, -(-size // self.segment))
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        first, size, text, name = np.repeat(at, more) + k * self.segment, np.repeat(size, more), np.repeat(text, more), np.repeat(name, more)
        size = np.minimum(size - k * self.segment, self.segment)
        name = name + (k.astype(np.uint64) << np.uint64(34))
        empty = np.flatnonzero(sizes == 0)
        text, first, size = np.r_[text, empty], np.r_[first, begin[empty]], np.r_[size, np.zeros(len(empty), np.int64)]
        name = np.r_[name, np.ones(len(empty), np.uint64)]
        by = np.lexsort((first, text))
        return text[by], first[by], size[by], name[by]

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of bytes for each text. All texts' segments take their steps together."""
        if not texts:
            return np.zeros((0, self.samples), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.append(((data ^ (data >> 8) * np.uint32(31)) & 255).astype(np.uint8), np.uint8(0))
        text, begin, size, name = self.segments(data, sizes)
        opens = np.searchsorted(text, np.arange(len(texts)))
        chosen = np.repeat(opens[:, None], self.samples, axis=1)
        many = np.flatnonzero(np.diff(np.r_[opens, len(text)]) > 1)
        for i in range(0, len(many), 1024):
            part = many[i : i + 1024]
            own = np.flatnonzero(np.isin(text, part))
            starts = np.searchsorted(text[own], part)
            value = mixed(name[own, None] ^ self.keys[None, :])
            least = np.minimum.reduceat(value, starts, axis=0)
            rank = np.searchsorted(part, text[own])
            place = np.where(value == least[rank], own[:, None], len(text))
            chosen[part] = np.minimum.reduceat(place, starts, axis=0)
        steps = steps_of(size)[chosen]
        sample = np.column_stack([r[np.searchsorted(r, steps[:, j], "left") - 1] for j, r in enumerate(self.records)])
        # Samples by their step; segments by length, so that those still walking stand first.
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        where, step = place[chosen].ravel(), sample.ravel()
        by = np.argsort(step, kind="stable")
        where, edges = where[by], np.searchsorted(step[by], np.arange(self.pitch + 1))
        out = np.zeros(sample.size, np.uint8)
        pos, end = begin[order].astype(np.int32 if len(low) < 1 << 31 else np.int64), (begin + size)[order]
        walking = np.searchsorted(-steps_of(size[order]), -np.arange(self.pitch), "left")
        end = end.astype(pos.dtype)
        # Past the end the walk puts out a mark, which no sample of a character need equal; of a short text, one of its own.
        mark = np.zeros(len(size), np.uint8)
        for i in np.flatnonzero((size > 0) & (size < SHORT)).tolist():
            mark[place[i]] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes()) & 255 | 1
        for j in range(self.pitch):
            n = walking[j]
            if not n:
                break
            a, b = edges[j], edges[j + 1]
            p = pos[:n]
            c = low[np.minimum(p, np.maximum(end[:n] - 1, 0)) if j else p]
            if a < b:
                w = where[a:b]
                out[by[a:b]] = np.where(p[w] < end[w], c[w], mark[w])
            p += self.go[j][c] & (p < end[:n])
        return out.reshape(sample.shape)

    def bands(self, prints: np.ndarray) -> np.ndarray:
        """A number for each band of each fingerprint (rows, BANDS): BITS bits of DRAWN samples, and the band's own number."""
        rng = np.random.default_rng(self.samples)
        out = np.empty((len(prints), BANDS), np.int64)
        for b in range(BANDS):
            own = prints[:, rng.choice(self.samples, DRAWN, replace=False)].astype(np.int64) & ((1 << BITS) - 1)
            out[:, b] = (own << (BITS * np.arange(DRAWN))).sum(axis=1) | (b << (BITS * DRAWN))
        return out


_EMBEDDING: dict[tuple[int, int, int], Embedding] = {}


def embedding(samples: int = SAMPLES, segment: int = SEGMENT, seed: int = SEED) -> Embedding:
    key = (samples, segment, seed)
    if key not in _EMBEDDING:
        _EMBEDDING[key] = Embedding(*key)
    return _EMBEDDING[key]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, 0 to 1."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many characters from the start of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """docs(doc_id, text) dealt into ranges of doc_id, then of a hash of the text, of about `bucket` rows, MOST_RANGES of them at most.

    Added: the order's columns known, k and h; range; and guest for a copy of the document that follows a range (the
    first of the next lower one; of all, after the lowest). Null ids count as below all others.
    """
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    ids = docs.select(key.isNotNull().cast("int").alias("known"), F.coalesce(key, F.lit(0).cast("long")).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"), key.alias("doc_id"))
    count = max(1, min(MOST_RANGES, -(-ids.count() // bucket)))
    order = ["known", "k", "h"]
    sample = ids.select(*order).distinct().orderBy(F.xxhash64(*order)).limit(OVERSAMPLE * count).collect() if count > 1 else []
    edges = sorted(map(tuple, sample))[OVERSAMPLE::OVERSAMPLE]

    @F.pandas_udf("long")
    def place(known, k, h):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([bisect.bisect_right(edges, key) for key in zip(known.tolist(), k.tolist(), h.tolist(), strict=True)], dtype="int64")

    placed = ids.withColumn("range", place(*order) if edges else F.lit(0).cast("long"))
    tops = {r["range"]: tuple(r["top"]) for r in placed.groupBy("range").agg(F.max(F.struct(*order)).alias("top")).collect()}
    full = sorted(tops)
    # The lowest range is followed by the highest.
    follows = docs.sparkSession.createDataFrame([(*tops[full[i - 1]], full[i]) for i in range(len(full))], "known int, k long, h long, to long")
    own = placed.join(F.broadcast(follows), order).groupBy("to", *order).agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"))
    copies = own.select(*order, "text", "doc_id", F.col("to").alias("range"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).unionByName(copies), max(1, len(full))


def fingerprint_report(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before it by doc_id, after the smallest the largest; a document that stands alone
    is its own next. Rows that share a doc_id, or have none, follow each other by hashes of their texts, descending.
    Null texts are empty; empty texts have one fingerprint. An empty table gives no rows.
    """
    rows, count = in_order(docs.select("doc_id", "text"), bucket)
    # Descending; a guest, though as large as any, stands last.
    dealt = rows.repartition(count, "range").sortWithinPartitions("range", "guest", F.desc("known"), F.desc("k"), F.desc("h")).select("doc_id", "text", "range", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = embedding()
        carry: list[tuple] = []  # the last row, whose next is not there yet

        def done(rows: list[tuple]) -> pa.RecordBatch | None:
            """Rows in order; the last, and guests, only serve as next."""
            pairs = [i for i in range(len(rows) - 1) if not rows[i][3]]
            if not pairs:
                return None
            changed = [edited(rows[i][1], rows[i + 1][1]) for i in pairs]
            own = work.fingerprints([r[1] for r in rows] + changed)
            a, b, c = own[pairs], own[len(rows) :], own[np.array(pairs) + 1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in pairs], pa.int64()),
                    pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array([x.tobytes().hex() for x in a]),
                    pa.array([x.tobytes().hex() for x in b]),
                    pa.array(likeness(a, b), pa.float64()),
                    pa.array(likeness(a, c), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")]
            rows = list(zip(*cols, strict=True))
            sizes = np.array([len(r[1]) for r in rows], np.int64)
            for i, j in row_slices(sizes, 3 << 20):
                group = carry + rows[i:j]
                carry = group[-1:]
                if (got := done(group)) is not None:
                    yield got

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint binary) of every whole text; null is empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in row_slices(np.array([len(t) for t in texts], np.int64), 3 << 20):
                got = embedding().fingerprints(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([x.tobytes() for x in got], pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint binary")


def print_nodes(prints: DataFrame) -> DataFrame:
    """(node, fingerprint, first, bands) of each distinct fingerprint of prints(doc_id, fingerprint), as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column("fingerprint").to_pylist())
            got = embedding().bands(np.frombuffer(raw, np.uint8).reshape(-1, SAMPLES))
            yield pa.RecordBatch.from_arrays([batch.column("fingerprint"), batch.column("first"), pa.array(list(got), pa.list_(pa.int64()))], ["fingerprint", "first", "bands"])

    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    banded = distinct.mapInArrow(run, "fingerprint binary, first long, bands array<long>")
    return materialize(banded.withColumn("node", F.monotonically_increasing_id()), "edit-nodes")


def alike_pairs(nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, a table of those whose fingerprints are alike in `least` of their samples."""

    @F.pandas_udf("double")
    def alike(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SAMPLES) for s in (a, b))
        return pd.Series(likeness(x, y))

    at = lambda c: nodes.select(F.col("node").alias(c), F.col("fingerprint").alias(f"print_{c}"))
    both = pairs.join(at("a"), "a").join(at("b"), "b")
    return materialize(both.where(alike("print_a", "print_b") >= least).select("a", "b"), "edit-links")


def edit_groups(prints: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(fingerprint, component_id) of each distinct fingerprint of prints(doc_id, fingerprint): the smallest doc_id that links lead to.

    Fingerprints that are alike in at least `least` of their samples and share a band of sampled bits are linked. Each
    is verified against its band's first and those before it, then against all others of the band that are not in its
    component yet. Equal fingerprints are one node, so copies cost no pairs. A null doc_id takes part and has its
    component's id, null if there is no other; an empty table gives no rows.
    """
    nodes = print_nodes(prints)
    ranked = shared_bands(nodes.select("node", F.explode("bands").alias("band")), "node")
    pairs = materialize(near_in_bands(ranked, "node", [], NEIGHBOURS, ORDERED), "edit-pairs")
    links = alike_pairs(nodes, pairs, least)
    joined = connected_components(links)
    rest = materialize(unlinked_pairs(nodes, ranked.where(F.col("size") > NEIGHBOURS + 2), joined, least), "edit-pairs")
    if rest.limit(1).count():
        forget(joined)
        joined = connected_components(links.unionByName(rest))
    forget(ranked, pairs, links, rest)
    roots = nodes.join(joined, "node", "left").select("fingerprint", "first", F.coalesce("root", "node").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return roots.join(ids, "root").select("fingerprint", "component_id")


def grouped_report(docs: DataFrame, bucket: int = BUCKET, least: float = LIKENESS) -> DataFrame:
    """fingerprint_report(), with component_id: the smallest doc_id that links of edit_groups() lead to."""
    rows = materialize(fingerprint_report(docs, bucket).withColumn("raw", F.unhex("fingerprint")).drop("fingerprint"), "edit-prints")
    groups = materialize(edit_groups(rows.select("doc_id", F.col("raw").alias("fingerprint")), least), "edit-groups")
    both = rows.join(groups, F.col("raw") == groups["fingerprint"]).drop(groups["fingerprint"])
    return both.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("raw")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "component_id")


def crowded_keys(least: float, group: int = GROUP) -> list[tuple[int, ...]]:
    """Sets of groups of consecutive samples such that fingerprints that are alike agree on all groups of one of the sets.

    Samples that differ spoil a group each at most. Where more groups agree than there are classes of groups, two agree
    within a class. Where too few must agree for that, each group is a set.
    """
    count = SAMPLES // group
    agreeing = count - int((1 - least) * SAMPLES + 1e-9)
    if agreeing < 2:
        return [(i,) for i in range(count)]
    return [(i, j) for j in range(count) for i in range(j) if i % (agreeing - 1) == j % (agreeing - 1)]


def sample_words(nodes: DataFrame) -> DataFrame:
    """(node, w0, w1, ...) of nodes(node, fingerprint): the samples, LANES in a long, whose first eight bits stay free."""
    word = lambda i: F.conv(F.hex(F.substring("fingerprint", i * LANES + 1, LANES)), 16, 10).cast("long")
    return nodes.select("node", *(word(i).alias(f"w{i}") for i in range(WORDS)))


def words_alike(least: float) -> Column:
    """Whether two nodes x and y of sample_words are alike in `least` of their samples: as likeness() has it."""
    low, high = sum(0x7F << 8 * i for i in range(LANES)), sum(0x80 << 8 * i for i in range(LANES))
    apart = [F.col(f"w{i}_x").bitwiseXOR(F.col(f"w{i}_y")) for i in range(WORDS)]
    unlike = [F.bit_count((z.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(z).bitwiseAND(F.lit(high))) for z in apart]
    return (F.lit(SAMPLES) - functools.reduce(lambda a, b: a + b, unlike)) / F.lit(float(SAMPLES)) >= least


def unlinked_pairs(nodes: DataFrame, ranked: DataFrame, joined: DataFrame, least: float, crowded: int = CROWDED) -> DataFrame:
    """Distinct pairs (a, b) of ranked(node, band, size) that share a band, are not in one component of joined(node, root) and are alike.

    Likeness is judged within the join, which puts out no other pairs. Of the nodes of bands of more than `crowded`
    fingerprints, pairs that cannot be alike are left out by crowded_keys. Such a node is keyed once, in however many
    of these bands it is, so its rows are as many as the sets of keys; that a pair shares a band is judged last.
    """
    rooted = materialize(unlinked_in_bands(ranked, "node", joined), "edit-mixed")
    placed = rooted.where(F.col("size") > crowded).groupBy("node", "root").agg(F.collect_list("band").alias("bands"))
    many = placed.join(nodes.select("node", "fingerprint"), "node")
    key = lambda groups: F.xxhash64(F.lit(",".join(map(str, groups))), *(F.substring("fingerprint", i * GROUP + 1, GROUP) for i in groups))
    keyed = many.select("node", "root", F.explode(F.array(*map(key, crowded_keys(least)))).alias("key"))
    words = materialize(sample_words(nodes.join(rooted.select("node").distinct(), "node")), "edit-words")
    across = lambda members, *keys: pairs_across(members, list(keys), "node", (), words_alike(least), words)
    at = lambda c: placed.select(F.col("node").alias(c), F.col("bands").alias(f"bands_{c}"))
    crowd = across(keyed, "key").join(at("a"), "a").join(at("b"), "b").where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b")
    return across(rooted.where(F.col("size") <= crowded), "band").unionByName(crowd).distinct()
