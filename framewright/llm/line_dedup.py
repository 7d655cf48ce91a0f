"""Fuzzy line dedup by MinHash, in DataFrame expressions alone.

Signatures are minima over all shingles of SHINGLE characters, the ones that the exact Jaccard similarity compares.
Lines that share a band and half of their minima are candidates; of 30 minima, a pair of similarity 0.8 shares half
but for one time in ten thousand. Each is verified against its band's first line and the neighbours before it; where
a band still holds lines of several components, all its pairs across components are judged within the join that finds
them, by sketches of 1,024 bits that bound the similarity from above; those that are left are verified. In crowded bands a
prefix filter finds the pairs, which drops none that is alike enough either. Distributed union-find then keeps one
line of each component.
"""

from __future__ import annotations

import functools
import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import connected_components, forget, materialize, near_in_bands, pairs_across, perhaps_among, rows_apart, shared_bands, unlinked_in_bands

#: Characters of a shingle, for signatures and for the exact comparison.
SHINGLE = 5
SIMILARITY = 0.8
#: Minima in a band, and bands. Each minimum serves two bands, and two bands share one minimum at most.
ROWS, BANDS = 5, 12
MINIMA = ROWS * BANDS // 2
#: Minima that a pair of candidates shares at least.
AGREEING = MINIMA // 2
#: Shingles of a row of the aggregation of minima, and of one that makes whole sets.
BLOCK, SET_BLOCK = 32, 32
#: Neighbours, in the order of a band, that a line is compared with first, besides the band's first line.
NEIGHBOURS = 2
#: Lines of a band that are put in order together; more lines are dealt into groups of about so many.
ORDERED = 1024
#: Groups in which shingles are counted.
GROUPS = 1 << 14
#: Longs of a sketch.
WORDS = 16
#: Shingles that a task compares, about.
TASK_SHINGLES = 1 << 20
#: Lines of a band beyond which its pairs are found by a prefix filter; up to there, lines that a task compares with others.
CROWDED, TOGETHER = 8192, 1024
#: What the minima are taken of: hashes of 31 bits, exclusive or these. Their first bits all differ, so that each minimum is over shingles of its own.
_MASKS = [i << 26 | (0x9E3779B1 * (2 * i + 1) >> 3) % (1 << 26) for i in range(MINIMA)]
#: Eight bits of a minimum in a lane, and lanes of a long, of which the first eight bits stay free.
_LANES = 7
_PACKED = [f"p{i}" for i in range(-(-MINIMA // _LANES))]
_LINES = 1 << 32
#: What stands for a null doc_id in a place: more than any other.
_NO_ID = Decimal(1 << 63)


def characters(line: Column) -> Column:
    """A line as UTF-32, in which every character is found at once."""
    return F.encode(line, "UTF-32")


def shingle_rows(rows: DataFrame) -> DataFrame:
    """rows(line, ...) with a row for each shingle in place of the line: s, its hash of 64 bits. A shorter line is its own shingle."""
    others = [c for c in rows.columns if c != "line"]
    wide = rows.select(*others, characters(F.col("line")).alias("__wide"), F.length("line").alias("__n"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("__n") - SHINGLE)))
    return wide.select(*others, "__wide", at.alias("__at")).select(*others, F.xxhash64(F.substring("__wide", F.col("__at") * 4 + 1, F.lit(4 * SHINGLE))).alias("s"))


def shingle_blocks(rows: DataFrame) -> DataFrame:
    """rows(line, ...) with a row for each SET_BLOCK shingles in place of the line: hashes, those of shingle_rows, repeats included."""
    others = [c for c in rows.columns if c != "line"]
    wide = rows.select(*others, characters(F.col("line")).alias("__wide"), F.length("line").alias("__n"))
    cut = wide.select(*others, "__wide", "__n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("__n") - SHINGLE), F.lit(SET_BLOCK))).alias("__at"))
    cut = cut.select(*others, (F.col("__n") - F.col("__at")).alias("__left"), F.substring("__wide", F.col("__at") * 4 + 1, F.lit(4 * (SET_BLOCK + SHINGLE - 1))).alias("__wide"))
    hashes = F.array(*(F.xxhash64(F.substring("__wide", 4 * j + 1, 4 * SHINGLE)) for j in range(SET_BLOCK)))
    there = F.least(F.lit(SET_BLOCK), F.greatest(F.lit(1), F.col("__left") - (SHINGLE - 1)))
    return cut.select(*others, F.slice(hashes, F.lit(1), there).alias("hashes"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line that has more than white space, numbered from 0."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    return text.where(F.col("line").rlike(r"\S"))


def _place() -> Column:
    """doc_id and line_no as one orderable value, a null id last."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)"))
    return (doc * F.lit(Decimal(_LINES)) + F.col("line_no")).cast("decimal(38,0)")


def _split_place(place: str) -> list[Column]:
    """doc_id and line_no of a place."""
    number = f"cast(pmod({place}, cast({_LINES} as decimal(10,0))) as bigint)"
    doc = f"case when {place} < cast({int(_NO_ID) * _LINES} as decimal(38,0)) then ({place} - {number}) div cast({_LINES} as decimal(10,0)) end"
    return [F.expr(doc).alias("doc_id"), F.expr(f"cast({number} as int)").alias("line_no")]


def bands() -> list[list[int]]:
    """The minima of each band: of two divisions of a grid, one by rows and one across them."""
    half = BANDS // 2
    return [[b * ROWS + r for r in range(ROWS)] for b in range(half)] + [[(b + r) % half * ROWS + r for r in range(ROWS)] for b in range(half)]


def signatures(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, line_no, n, b0, b1, ..., p0, ...) of each distinct line: hashes, first place, length, a hash for each band, the minima in lanes."""
    own = ["h1", "h2", "n", "place"]
    rows = lines(docs).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("n"), _place().alias("place"), characters(F.col("line")).alias("wide"))
    rows = rows.select(*own, "wide", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - SHINGLE), F.lit(BLOCK))).alias("at"))
    rows = rows.select(*own, "at", F.substring("wide", F.col("at") * 4 + 1, F.lit(4 * (BLOCK + SHINGLE - 1))).alias("wide"))
    shingle = lambda j: F.hash(F.substring("wide", 4 * j + 1, 4 * SHINGLE)).bitwiseAND(F.lit((1 << 31) - 1))
    rows = rows.select(*own, "at", "wide", (F.col("n") - F.col("at")).alias("left"), shingle(0).alias("x0"))
    # Where a block ends early, its first shingle stands for those that are not there.
    rows = rows.select(*own, "at", "x0", *(F.when(F.col("left") >= SHINGLE + j, shingle(j)).otherwise(F.col("x0")).alias(f"x{j}") for j in range(1, BLOCK)))
    least = [F.min(F.least(*(F.col(f"x{j}").bitwiseXOR(F.lit(c)) for j in range(BLOCK)))).alias(f"m{i}") for i, c in enumerate(_MASKS)]
    sign = rows.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.min(F.when(F.col("at") == 0, F.col("place"))).alias("place"), *least)
    lane = lambda i: F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(255)).cast("long"), 8 * (i % _LANES))
    packed = [functools.reduce(Column.bitwiseOR, [lane(i) for i in range(k * _LANES, min(MINIMA, (k + 1) * _LANES))]).alias(p) for k, p in enumerate(_PACKED)]
    return sign.select("h1", "h2", *_split_place("place"), "n", *(F.xxhash64(F.lit(b), *(f"m{i}" for i in own)).alias(f"b{b}") for b, own in enumerate(bands())), *packed)


def _agreeing(x: str, y: str) -> Column:
    """Whether enough lanes of two lines' packed minima are equal."""
    low, high = sum(0x7F << 8 * i for i in range(_LANES)), sum(0x80 << 8 * i for i in range(_LANES))
    apart = [F.col(f"{p}{x}").bitwiseXOR(F.col(f"{p}{y}")) for p in _PACKED]
    unlike = [F.bit_count((z.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(z).bitwiseAND(F.lit(high))) for z in apart]
    return functools.reduce(lambda a, b: a + b, unlike) <= MINIMA - AGREEING


def candidates(found: DataFrame) -> DataFrame:
    """(band, line_id, n, size, first) of the bands that several lines of found share: how many they are, and the first of them."""
    return shared_bands(found.select("line_id", "n", F.explode(F.array(*(f"b{b}" for b in range(BANDS)))).alias("band")), "line_id")


def near_pairs(ranked: DataFrame, minima: DataFrame) -> DataFrame:
    """Distinct candidates (a, b) among the pairs of each line with its band's first and with those before it by their minima, those of minima(line_id, p0, ...)."""
    # In order of the minima, lines that share more of them than the band stand side by side.
    pairs = near_in_bands(ranked.join(minima, "line_id"), "line_id", _PACKED, NEIGHBOURS, ORDERED)
    at = lambda c: minima.select(F.col("line_id").alias(c), *(F.col(p).alias(f"{p}_{c}") for p in _PACKED))
    return pairs.join(at("a"), "a").join(at("b"), "b").where(_agreeing("_a", "_b")).select("a", "b")


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, lines): numbers of the lines of each document that stay.

    Of each component of lines, linked by an exact Jaccard similarity of their character shingles of at least
    `similarity`, the first by doc_id and number stays. Equal lines are always linked. Lines of white space alone
    are not considered and not listed. Rows that share a doc_id are one document; a null doc_id comes last.
    """
    found = materialize(signatures(docs).withColumn("line_id", F.monotonically_increasing_id()), "line-signatures")
    ranked = candidates(found)
    texts = materialize(texts_of(docs, found, ranked.select("line_id").distinct()), "line-texts")
    # The table of texts has the minima of the lines that share bands, a small part of all.
    pairs = materialize(near_pairs(ranked, texts.select("line_id", *_PACKED)), "line-pairs")
    links = verified(texts, pairs, similarity)
    joined = connected_components(links)
    # Up to NEIGHBOURS + 2 lines of a band have all been compared by now.
    rest = unlinked_pairs(docs, found, ranked.where(F.col("size") > NEIGHBOURS + 2), joined, similarity, texts=texts)
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "line-pairs")
    if rest.limit(1).count():
        forget(joined)
        more = verified(texts, rest, similarity)
        joined = connected_components(links.unionByName(more))
        forget(more)
    forget(ranked, texts, pairs, links, rest)
    places = found.select("line_id", "doc_id", "line_no")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    first = places.join(joined.withColumnRenamed("node", "line_id"), "line_id").groupBy("root").agg(F.min(order).alias("at")).select("at.doc_id", "at.line_no")
    alone = places.join(joined.select(F.col("node").alias("line_id")), "line_id", "left_anti").select("doc_id", "line_no")
    return alone.unionByName(first).groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))


def sketches(texts: DataFrame) -> DataFrame:
    """(line_id, m, w0, w1, ...) of texts(line_id, line): how many shingles a line has, and bits, each told by whether an odd number of them fall on it."""
    # Made distinct line by line, as arrays, and summed by word first: rows of single shingles fill no large table.
    whole = shingle_blocks(texts.select("line_id", "line")).groupBy("line_id").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("s"))
    word, mark = F.pmod(F.shiftright("s", 6), F.lit(WORDS)).cast("int"), F.expr("shiftleft(1L, cast(pmod(s, 64L) as int))")
    each = whole.select("line_id", F.explode("s").alias("s")).groupBy("line_id", word.alias("word")).agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark).alias("marks"))
    words = (F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("marks"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS))
    return each.groupBy("line_id").agg(F.sum("m").alias("m"), *words)


def _perhaps_alike(similarity: float) -> Column:
    """Whether two lines x and y of sketches may be alike. A shingle that only one of them has changes one bit, so no fewer shingles than bits differ."""
    bits = functools.reduce(lambda a, b: a + b, (F.bit_count(F.col(f"w{i}_x").bitwiseXOR(F.col(f"w{i}_y"))) for i in range(WORDS)))
    sizes = F.least("m_x", "m_y") >= similarity * F.greatest("m_x", "m_y") - 1e-9
    return sizes & (bits <= (1 - similarity) / (1 + similarity) * (F.col("m_x") + F.col("m_y")) + 1e-9)


def unlinked_pairs(docs: DataFrame, found: DataFrame, ranked: DataFrame, joined: DataFrame, similarity: float, crowded: int = CROWDED, texts: DataFrame | None = None) -> DataFrame:
    """Distinct candidates (a, b) of ranked(line_id, band, size) that share a band, are not in one component of joined(node, root) and may be alike.

    In bands of more than `crowded` lines, pairs that cannot be alike are left out by prefixes: of two sets that are
    alike, ordered by one order, rarest first, the first n - ceil(similarity * n) + 1 members have one in common.
    texts, as of texts_of, spares reading the lines again and meeting all lines of found.
    """
    minima = (found if texts is None else texts).select("line_id", *_PACKED)
    rooted = materialize(unlinked_in_bands(ranked, "line_id", joined).join(minima, "line_id"), "line-mixed")
    few, many = rooted.where(F.col("size") <= crowded), rooted.where(F.col("size") > crowded)
    ids = rooted.select("line_id").distinct()
    sets = materialize(sketches(texts_of(docs, found, ids) if texts is None else texts.join(ids, "line_id")), "line-sketches")
    across = lambda members, *keys, together=0: pairs_across(members, list(keys), "line_id", _PACKED, _agreeing("_x", "_y") & _perhaps_alike(similarity), sets, together)
    pairs = across(few, "band", together=TOGETHER)
    if many.limit(1).count():
        pairs = pairs.unionByName(across(many.join(prefixes(docs, found, many.select("line_id").distinct(), similarity), "line_id"), "band", "s"))
    return pairs.distinct()


def prefixes(docs: DataFrame, found: DataFrame, ids: DataFrame, similarity: float) -> DataFrame:
    """A table (line_id, s) of the prefix of each of ids(line_id): its rarest shingles, as many as two alike lines must share one of."""
    sets = materialize(shingle_rows(texts_of(docs, found, ids).select("line_id", "line")).distinct(), "line-shingles")
    # Counted by groups of shingles, of a fixed number; any one order serves, the rarest first parts the most pairs.
    group = F.pmod("s", F.lit(GROUPS))
    sizes = {r["group"]: r["count"] for r in sets.groupBy(group.alias("group")).count().collect()}
    rarity = F.get(F.from_json(F.lit(json.dumps([sizes.get(i, 0) for i in range(GROUPS)])), "array<bigint>"), group.cast("int"))
    own = Window.partitionBy("line_id")
    ordered = sets.withColumn("rarity", rarity).select("line_id", "s", F.row_number().over(own.orderBy("rarity", "s")).alias("k"), F.count(F.lit(1)).over(own).alias("n"))
    prefix = ordered.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("line_id", "s")
    prefix = materialize(prefix, "line-prefixes")
    forget(sets)
    return prefix


def texts_of(docs: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """(line_id, line, p0, ...) of the distinct ids(line_id) of found, read again at the first place of each, with their minima."""
    needed = ids.join(found.select("line_id", "h1", "h2", "doc_id", "line_no", *_PACKED), "line_id")
    own = perhaps_among(lines(docs), needed, "doc_id", "line_no").select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "line_no", "line")
    # Joined and made distinct by the same columns, so that texts move once.
    at = needed.select("h1", "h2", "line_id", F.col("doc_id").alias("__doc"), F.col("line_no").alias("__no"), *_PACKED)
    both = own.join(at, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("line_no") == F.col("__no")))
    return both.dropDuplicates(["h1", "h2"]).select("line_id", "line", *_PACKED)


def verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of lines of texts(line_id, line), a table of those whose exact Jaccard similarity is high enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("line_id"))
    shingles = ends.join(texts.select("line_id", F.length("line").alias("n")), "line_id").agg(F.sum("n")).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // TASK_SHINGLES))
    at = lambda c: texts.select(F.col("line_id").alias(c), F.col("line").alias(f"line_{c}"))
    # Merged by b, so that all shingles of a pair stay in the task that makes them, and in so many parts that they fit.
    both = pairs.join(at("a"), "a").repartition(parts, "b").join(at("b").repartition(parts, "b").hint("merge"), "b")
    sides = both.select("a", "b", F.inline(F.array(*(F.struct(F.lit(i + 1).alias("side"), F.col(f"line_{c}").alias("line")) for i, c in enumerate("ab")))))
    whole = lambda i: F.flatten(F.collect_list(F.when(F.col("side") == i, F.col("hashes"))))
    sets = shingle_blocks(sides).groupBy("a", "b").agg(whole(1).alias("x"), whole(2).alias("y"))
    alike = F.size(F.array_intersect("x", "y")) >= similarity * F.size(F.array_union("x", "y")) - 1e-9
    return materialize(sets.where(alike).select("a", "b"), "line-links")


@rows_apart
def line_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines (with more than white space), n_kept, kept_lines (their numbers).

    Rows that share a doc_id, nulls among them, are documents of their own; null, empty and blank texts have no
    lines; an empty table gives no rows.
    """
    split = F.coalesce(F.split(F.col("text").cast("string"), "\n", -1), F.array().cast("array<string>"))
    full = F.size(F.filter(split, lambda x: x.rlike(r"\S")))
    kept = kept_lines(docs, similarity).withColumnRenamed("doc_id", "__fw_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full.alias("n_lines")).join(kept, F.col("doc_id").eqNullSafe(F.col("__fw_id")), "left")
    lists = F.coalesce("lines", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(lists).alias("n_kept"), lists.alias("kept_lines"))


@rows_apart
def line_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without the lines that go; lines of white space stay, n_chars, where there is one, follows the text.

    A document that had lines and keeps none goes; null, empty and blank texts stay. Rows that share a doc_id are
    documents of their own.
    """
    kept = kept_lines(docs, similarity).select(F.col("doc_id").alias("__fw_id"), F.col("lines").alias("__fw_lines"))
    both = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__fw_id")), "left").drop("__fw_id")
    split = F.split("text", "\n", -1)
    blank = lambda x: ~x.rlike(r"\S")
    both = both.withColumn("__fw_split", split)
    blanks = F.filter(F.transform("__fw_split", lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
    left = F.transform(F.array_sort(F.array_union("__fw_lines", blanks)), lambda i: F.get("__fw_split", i))
    text = F.when(F.col("__fw_lines").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    both = both.where(F.col("text").isNull() | F.col("__fw_lines").isNotNull() | blank(F.regexp_replace("text", "\n", " ")))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
