"""Secret scans in DataFrame expressions: fixed patterns, and character Markov models of random strings and identifiers.

Positions come from cutting a text at a pattern's matches: what stands between them and the matches themselves,
added up, say where each begins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The value of an assignment: what its pattern leaves after the sign and the quote.
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Strings that the models judge, and the score a character from which they count as random.
CANDIDATE, THRESHOLD = r"[A-Za-z0-9+/_-]{16,}={0,2}", 0.35
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Labelled samples that the models are trained from: so many random strings, and so many documents whose words make identifiers.
RANDOM_SAMPLES, IDENTIFIER_DOCUMENTS = 4000, 2000
#: Matches of a text whose places are added up together.
BLOCK = 64


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLES) -> DataFrame:
    """(sample, label): random strings as they are issued: hexadecimal, base 64, and capitals with digits."""
    ids = spark.range(n).select(F.col("id").cast("string").alias("i"))
    kinds = F.array(F.substring(F.sha2("i", 256), 1, 40), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "i"), 256))), F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("c"), "i"), 256))), "+/=", "QZ7"), 1, 16))), F.translate(F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("d"), "i"), 256))), 1, 32), "+/", "-_"))
    return ids.select(F.explode(kinds).alias("sample"), F.lit("random").alias("label"))


def identifier_samples(docs: DataFrame, n: int = IDENTIFIER_DOCUMENTS) -> DataFrame:
    """(sample, label): names made of the words of the n documents whose texts have the smallest hashes, as programs, links and paths spell them.

    Repeated texts count once, so the sample does not depend on how often a text is there.
    """
    first = docs.where("text is not null").select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(n)
    text = docs.where("text is not null").withColumn("h", F.xxhash64("text")).join(F.broadcast(first), "h").select("h", F.substring("text", 1, 2000).alias("text")).dropDuplicates(["h"])
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " +"), lambda w: F.length(w) > 1)
    made = text.select(F.transform(words, lambda w: F.lower(w)).alias("w"))
    parts = lambda sign: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 4), F.lit(3)), lambda i: F.array_join(F.slice("w", i + 1, 4), sign))
    titled = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 4), F.lit(3)), lambda i: F.array_join(F.transform(F.slice("w", i + 1, 4), lambda x: F.initcap(x)), ""))
    long = F.filter(F.concat(parts("_"), parts("-"), parts("/"), titled, F.transform(parts("_"), lambda s: F.upper(s))), lambda s: F.length(s) >= 8)
    return made.select(F.explode(long).alias("sample"), F.lit("identifier").alias("label"))


def train(samples: DataFrame, alphabet: str = ALPHABET) -> list[float]:
    """Log-likelihood ratios of the transitions between characters, in rows by the first of them.

    samples(sample, label) of the labels random and identifier; each count starts at one. The table has the square
    of the alphabet's length, whatever is counted.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("sample") - 1)), lambda i: F.substring("sample", i, F.lit(2)))
    counts = {(r["label"], r["p"]): r["n"] for r in samples.where("sample is not null").select("label", F.explode(pairs).alias("p")).where(F.length("p") == 2).where(F.col("p").rlike(f"^[{alphabet.replace('-', '')}-]{{2}}$")).groupBy("label", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
    import math

    table = []
    for a in alphabet:
        total = {k: sum(counts.get((k, a + b), 0) for b in alphabet) + len(alphabet) for k in ("random", "identifier")}
        table += [math.log((counts.get(("random", a + b), 0) + 1) / total["random"]) - math.log((counts.get(("identifier", a + b), 0) + 1) / total["identifier"]) for b in alphabet]
    return [round(x, 6) for x in table]


def score(token: Column, table: list[float], alphabet: str = ALPHABET) -> Column:
    """Mean log-likelihood ratio of a token's transitions; 0 for fewer than two characters."""
    model = F.from_json(F.lit(json.dumps(table)), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    steps = F.zip_with(F.slice(codes, 1, F.greatest(F.lit(0), F.size(codes) - 1)), F.slice(codes, 2, F.greatest(F.lit(0), F.size(codes) - 1)), lambda a, b: F.when((a >= 0) & (b >= 0), F.get(model, a * len(alphabet) + b)).otherwise(F.lit(0.0)))
    return F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)).otherwise(F.lit(0.0))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), for which value is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs of start, end (code points, end exclusive) and value, leftmost and non-overlapping.

    Starts are sums of what stands before them: over whole blocks of BLOCK matches, then within a block, so that no
    text, however many matches it has, adds up each from its beginning.
    """
    span = lambda x: x["gap"] + F.length(x["value"])
    summed = lambda xs, f: F.aggregate(xs, F.lit(0), lambda s, x: s + f(x))
    pairs = lambda hits: F.zip_with(F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, F.size(hits)), hits, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def within(block: Column, before: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = before + summed(F.slice(block, F.lit(1), i), span) + x["gap"]
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

        return F.transform(block, one)

    placed = lambda blocks, totals: F.flatten(F.transform(blocks, lambda block, b: _let(summed(F.slice(totals, F.lit(1), b), lambda x: x), lambda before: within(block, before))))
    whole = lambda all_: _let(cut(all_), lambda blocks: _let(F.transform(blocks, lambda block: summed(block, span)), lambda totals: placed(blocks, totals)))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _let(pairs(hits), whole))


def _where(text: Column, quick: str, pattern: str) -> Column:
    """found(), for texts that a quicker test lets through."""
    return F.when(text.rlike(quick), found(text, pattern)).otherwise(F.array().cast("array<struct<start: int, end: int, value: string>>"))


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): every span of a row of docs as structs of start, kind number, kind and end, by start, then kind.

    Kinds: assign, access, hex by fixed patterns; random by the models, for strings of CANDIDATE. Null is empty.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = text.select(
        "doc_id",
        _where(F.col("text"), r"(?i:passw|secret|token|api_?key)", ASSIGN).alias("assign"),
        # A run matches whole or, too short, not at all, so the pattern itself may ask for the length.
        _where(F.col("text"), "AKIA[A-Z0-9]{16}", "AKIA[A-Z0-9]{16,}").alias("access"),
        _where(F.col("text"), "[0-9a-f]{24}", "[0-9a-f]{24,}").alias("hex"),
        _where(F.col("text"), r"[A-Za-z0-9+/_-]{16}", CANDIDATE).alias("random"),
    )
    good = {
        "assign": F.filter("assign", lambda x: F.length(F.regexp_replace(x["value"], ASSIGN_HEAD, "")) >= LEAST["assign"]),
        "access": F.col("access"),
        "hex": F.col("hex"),
        "random": F.filter("random", lambda x: score(x["value"], table) >= threshold),
    }
    spans = [_tagged(good[k], i, k) for i, k in enumerate(good)]
    return raw.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def _tagged(spans: Column, no: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Without a table the models are trained from random strings and from identifiers made of the documents' words.
    """
    if table is None:
        table = train(random_samples(docs.sparkSession).unionByName(identifier_samples(docs)))
    rows = scan(docs, table, threshold)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = joined(F.filter("spans", lambda x: x["kind"] != "random"))
    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("random").alias("n_random"))


def redacted(docs: DataFrame, table: list[float], mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, each secret replaced by mark, kind after kind: what one kind has left is what the next one sees.

    Null texts stay null and repeated rows stay; columns keep their names; an empty table gives no rows.
    """
    kinds = {
        ASSIGN: lambda v: F.length(F.regexp_replace(v, ASSIGN_HEAD, "")) >= LEAST["assign"],
        "AKIA[A-Z0-9]{16,}": lambda v: v.isNotNull(),
        "[0-9a-f]{24,}": lambda v: v.isNotNull(),
        CANDIDATE: lambda v: score(v, table) >= threshold,
    }
    def replaced(good):  # noqa: ANN001, ANN202
        return lambda gap, v: F.concat(gap, F.when(v.isNull(), "").when(good(v), mark).otherwise(v))

    out = docs
    for pattern, good in kinds.items():
        text = F.array_join(F.zip_with(F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), replaced(good)), "")
        out = out.withColumn("text", F.when(F.col("text").rlike(pattern), text).otherwise(F.col("text")))
    return out
