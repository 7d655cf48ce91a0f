"""Language ID by compression: per-language zstandard raw-content dictionaries, the smallest output wins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import kept, text_slices

#: The classifier is fitted on this many labelled documents a language at most, of whose letters a dictionary holds so many bytes.
FIT_DOCUMENTS, DICTIONARY_BYTES = 500, 400 << 10
#: Languages beyond which fitting is refused, and what all dictionaries and all documents for them come to at most.
MOST_LANGUAGES, ALL_BYTES, ALL_DOCUMENTS = 1000, 32 << 20, 20_000
#: Bytes of letters that one of these documents gives at most.
FIT_BYTES = 2048
#: Bytes that are compressed at a time, so that the dictionary counts throughout a long text.
PIECE = 2048
LEVEL = 6
#: Below this share of bytes saved against the second language, a prediction is not accepted.
LEAST_MARGIN = 0.002
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters with single spaces between their runs."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary of each language, from rows of text and non-null lang.

    The texts of a language are dealt by a hash into `documents` slots, and the one with the smallest hash in each is
    chosen, by partial minima, so that a language may hold any share of the rows; of these, each gives FIT_BYTES at
    most. Where there are many languages, each has fewer documents and bytes, within ALL_DOCUMENTS and ALL_BYTES; more
    than MOST_LANGUAGES are an error. Repeated texts count once. No labelled letters: no language.
    """
    rows = docs.select("text", "lang").where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    languages = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; dictionaries of all are held in every task")
    documents, size = min(documents, ALL_DOCUMENTS // max(1, languages)), min(size, ALL_BYTES // max(1, languages))
    slot = F.pmod(F.xxhash64(F.lit("slot"), "text"), F.lit(documents))
    chosen = rows.groupBy("lang", slot.alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    part = F.substring("text", 1, 4 * FIT_BYTES)
    got = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", part.alias("text")).dropDuplicates(["lang", "h"]).collect()
    made: dict[str, bytes] = {}
    for row in sorted(got, key=lambda r: (r["lang"], r["h"])):
        if len(own := made.get(row["lang"], b"")) < size:
            made[row["lang"]] = own + letters(row["text"])[:FIT_BYTES] + b" "
    return {k: v[:size] for k, v in made.items() if v.strip()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        # A worker may still hold all words of the stage before.
        kept("language")
        self.by: list[tuple[str, zstandard.ZstdCompressor]] = []
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append((lang, zstandard.ZstdCompressor(dict_data=d)))

    def predict(self, text: str | None, piece: int = PIECE) -> tuple[str, float]:
        """Language and the share of bytes that it saves against the second; one language alone has 1."""
        raw = letters(text) if text else b""
        if not raw or not self.by:
            return UNKNOWN, 0.0
        parts = [raw[i : i + piece] for i in range(0, len(raw), piece)]
        sizes = sorted((sum([len(c.compress(p)) for p in parts]), lang) for lang, c in self.by)
        return sizes[0][1], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = LEAST_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (doc_id), lang_pred, score and accepted for every row.

    A text that is null or has no letter is `und` with score 0 and is not accepted; ties go to the first language
    by name, with score 0, and are not accepted. Repeated rows stay.
    """
    keep = ["doc_id"] if keep is None else keep
    kinds = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            for part in text_slices(batch):
                known: dict[str | None, tuple[str, float]] = {}
                rows = []
                for t in part.column("text").to_pylist():
                    if t not in known:
                        known[t] = judge.predict(t)
                    rows.append(known[t])
                lang, score = pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())
                ok = pa.array([r[0] != UNKNOWN and r[1] >= margin for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(f"__fw_{i}") for i in range(len(kinds))), lang, score, ok], [*(f"k{i}" for i in range(len(kinds))), "lang_pred", "score", "accepted"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    chosen = docs.select(F.col("text").cast("string").alias("text"), *(F.col(f.name).alias(f"__fw_{i}") for i, f in enumerate(kinds)))
    schema = StructType([*(StructField(f"__fw_{i}", f.dataType) for i, f in enumerate(kinds)), StructField("__fw_lang_pred", StringType()), StructField("__fw_score", DoubleType()), StructField("__fw_accepted", BooleanType())])
    got = chosen.mapInArrow(_renamed(run, schema.names), schema)
    return got.select(*(F.col(f"__fw_{i}").alias(f.name) for i, f in enumerate(kinds)), F.col("__fw_lang_pred").alias("lang_pred"), F.col("__fw_score").alias("score"), F.col("__fw_accepted").alias("accepted"))


def _renamed(run, names: list[str]):
    return lambda batches: (pa.RecordBatch.from_arrays(b.columns, names) for b in run(batches))


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 3, is 1. A null id is not."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_filter(docs: DataFrame, margin: float = LEAST_MARGIN) -> DataFrame:
    """The rows of docs, whole, whose prediction is accepted; fitted on the labelled rows that are not held out.

    Null texts, texts without letters and ties go; rows that share a doc_id are judged one by one, and repeated rows
    stay or go together. Columns keep their names, whatever these are; an empty table gives no rows.
    """
    return filtered(docs, fit(docs.where(~held_out())), margin)


def filtered(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = LEAST_MARGIN) -> DataFrame:
    """The rows of docs, whole, whose prediction is accepted: language_filter() with dictionaries that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            for part in text_slices(batch):
                verdicts = [judge.predict(t) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array([v[0] != UNKNOWN and v[1] >= margin for v in verdicts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
