"""The queries of the training-data operators, each over its whole table with production parameters.

None has SQL beside it: DuckDB has neither XXH64 with a seed nor these codecs, walks, draws and models. Their tests
hold them against brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import fingerprints, language_id, line_dedup, media_columns, mixing, packing, secret_scan, simhash_dedup, substring_dedup, token_output
from framewright.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.span_report(documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_features(media_columns.to_media(documents(spark, sf_dir)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out())))
    return got.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.grouped_report(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_files(spark, token_output.write_files(documents(spark, sf_dir)))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_dedup.simhash_groups(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_media_columns, op3_language_id, op4_source_mix, op5_line_dedup, op6_document_fingerprints, op7_secret_scan, op8_sequence_packing, op9_token_files, op10_simhash_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
