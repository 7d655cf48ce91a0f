"""Tab-separated manifests of test cases: fixed columns, or a tail of key=value pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "name string, kind string, codec string, expected string, minimum_quality_db double, relative_path string, sha256 string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).option("sep", "\t").option("comment", "#").csv(path)


def read_tagged(spark: SparkSession, path: str, fixed: int = 3) -> DataFrame:
    """(name, path, sha256, expected map): what follows the fixed columns is key=value, parted once; repeated keys join with a bar."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(cells.alias("c"))
    tail = F.filter(F.slice("c", fixed + 1, F.greatest(F.lit(0), F.size("c") - fixed)), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(tail, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), "|"))
    return rows.select(F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).alias("path"), F.get("c", F.lit(2)).alias("sha256"), F.map_from_arrays(keys, values).alias("expected"))
