"""Shared pieces of the training-data operators: durable tables, components, Arrow text access."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20
#: What holds while a table is written: its shuffle files go as soon as that has ended, and Python workers get batches of about as many bytes as they handle at a time.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE_BYTES)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a temporary one serves, but only if all tasks run in the driver's own process; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The shuffle files of the write go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_fw_folder"] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize made and that no result reads any more."""
    for table in tables:
        path = table.__dict__.pop("_fw_folder", None)
        if path is not None:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: What a stage keeps in a Python worker from task to task, by the stage's name.
_KEPT: dict[str, dict] = {}


def kept(stage: str) -> dict:
    """What the stage keeps in this process from task to task.

    Executors hand a worker from one stage to the next, and its memory with it; so what others have kept goes first.
    """
    if stage not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)
        _KEPT[stage] = {}
    return _KEPT[stage]


def rows_apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage or report over docs for which each row is a document of its own.

    Where rows share a doc_id, nulls among them, it sees numbers in place of the ids, in their order, nulls last,
    then in that of hashes of the texts; its rows come back with their own ids.
    """

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        number = F.col("doc_id").cast("long")
        if not docs.groupBy(number).count().where("count > 1").limit(1).count():
            return stage(docs, *args, **kwargs)
        # The last key parts rows that are alike in all the others, so that a common row does not fill a task.
        ordered = docs.withColumn("__fw_doc", F.col("doc_id")).orderBy(number.asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
        # Written, so that a task that runs again gives the same numbers.
        numbered = materialize(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "row-numbers")
        out = stage(numbered, *args, **kwargs)
        if "__fw_doc" in out.columns:
            return out.withColumn("doc_id", F.col("__fw_doc")).select(*(F.col(f"`{c}`") for c in docs.columns))
        own = numbered.select(F.col("doc_id").alias("__fw_no"), F.col("__fw_doc").cast("long").alias("__fw_doc"))
        both = out.join(own, F.col("doc_id") == F.col("__fw_no"))
        return both.select(*(F.col("__fw_doc").alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in out.columns))

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: distributed union-find by hooking and pointer jumping.

    edges(a, b) of one orderable type; result (node, root), a row for each node that has an edge to another
    node, root the smallest node of its component. Each round hooks every node to its smallest neighbour, jumps
    pointers until every tree is flat, then contracts the edges; the rounds are logarithmic in the nodes.
    Self-loops and repeated edges change nothing; no edges give no rows. Nulls are ignored.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    pairs = materialize(pairs.distinct(), "cc-edges")
    found = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        table = up = materialize(up.select("node", F.least("node", "m").alias("root")), "cc-hook")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = materialize(up.join(over, "root").select("node", "root", "top"), "cc-jump")
            forget(table)
            table, up = step, step.select("node", F.col("top").alias("root"))
            if not step.where("root <> top").limit(1).count():
                break
        over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        merged = up if found is None else found.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        merged = materialize(merged, "cc-found")
        at = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        left = pairs.join(at("a"), "a").join(at("b"), "b").where("a_root <> b_root")
        left = materialize(left.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "cc-edges")
        forget(pairs, table, *([found] if found is not None else []))
        found, pairs = merged, left
        if not pairs.limit(1).count():
            forget(pairs)
            return found


#: Words of 64 bits of the filter that passes over rows that a join would drop; its size does not depend on the data.
FILTER_WORDS = 1 << 18


def perhaps_among(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are among those of wanted, and some others: by a table of hashed bits, of a fixed size, that is broadcast."""
    h = F.xxhash64(*keys)
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), F.pmod(h, F.lit(64)).cast("int")
    marks = wanted.select(word.alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}), 64L) as int))").alias("__mark")).groupBy("__word").agg(F.bit_or("__mark").alias("__marks"))
    both = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(marks), "__word")
    return both.where(F.expr("(shiftright(__marks, __bit) & 1L) = 1L")).select(*rows.columns)


def shared_bands(placed: DataFrame, node: str) -> DataFrame:
    """The rows of placed(band, node, ...) whose band has several, with its size and its first node, as a table.

    Bands are counted by partial sums and their rows found by a join, so that a band may hold any share of all rows.
    """
    shared = materialize(placed.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(node).alias("first")).where("size > 1"), "bands")
    ranked = materialize(perhaps_among(placed, shared, "band").join(shared, "band"), "candidates")
    forget(shared)
    return ranked


def near_in_bands(ranked: DataFrame, node: str, order: list[str], neighbours: int, group: int) -> DataFrame:
    """Distinct pairs (a, b) of each node with its band's first and with those before it in the order, in groups of about `group` of the band."""
    dealt = F.pmod(F.xxhash64(node), F.ceil(F.col("size") / group))
    own = Window.partitionBy("band", "__group").orderBy(*order, node)
    near = ranked.withColumn("__group", dealt).select(node, F.array("first", *(F.lag(node, k + 1).over(own) for k in range(neighbours))).alias("near"))
    pairs = near.select(F.col(node).alias("x"), F.explode("near").alias("y")).where("y is not null and x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def unlinked_in_bands(ranked: DataFrame, node: str, joined: DataFrame) -> DataFrame:
    """(node, band, size, root) of ranked(node, band, size) in the bands that hold nodes of several components of joined(node, root)."""
    rooted = ranked.select(node, "band", "size").join(joined.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi")).where("__lo <> __hi").select("band")
    return rooted.join(mixed, "band")


def pairs_across(members: DataFrame, keys: list[str], node: str, carried: Sequence[str] = (), keep: Column | None = None, details: DataFrame | None = None, together: int = 0) -> DataFrame:
    """Distinct pairs (a, b) of members(*keys, node, root, *carried) that agree on the keys and not on the root.

    keep may name a carried column c, or one of details(node, ...), as c_x and c_y; it is judged within the join, which
    puts out no other pairs. All members meet those of other roots than the commonest, so one component, however large,
    makes no pairs of its own. With `together`, members(size) are dealt into parts of about so many.
    """
    counted = members.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("__n"))
    main = counted.groupBy(*keys).agg(F.max_by("root", F.struct("__n", "root")).alias("__main"), F.count(F.lit(1)).alias("__roots")).where("__roots > 1")
    own = members.join(main.select(*keys, "__main"), keys)
    others = own.where("root <> __main")
    if together:
        parts = F.ceil(F.col("size") / together).cast("int")
        own = own.withColumn("__part", F.pmod(F.xxhash64(node), parts).cast("int"))
        others = others.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
        keys = [*keys, "__part"]
    if details is not None:
        own, others = own.join(details, node), others.join(details, node)
        carried = [*carried, *(c for c in details.columns if c != node)]
    x, y = (rows.select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in (node, "root", "__main", *carried))) for k, rows in (("x", own), ("y", others)))
    # Two of other roots than the commonest meet once.
    both = x.join(y, keys).where("root_x <> root_y").where(f"root_x = __main_x or {node}_x < {node}_y")
    both = both if keep is None else both.where(keep)
    return both.select(F.least(f"{node}_x", f"{node}_y").alias("a"), F.greatest(f"{node}_x", f"{node}_y").alias("b")).distinct()


def row_slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a larger row stands alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(sizes) > first:
        yield first, len(sizes)


def utf8_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that each hold about `most` bytes in the column text."""
    text = batch.column("text")
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]) if len(text) else np.zeros(0, int)
    for i, j in row_slices(sizes, most):
        yield batch.slice(i, j - i)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
