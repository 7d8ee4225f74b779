"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on this machine alone (tests) a temporary folder is made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there. The table goes when the application ends, if ``drop`` does not come first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the tables of ``stored`` frames that nothing will read again."""
    for df in frames:
        fs, at = _file_system(df.sparkSession, df._stored_at)
        fs.delete(at, True)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file in the shared folder; returns its place."""
    fs, path = _file_system(spark, f"{shared_dir(spark)}/{name}")
    out = fs.create(path, True)
    fs.deleteOnExit(path)
    try:
        for lo in range(0, len(data), 1 << 20):
            out.write(bytearray(data[lo : lo + (1 << 20)]))
    finally:
        out.close()
    return path.toString()


def spared(f):
    """``f`` of one table or two, with Arrow's unused memory handed back before and after: idle workers would keep it."""

    def one(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        out = f(table)
        pa.default_memory_pool().release_unused()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        out = f(left, right)
        pa.default_memory_pool().release_unused()
        return out

    return one if f.__code__.co_argcount == 1 else two


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint if ``df`` is counted to have at most ``max_rows`` rows; else ``df`` as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def cut_points(df: DataFrame, col: str, rows_per_bucket: int, most: int = 8192) -> list[int]:
    """At most ``most`` values of the integer column that split it into buckets of about ``rows_per_bucket`` rows."""
    n = df.count()
    parts = min(most, math.ceil(n / rows_per_bucket))
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(col).cast("long"), at, max(10_000, 4 * parts)).alias("p")).head()["p"]
    return sorted(set(found or []))


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """Order-preserving bucket of an integer: how many cut points are at most the value; null: -1.

    A binary search over the literal array, unrolled, so that a row costs log2(len(cuts)) comparisons.
    """
    if not cuts:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    points = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    n, lo = len(cuts), F.lit(0)

    def halved(lo: Column, s: int) -> Column:
        return let(lo, lambda x: F.when((x + s <= n) & (F.get(points, F.least(x + s, F.lit(n)) - 1) <= value), x + s).otherwise(x))

    step = 1 << (n.bit_length() - 1)
    while step:
        lo, step = halved(lo, step), step >> 1
    return F.when(value.isNull(), F.lit(-1)).otherwise(lo)


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as numbers, end to end, how many each text has, and the distinct words by number.

    A-Z is lower-cased (if ``lower``); words are runs without ASCII white space; null texts are empty.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, found = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    empty = np.flatnonzero(pc.binary_length(found).to_numpy(zero_copy_only=False) == 0)  # beside white space at either end
    if len(empty):
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), empty, side="right"), minlength=len(sizes))
        found = found.filter(pc.greater(pc.binary_length(found), 0))
    coded = found.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, coded.dictionary


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def dealt(n: int) -> Column:
    """A block number below ``n`` by a row's place in its input, so that repeated rows spread out too.

    The input is a table, or a plan without shuffles, so that a task that runs again meets its rows in the same places.
    """
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def block_count(df: DataFrame, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text; on little text as many as there are shuffle partitions, if they get 512 KB each."""
    size = text_bytes(df)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(size / block_bytes), min(partitions, math.ceil(size / (1 << 19))))


def runs(batch, at: int, most: int = 4_000_000):
    """Slices of a batch of about ``most`` bytes of text."""
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            yield batch.slice(lo, i + 1 - lo)
            lo, total = i + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)
