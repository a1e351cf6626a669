"""Shared plumbing of the training-text operators: staged tables, checked broadcasts, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of rows that a side may have to be broadcast; each use counts the rows first.
BROADCAST_ROWS = 400_000
#: Bytes of a batch between executor and worker.
ARROW_BYTES = 2 << 20
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(spark.sparkContext, "_tarnwood_dir", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="tarnwood-")
            spark.sparkContext._tarnwood_dir = named
            atexit.register(_remove, named.removeprefix("file://"))
    return named.rstrip("/")


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def stage(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation.

    Shuffle files of the write go when it ends, since nothing reads them again. parts: most tasks that write, for a table
    whose size is known."""
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = f"{shared_dir(spark)}/tarnwood-{uuid.uuid4().hex}/{name}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int = 50_000) -> int:
    """Most tasks that should write a table made of so many counted rows; beyond the shuffle partitions it has no effect."""
    return 1 + rows // each


def small_side(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, parts: int | None = None) -> DataFrame:
    """Stage df, count it, and mark it for broadcast only if it has at most `rows` rows; otherwise joins shuffle."""
    out = stage(df, name, parts)
    return F.broadcast(out) if out.count() <= rows else out


def smallest_by_hash(rows: DataFrame, by: str, n: int) -> DataFrame:
    """rows with columns `by` and h (a hash, evenly spread): at most about 2 n + 64 rows per value of `by` with the least h.

    Rows are counted first and h bounds them in the scan, so that no task gathers what grows with the table; rows that
    share a hash may exceed the bound until the last step, which counts them out."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("of"))
    share = F.least(F.lit(1.0), (2.0 * n + 64) / F.col("of"))
    picked = rows.join(F.broadcast(stage(counts.select(by, (share * 2.0**63 * 2 - 2.0**63).alias("upto")), "counts", 1)), by).filter(F.col("h").cast("double") <= F.col("upto")).drop("upto")
    part = picked.withColumn("part", F.row_number().over(Window.partitionBy(by, F.pmod("h", F.lit(16))).orderBy("h", "doc_id", "size"))).filter(F.col("part") <= n).drop("part")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("h", "doc_id", "size"))).filter(F.col("rank") <= n)


def gives_back(run):
    """The Arrow function `run`, after whose partition the worker gives its free memory back to the system: workers stay for
    later stages, and the executor needs their room."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of at most ARROW_BYTES where the session allows larger ones: executor and worker each hold
    a batch and a copy of it while it is built, for each task. Only the plan's memory depends on it, never a result."""
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(gives_back(run), schema)


def batches_by_bytes(batches, column: str, limit: int = 4 << 20):
    """Re-slice Arrow batches so that each holds about `limit` bytes of `column` (a longer single row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(lengths(col))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def lengths(col: pa.Array) -> np.ndarray:
    """UTF-8 length of each text, null as 0."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets, null as empty."""
    import pyarrow.compute as pc

    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
