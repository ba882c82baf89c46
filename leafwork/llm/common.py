"""What the corpus operators share: tables, folds, written intermediate tables and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_rows(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows, where the session has the default of 10,000: rows hold whole documents here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local one on a local master (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafwork-"))
        base = context.getCheckpointDir().get()
    return f"{base.rstrip('/')}/leafwork-{uuid.uuid4().hex}"


#: With this setting Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect what refers to them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """The rows of df, written once as Parquet into the shared folder and read again: lineage is cut and a lost executor costs nothing.

    The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path, before = work_dir(spark), spark.conf.get(_CLEAN, "false")
    writer = df.write.option("compression", compression)
    spark.conf.set(_CLEAN, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafwork_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._leafwork_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; null keys are in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def pieces(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes, without copying: (first row, bytes, offsets of the run's texts). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, at: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blanks (ASCII white space); words end with their text. Third: the text of each word."""
    inside = ~blank[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[1:-1][at[1:-1] < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(at, starts, "right") - 1


_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


_INVERSE = pow(_ODD, -1, 1 << 64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from one prefix sum of byte * base^-i over the whole buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down, up = _powers(_INVERSE, len(raw)), _powers(_ODD, len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down, out=total[1:], dtype=np.uint64)
        h = (total[ends] - total[starts]) * up[ends - 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h
