"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where none is."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="rolefold-")
        atexit.register(shutil.rmtree, known, True)
        known = f"file://{known}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


#: Else pages end only after 100 values and row groups at 128 MB, whatever a value's size: writers and the codecs'
#: native buffers hold the largest page, and a reader puts a whole row group into one vector.  A row of more than
#: ``parquet.block.size`` bytes is a row group of its own; values that seldom repeat need no dictionary.
LARGE = {f"parquet.{x}.size.row.check.min": "1" for x in ("page", "block")}
LARGE |= {"parquet.block.size": str(1 << 20), "parquet.enable.dictionary": "false", "compression": "zstd"}


def saved(df: DataFrame, name: str, by: str | None = None, large: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder, partitioned by a column if one is named, and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.  ``large``:
    values take megabytes, so pages and row groups are measured after each row and kept small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write = df.write.options(**(LARGE if large else {}))
    (write.partitionBy(by) if by else write).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_in = path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables whose readers are done."""
    for df in tables:
        if (path := getattr(df, "saved_in", None)) is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a batch of rows on its way to Python; a larger row goes alone.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python in batches of ``BATCH`` bytes at most; a lower bound stays.

    Spark's own bound is 64 MB, and each task holds a batch several times outside of the
    heap: in a buffer that doubles as it grows, and in Python next to what is made of it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (now := spark.conf.get(key, None)) and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH:
        spark.conf.set(key, str(BATCH))


def release() -> None:
    """Give freed memory back to the system where its allocator keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Task) -> Task:
    """A task for mapInArrow that gives its memory back when its rows are out.

    Python workers live on for later tasks, and allocators keep what is freed: else each
    worker of an executor stays as large as the largest task it ever ran.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text binary): other columns, whatever their names, stay out."""
    small_batches(df.sparkSession)
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.encode(F.coalesce(df[text_col].cast("string"), F.lit("")), "UTF-8").alias("text"),
    )


def crc_mod(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: what deals documents into folds."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus
