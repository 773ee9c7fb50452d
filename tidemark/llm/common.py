"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.session import shared_folder

__all__ = ["cut_lineage", "forget", "shared_folder", "ship", "text_crc32", "unused", "with_maybe", "without_ids", "word_count"]

#: Fixed pattern of the word rule of the size and shingle contracts.
SPACED_WORDS = r"[^\x20\x09-\x0D]+"
#: Most bits of a bitmap of hashed values.
BITMAP_BITS = 1 << 26
#: Most bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20
#: Codec of written tables. Snappy's page buffers lie outside the heap and go only when old objects are collected, so over the
#: many tables of a pipeline they add up in an executor; this codec's stream buffers lie on the heap.
CUT_CODEC = "zstd"
_SHIPPED: set[str] = set()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``session.cut_lineage`` for jobs that write many tables."""
    return session.cut_lineage(df, compression=CUT_CODEC)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application.

    Arrow batches of the session get at most ``BATCH_BYTES``, unless it has a smaller bound: texts come and go in buffers of
    both processes, which by default hold ten thousand rows or 64 MB.
    """
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark_package.zip")
    with open(path, "wb") as out:
        out.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def forget(table: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote, once nothing will read it again."""
    files = table.inputFiles()
    if files and "/tidemark-cut-" in files[0]:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def word_count(text: Column) -> Column:
    """Words of a text between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORDS)), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def with_maybe(rows: DataFrame, value: Column, held: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag ``name``: whether ``value`` may be in the one column of ``held``; never false for one that is.

    It goes before an exact join, so that few wide rows are shuffled. The test is a bitmap of hashes as a broadcast table of 64-bit
    words, joined on the place of the word, inside the JVM. The bitmap has ``BITMAP_BITS`` bits at most (a million words), a bounded
    size for driver and executors; if it gets full it lets more pass. ``held`` is read twice.
    """
    size = 1 << min(BITMAP_BITS.bit_length() - 1, max(10, (16 * held.count()).bit_length()))
    at = held.select(F.pmod(F.xxhash64(held.columns[0]), F.lit(size)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias(f"{name}_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias(f"{name}_bits"))
    place = F.pmod(F.xxhash64(value), F.lit(size))
    marked = rows.withColumn(f"{name}_at", place)
    marked = marked.join(F.broadcast(words), F.shiftright(f"{name}_at", 6) == F.col(f"{name}_word"), "left")
    bit = F.expr(f"shiftright({name}_bits, cast({name}_at % 64 as int)) & 1")
    return marked.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(f"{name}_at", f"{name}_word", f"{name}_bits")


def unused(name: str, rows: DataFrame) -> str:
    """A column name that ``rows`` has not got, nor one that begins with it."""
    while any(c.startswith(name) for c in rows.columns):
        name += "_"
    return name


def without_ids(rows: DataFrame, name: Column, dropped: DataFrame) -> DataFrame:
    """The rows whose ``name`` is not in the one column of ``dropped``; only rows that may be are shuffled."""
    held, flag = unused("_dropped", rows), unused("_maybe", rows)
    dropped = cut_lineage(dropped.toDF(held))
    marked = with_maybe(rows, name, dropped, flag)
    kept = marked.where(~F.col(flag)).drop(flag)
    return kept.unionAll(marked.where(flag).drop(flag).join(dropped, name == F.col(held), "left_anti"))
