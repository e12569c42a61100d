"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds at once, besides a single longer text.
CHUNK_CHARS = 2_000_000
BITMAP_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches, text_at: int = 1, max_chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, texts) of at most max_chars characters, or of one longer text.

    A batch of many long texts would otherwise be expanded into words all at once.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(text_at).to_pylist()
        start = held = 0
        for i, text in enumerate(texts):
            n = len(text) if text else 0
            if held and held + n > max_chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += n
        yield batch.slice(start), texts[start:]


def smaller_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the Arrow batch size where it is still Spark's default, so long texts do not pile up."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the executors share")
        named = os.path.join(tempfile.gettempdir(), "marlspike-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: Of each thread the paths of the tables written inside each open scratch(), the innermost last.
_open = threading.local()


def opened() -> list[list[str]]:
    if not hasattr(_open, "scratch"):
        _open.scratch = []
    return _open.scratch


def materialise(df: DataFrame, stays: bool = False) -> DataFrame:
    """Write df as Parquet under the checkpoint folder and read it back: lineage ends in shared files.

    Inside scratch() the table goes with the scratch, or with the one around it if it stays.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    if len(opened()) > stays:
        opened()[-1 - stays].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside are deleted at the end; what is needed longer has to be told to stay."""
    own: list[str] = []
    opened().append(own)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        opened()[:] = [x for x in opened() if x is not own]
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def give_back_memory() -> None:
    """Return what this process has freed to the system: a JVM beside it, and later steps, need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def freed(run):
    """run, for mapInArrow: when a task ends, its worker, which later stages use again, keeps none of its memory."""

    def own(batches):
        yield from run(batches)
        give_back_memory()

    return own


def is_split(key: str, modulus: int, remainder: int):
    """True for rows whose crc32 of the id as text has this remainder; a null id has none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


# Names that no table has, since rows of any table can be marked.
SLOT, WORD_AT, MASK = "slot of marks", "word of marks", "mask of marks"


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """keys: column slot, distinct. The words of the bitmap that are not 0: at most bits / 64 rows."""
    return keys.groupBy(F.expr("slot div 64").alias(WORD_AT)).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias(MASK))


def marked(df: DataFrame, slot: Column, marks: DataFrame, hit: bool = True) -> DataFrame:
    """Rows of df whose slot is set in the bitmap, or the others."""
    own = df.withColumn(SLOT, slot)
    bit = F.expr(f"shiftright(`{MASK}`, CAST(`{SLOT}` % 64 AS INT)) & 1L")
    joined = own.join(F.broadcast(marks), F.expr(f"`{SLOT}` div 64") == F.col(WORD_AT), "inner" if hit else "left")
    return joined.filter(bit == 1 if hit else F.coalesce(bit, F.lit(0)) == 0).select(*df.columns)


def by_marks(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that may have one of these ids, of a column doc_id; rows that surely have none): so that only the first are shuffled."""
    marks = materialise(bitmap(ids.select(slot_of("doc_id").alias("slot")).distinct()))
    return tuple(marked(docs, slot_of("doc_id"), marks, hit) for hit in (True, False))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id, null too, is not among gone's."""
    gone = materialise(gone.select("doc_id").distinct())
    maybe, other = by_marks(docs, gone)
    own = gone.select(F.col("doc_id").alias("id that goes"))
    return other.union(maybe.join(own, F.col("doc_id").eqNullSafe(F.col("id that goes")), "left_anti").select(*docs.columns))


def slot_of(c: str, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
