"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Used only in one process, where the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/rankloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only a session within one process may leave it unset; anywhere else a local
    folder would lose what other machines wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def fresh(name: str, taken: list[str]) -> str:
    """A column name beginning with ``name`` that is not taken (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Frees the shuffle files of a write as soon as it is done, instead of whenever the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str, mode: str = "error", rows_per_file: int = 0) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        conf.set(CLEAN_UP, before)


def stage(df: DataFrame, label: str, kept: list | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This cuts the lineage and fixes the rows: several consumers see the same
    values, and a lost executor costs a re-read instead of a recomputation.  What was
    written is noted in ``kept``, for :func:`discard`.  ``rows_per_file`` bounds the rows of
    a file (0: no bound): where a row has megabytes, a writer and a reader hold a whole file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    _written(df, path, rows_per_file=rows_per_file)
    out = spark.read.schema(df.schema).parquet(path)
    if kept is not None:
        kept.append((path, out))
    return out


def discard(kept: list) -> None:
    """Empty the staged frames that nothing will read any more; their folders stay."""
    while kept:
        path, df = kept.pop()
        _written(df.sparkSession.createDataFrame([], df.schema), path, "overwrite")


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python a few MB at a time: the default of 64 MB is held several times over by each task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Array of the words of a text; null text gives no words."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def trim() -> None:
    """Give memory that a Python worker no longer needs back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
