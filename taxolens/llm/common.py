"""Helpers that the corpus operators share: table access, shared folders, tokens.

Word rules used throughout (ASCII only, byte exact):
* white space is 0x20 and 0x09-0x0D, which is what ``bytes.split()`` splits on;
* ``lower-case A-Z`` is ``bytes.lower()``, which leaves other letters alone.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.session import local_path, open_shared, run_dir, ship

#: The C library's own way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Words in Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches hold so many documents: at 100 kB each, about 25 MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (any path Spark can read)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can weigh in a Python worker, and see
    that workers have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in this run's part of the shared folder (``session.clear`` empties it)."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def unused(names: list[str], stem: str) -> str:
    """A column name like ``stem`` that none of ``names`` equals, whatever the case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(names: list[str]) -> list[str]:
    """Column names as Spark takes them when they hold dots or back-quotes."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def release() -> None:
    """Give what a finished task has freed back to the system: a Python worker outlives
    its tasks, and an executor's limit counts what its workers hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: What a worker holds between tasks, by key, and the operator whose tasks it was for.
_HELD: dict = {}
_OWNER = [""]


def only(owner: str) -> dict:
    """What this worker holds for an operator; what it held for another one goes."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        _HELD.clear()
        release()
    return _HELD


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), on a fresh array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def publish(uri: str, payload: bytes) -> None:
    """Write a whole file so that a reader sees all of it or none; a task that is
    run again replaces it by the same bytes."""
    temp = f"{uri}.{uuid.uuid4().hex}.tmp"
    with open_shared(temp, "wb") as f:
        f.write(payload)
    path = local_path(uri)
    if "://" not in path:
        os.replace(local_path(temp), path)
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(uri)
        system.move(fs.FileSystem.from_uri(temp)[1], inner)


def n_words(column: str):
    """Spark expression that counts the words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
